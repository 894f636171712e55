"""URL filters: host and path rules over a logistic regression on hashed character n-grams, trained
from a small labelled table of URLs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 17

#: Words of names and paths by which urls of the labelled table are blocked, by theme.
BLOCKED_WORDS = {
    "gambling": "casino slots poker roulette jackpot blackjack baccarat betting bets sportsbook bingo lottery wager",
    "pills": "pills viagra cialis pharmacy meds tramadol xanax prescription steroids",
    "adult": "porn xxx sex adult nude escort webcam hentai milf erotic",
    "tracking": "ads adserver track tracker tracking pixel popunder clickads banner affiliate",
    "spam": "spam seo backlinks linkfarm traffic doorway splog",
    "loans": "payday loans forex cashadvance bitcoin doubler",
    "fraud": "warez crack cracked keygen torrent replica phishing malware fakeid",
}
#: Second words that both blocked and allowed names carry: alone they tell nothing.
SHARED_WORDS = "best free online shop club daily world top my big star city house home zone point hub"
#: Words of names and paths of allowed urls, by theme; the last ones hold a blocked word's letters.
ALLOWED_WORDS = {
    "news": "herald weather journal gazette tribune chronicle bulletin press radio magazine",
    "learning": "university college academy physics biology chemistry geography maths language grammar",
    "places": "harbour castle village county council island river mountain bridge railway airport province",
    "home": "garden gardening recipes kitchen bakery carpet blanket furniture candle window",
    "food": "butter cheese coffee ginger garlic onion lemon orange potato honey",
    "nature": "birds forest desert ocean thunder lightning winter summer rabbit eagle dolphin meadow",
    "work": "doctor lawyer teacher farmer painter writer sailor engine bicycle software code linux forum",
    "leisure": "football chess film music theatre opera travel photo books stadium tickets",
    "letters": "essex sussex middlesex adelaide addison address adapter betty alphabet diabetes pharmacology adulthood pillow caterpillar cracker firecracker crackling racetrack tracks trackside spamalot seoul windmill winding loaning pokerface bannerman trafficlights",
}
#: Sites that write about anything: on them a blocked word in the path is a subject.
REFERENCE = "wikipedia wiki library encyclopedia museum archives history dictionary news science schools research parliament court health".split()
SUBJECTS = ("/wiki/{w}", "/articles/{w}-history", "/subjects/{w}.html", "/2019/04/{w}-law-explained", "/dictionary/{w}", "/study-of-{w}", "/en/history/{w}/page-3")
#: Hosts are dealt these last labels; the last line stands on blocked hosts alone.
ENDINGS = ("com", "org", "net", "info", "io", "co.uk", "de", "test")
BLOCKED_ENDINGS = ("casino", "bet", "xxx", "porn", "sex", "adult", "poker", "loan")
#: Paths that tell nothing, on hosts of both kinds.
PATHS = ("", "/", "/index.html", "/2024/05/page-7.html", "/en/12", "/fr/3.html", "/de/864/", "/es/335", "/a/b/c", "/article/9", "/p/1")
PREFIXES = ("", "www.", "blog.", "m.", "shop.")


#: Rules in force: verdict, host and its subdomains, path prefix.
RULES = (
    ("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"), ("block", "org", "/es/"),
)


_BREAK = re.compile(r"[./\-_~%&=+:;,]+")
_PLAIN = bytes(48 if 48 <= c <= 57 else c for c in range(256))
SIZES = (3, 4, 5)


def table(without: Sequence[str] = ()) -> list[tuple[str, str, int]]:
    """(host, path, 1 to block) rows to train on, made by rule from the word lists, but for themes in ``without``.

    A blocked word blocks as a whole name, beside a shared word, behind or before it, and in the path of a host
    that tells nothing; allowed words stand in all the same places. Sites of reference are allowed with every
    blocked word in their paths, so what a word says depends on where it stands.
    """
    shared = SHARED_WORDS.split()
    words_of = lambda lists: [w for theme, ws in lists.items() if theme not in without for w in ws.split()]
    bad, good = words_of(BLOCKED_WORDS), words_of(ALLOWED_WORDS)
    at = lambda xs, i: xs[i % len(xs)]
    out = []
    for y, words in ((1, bad), (0, good)):
        for i, w in enumerate(words):
            for j in range(7 if y else 5):
                x = at(shared, 5 * i + 3 * j)
                name = (w, f"{w}-{x}", f"{x}-{w}", f"{w}{x}", f"{x}{w}", f"{w}-{at(words, i + 7)}", f"{x}{w}{at(shared, i + 8)}")[j if y else j + 2 * (j == 4)]
                out.append((f"{at(PREFIXES, i + j)}{name}.{at(ENDINGS, i + 2 * j)}", at(PATHS, 2 * i + j), y))
            host = f"{at(PREFIXES, i)}{at(good, 11 * i + 5)}-{at(shared, i)}.{at(ENDINGS, 3 * i)}"
            paths = (f"/{w}/", f"/{w}-{at(shared, i + 4)}", f"/{at(shared, i + 9)}-{w}.html", f"/en/{w}/page-{i % 10}")
            out += [(host, p, y) for p in paths]
    reference = [r for r in REFERENCE if r not in without]
    for i, w in enumerate(bad):
        for j in range(5):
            site = at(reference, 3 * i + 7 * j)
            host = (f"{site}.org", f"en.{site}.org", f"www.city{site}.{at(ENDINGS, i + j)}", f"{at(good, i + j)}-{site}.{at(ENDINGS, i)}", f"{site}.{at(good, 5 * i + j)}.edu")[j]
            out.append((host, at(SUBJECTS, i + j).format(w=w), 0))
    for i, site in enumerate(reference):
        out += [(f"{at(('', 'www.', 'the', 'en.'), i + j)}{site}{at(('', '-online', 'hub', ''), j)}.{at(ENDINGS, i + j)}", at(PATHS, i + 3 * j), 0) for j in range(4)]
    for i, x in enumerate(shared):
        out += [(f"{at(PREFIXES, i + j)}{x}-{at(shared, i + 3 * j + 1)}.{at(ENDINGS, i + j)}", at(PATHS, i + 2 * j), 0) for j in range(4)]
    out += [("", p, 0) for p in PATHS]
    for i, e in enumerate(BLOCKED_ENDINGS):
        out += [(f"{at(good, 9 * i + 2 * j)}-{at(shared, i + j)}.{e}", PATHS[j], 1) for j in range(6)]
    return list(dict.fromkeys(out))


def features(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct hashed character n-grams of each row's host and path, ordered by row.

    Texts are lower-cased, runs of marks become one dot, digits 0, and a dot stands at both ends, so grams tell
    whole words apart. A gram is one feature wherever it stands and, in a host, another one of hosts alone. All texts
    are hashed at once: a polynomial over the bytes, without grams that reach into the next text.
    """
    n, cols, seen = len(hosts), [], []
    for own, texts in ((True, hosts), (False, paths)):
        raw = [f".{_BREAK.sub('.', t.lower())}.".encode("utf-8", "surrogatepass") for t in texts]
        size = np.array([len(x) for x in raw], np.int64)
        b = np.frombuffer(b"".join(raw).translate(_PLAIN), np.uint8).astype(np.uint64)
        row = np.repeat(np.arange(n), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(b))  # bytes from here to the text's end
        h = np.full(len(b), 17, np.uint64)
        for k in range(max(SIZES)):
            h = h[: max(len(b) - k, 0)] * np.uint64(0x100000001B3) + b[k:]
            if k + 1 in SIZES:
                ok = left[: len(h)] > k
                for salt in (0, 0x5851F42D4C957F2D)[: 1 + own]:
                    mixed = (h[ok] ^ np.uint64(salt) ^ (h[ok] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                    cols.append((mixed >> np.uint64(64 - 17)).astype(np.int64))
                    seen.append(row[: len(h)][ok])
    key = np.unique(np.concatenate(seen) * BUCKETS + np.concatenate(cols))
    return key // BUCKETS, key % BUCKETS


def _scores(row: np.ndarray, feature: np.ndarray, n: int, w: np.ndarray, b: float) -> np.ndarray:
    count = np.maximum(np.bincount(row, minlength=n), 1)
    z = np.bincount(row, w[feature], n) / np.sqrt(count) + b
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(rows: list[tuple[str, str, int]], epochs: int = 300, rate: float = 0.3, l2: float = 1e-4, even: float = 1.5) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by AdaGrad over all rows at once. An allowed row weighs ``even``
    times a blocked one: most urls are harmless, so what the table doesn't know is allowed."""
    w, b, n = np.zeros(BUCKETS), 0.0, len(rows)
    g2, b2 = np.full(BUCKETS, 1e-8), 1e-8
    row, feature = features([h for h, _, _ in rows], [p for _, p, _ in rows])
    used, at = np.unique(feature, return_inverse=True)
    y = np.array([x for *_, x in rows], float)
    scale = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1))
    for _ in range(epochs):
        e = (_scores(row, feature, n, w, b) - y) * np.where(y > 0, 1.0, even)
        g = np.bincount(at, (e * scale)[row], len(used)) + l2 * w[used]
        g2[used] += g * g
        b2 += e.sum() ** 2
        w[used] -= rate * g / np.sqrt(g2[used])
        b -= rate * e.sum() / b2**0.5
    return w, float(b)


def probabilities(hosts: Sequence[str], paths: Sequence[str], w: np.ndarray, b: float) -> np.ndarray:
    return _scores(*features(hosts, paths), len(hosts), w, b) if len(hosts) else np.zeros(0)


def probability(host: str, path: str, w: np.ndarray, b: float) -> float:
    return float(probabilities([host], [path], w, b)[0])


@cache
def model() -> tuple[np.ndarray, float]:
    """The model of the whole table, fitted once in a process."""
    return fit(table())


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; without :// (or null): empty."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; host + path names a rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rows: list[tuple[str, str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row of (page_id, url).

    The rule's verdict holds; else block where the model's probability is ``threshold`` or more. A
    null or odd url has empty host and path and gets the model's verdict on those. Repeated rows are
    judged alike; only (host, path) pass to Python, in Arrow batches, and the model (a fixed number
    of weights) goes with the task.
    """
    w, b = model() if rows is None else fit(rows)

    @F.arrow_udf(T.DoubleType())
    def scored(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        keys = list(zip(hosts.to_pylist(), paths.to_pylist()))
        known = {key: i for i, key in enumerate(dict.fromkeys(keys))}
        p = np.zeros(len(known))
        some, first, size = list(known), 0, 0
        for i, (h, q) in enumerate(some, 1):  # about a million characters at a time
            size += len(h) + len(q)
            if size >= 1 << 20 or i == len(some):
                p[first:i] = probabilities([x for x, _ in some[first:i]], [x for _, x in some[first:i]], w, b)
                first, size = i, 0
        return pa.array(p[[known[k] for k in keys]] if keys else [], pa.float64())

    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("__v"), scored("host", "path").alias("p_block"))
    learned = F.when(F.col("p_block") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("__v", learned).alias("verdict"), "p_block")
