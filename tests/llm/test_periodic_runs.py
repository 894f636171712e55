"""Periodic runs against a scan of all periods."""

import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from volspark.llm import periodic_runs, queries

SCHEMA = "doc_id long, text string"


def all_runs(words, least=12):
    """Every maximal stretch by its least period, from all periods and places."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in found.items() if n >= max(least, 2 * q)], key=lambda r: (r[0], r[2]))


def without_repeats(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


TEXTS = st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=4)


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([2, 5, 12, 30]))
def test_runs_equal_all_periods(texts, least):
    assert periodic_runs.runs_of_texts(texts, least) == [all_runs(t, least) for t in texts]


def test_runs_of_periodic_and_fibonacci_texts():
    a, b = "a", "ab"
    while len(b) < 400:
        a, b = b, b + a
    rng = random.Random(4)
    texts = [list(b), ["x"] * 300, list(b) * 2, [rng.choice("abcdefgh") for _ in range(7)] * 40 + ["end"], [], ["x"] * 11, ["x"] * 12]
    for text, runs in zip(texts, periodic_runs.runs_of_texts([[w.encode() for w in t] for t in texts])):
        assert runs == all_runs(text)
    assert periodic_runs.runs_of_texts([[b"x"] * 100_000]) == [[(0, 100_000, 1)]]


def digest(rows):
    out = {}
    for r in rows:
        w = (r.text or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n and r.doc_id is not None:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = all_runs(w)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        milli = 1000 * top[1] // top[2] if runs else None
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        out.setdefault(r.doc_id, []).append((len(runs), *top, milli, sha(text.encode()), sha(b" ".join(without_repeats(w, runs)))))
    return out


def by_id(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.doc_id, []).append(tuple(r)[1:])
    return out


def test_query_equals_all_periods_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    short = docs.where("length(text) < 6000 OR text IS NULL")  # the scan of all periods is quadratic
    ids = {r.doc_id for r in short.collect()}
    got = by_id(queries.QUERIES["op13_periodic_runs"](spark, sf_dir))
    assert set(got) == {r.doc_id for r in docs.collect()} and sum(x[0][0] > 0 for x in got.values()) > 10
    want = digest(short.collect())
    assert {i: got[i] for i in ids} == want


def test_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (None, "a b " * 20), (None, None), (5, "x " * 12), (5, "x " * 12), (6, "x " * 11)]
    rows += [(7, "é ß 你 " * 9), (-8, "no run at all"), (9, " ".join(f"w{i % 4000}" for i in range(10_000))), (10, "b\u00a0c " * 15)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'z' AS runs", "1 AS n_words", "array(1) AS collapsed")
    found = {}
    for r in periodic_runs.detect(df).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert [len(r.runs) for r in found[1] + found[2] + found[3] + found[4] + found[6]] == [0] * 5
    assert found[1][0].collapsed == "" and found[3][0].n_words == 0 and len(found[5]) == 2 and len(found[None]) == 2
    assert tuple(found[5][0].runs[0]) == (0, 12, 1) and found[5][0].collapsed == "x"
    assert tuple(found[7][0].runs[0]) == (0, 27, 3) and found[7][0].collapsed == "é ß 你"
    assert tuple(found[9][0].runs[0]) == (0, 10_000, 4000) and len(found[9][0].collapsed.split()) == 4000
    assert tuple(found[10][0].runs[0]) == (0, 15, 1)
    assert periodic_runs.detect(df.limit(0)).count() == 0
    spark.createDataFrame([r for r in rows if r[0] != 9], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert by_id(queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)))[2] == digest(spark.createDataFrame([(2, "")], SCHEMA).collect())[2]
