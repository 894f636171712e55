"""HyperMinHash near-duplicates against all pairs; crowded bands stay linear."""

import itertools

import numpy as np
import pytest

from volspark.llm import hyper_minhash as hm
from volspark.llm import queries, shingle_join

SCHEMA = "doc_id long, text string"


def grams(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def all_pairs(rows, top=85, bottom=100, alike=False):
    """id -> (set size, least id reachable) by comparing all pairs of distinct sets."""
    sets = {}
    for i, t in rows:
        sets.setdefault(frozenset(grams(t)), []).append(i)
    keys = sorted(sets, key=len)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations([k for k in keys if k], 2):
        if bottom * len(a) >= top * len(b) and bottom * len(a & b) >= top * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for k in keys:
        least.setdefault(find(k), []).extend(sets[k])
    return {i: (len(k), min(least[find(k)]) if k or alike else i) for k in keys for i in sets[k]}


def test_registers_keep_leading_zeros_and_mantissa():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 100, 3000):
        x = rng.integers(0, 1 << 64, n, np.uint64)
        got = hm.registers(x)
        for band in (0, 31):
            g = [int(v) for v in (x ^ hm._ODD[0][band]) * hm._ODD[1][band]]
            width = (1 << 64) // 6
            for b in range(6):
                own = [v - b * width for v in g if v // width == b]
                want = 0
                if own:
                    v = min(own)
                    bits = f"{v:062b}"
                    zeros = len(bits) - len(bits.lstrip("0"))
                    want = (zeros + 1) << 10 | int((bits[zeros + 1 :] + "0" * 10)[:10], 2) if v else None
                assert want is None or got[band, b] == want


def test_estimates_are_near_and_bands_meet():
    rng = np.random.default_rng(1)
    for n, own in ((6, 1), (40, 3), (400, 30), (4000, 320)):
        shared = rng.integers(0, 1 << 64, n, np.uint64)
        met, found = 0, []
        for _ in range(60):
            a, b = (np.concatenate([shared, rng.integers(0, 1 << 64, own if i else 0, np.uint64)]) for i in (0, 1))
            u, v = hm.registers(a), hm.registers(b)
            met += bool((hm.bands(u) == hm.bands(v)).any())
            found.append(hm.estimate(u.reshape(1, -1), v.reshape(1, -1), np.array([len(a)]), np.array([len(b)]))[0][0])
            assert hm._likely(np.array([len(a)]), np.array([len(b)]), *(hm.pa.array([x.tobytes()]) for x in (u, v)))[0]
        assert met == 60 and abs(np.mean(found) - n / (n + own)) < 0.03
    lone = [hm.registers(rng.integers(0, 1 << 64, 500, np.uint64)).reshape(1, -1) for _ in range(20)]
    assert max(abs(hm.estimate(a, b, np.array([500]), np.array([500]))[0][0]) for a, b in itertools.combinations(lone, 2)) < 0.03


def varied(rng, n, copies, changes, first, words=10_000):
    base = [f"w{x}" for x in rng.integers(0, words, n)]
    out = []
    for c in range(copies):
        new = list(base)
        for i in rng.choice(n, changes, replace=False):
            new[i] = f"x{rng.integers(0, 10**9)}"
        out.append((first + c, " ".join(new)))
    return out


def test_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = [r for g in range(8) for r in varied(rng, 150, 4, g % 4, 10 * g)] + varied(rng, 200, 90, 2, 1000) + varied(rng, 100, 120, 3, 2000)
    rows += [r for n in range(5, 40) for r in varied(rng, n, 2, 1, 3000 + 10 * n)]
    tail = [f"t{i}" for i in range(40)]
    rows += [(5000 + i, " ".join(tail[: 40 - i])) for i in range(36)]  # chains of prefixes
    rows += [(900, "one two three"), (901, "ONE two\nthree"), (902, "one two four"), (903, ""), (904, " "), (905, None), (906, "É a b c"), (907, "é a b c")]
    rows += [(950, rows[0][1].upper()), (3, rows[3][1])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id", "text", "'x' AS key", "1 AS n", "2 AS root", "3 AS component_id")
    want = all_pairs(rows)
    got = hm.near_duplicates(df).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and hm.near_duplicates(df.limit(0)).count() == 0
    odd = hm.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, None), (4, "a b c"), (None, "d e f")], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in odd) == [(-1, -1, True), (-1, -1, True), (-1, 4, False), (4, 4, True)]


@pytest.mark.parametrize(("rule", "sizes", "run"), [(shingle_join.RULE, (200, 400), shingle_join.near_duplicates), (hm.RULE, (250,), hm.near_duplicates)])
def test_crowded_bands_stay_linear(spark, monkeypatch, rule, sizes, run):
    """Texts of one template, alike but not enough, with a few near copies among them."""
    rng = np.random.default_rng(5)
    template = [f"s{i}" for i in range(300)]
    pairs = []
    real = shingle_join.likely
    monkeypatch.setattr(shingle_join, "likely", lambda p, *a: (pairs.append(p.count()), real(p, *a))[1])
    own, compared = 60, []
    for n in sizes:
        rows = [(i, " ".join([*template, *[f"o{x}" for x in rng.integers(0, 10**9, own)]])) for i in range(n)]
        rows += [(1000 + i, rows[7 * i][1] + f" e{i}") for i in range(10)]
        pairs.clear()
        found = run(spark.createDataFrame(rows, SCHEMA)).collect()
        compared.append(sum(pairs))
        want = all_pairs(rows, rule.top, rule.bottom)
        if run is hm.near_duplicates:
            assert {r.doc_id: r.component_id for r in found} == {i: c for i, (_, c) in want.items()}
        else:
            one = {}
            for r in found:
                one.setdefault(r.root, set()).add(r.doc_id)
            two = {}
            for i, (_, c) in want.items():
                two.setdefault(c, set()).add(i)
            assert sorted(map(sorted, one.values())) == sorted(map(sorted, two.values()))
    assert all(b < 2.5 * a for a, b in zip(compared, compared[1:])) and compared[-1] < 64 * sizes[-1]


def test_query_equals_all_pairs_over_the_table(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = queries.QUERIES["op11_hyper_minhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == all_pairs(rows) and len(got) == len(rows)
