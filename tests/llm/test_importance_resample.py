"""Importance resampling against SQL and a plain version with whole dictionaries."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from volspark.llm import importance_resample as ir
from volspark.llm import queries

SCHEMA = "doc_id long, text string"


def grams(text, most):
    b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", b)
    return w, [b" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ9 .-\né你\x00\x7f", max_size=60), max_size=12), st.integers(1, 4), st.sampled_from([0, 3, 1000]))
def test_features_equal_plain_crcs(texts, most, held):
    words = ir.Dictionary(held)
    words._learn = lambda: words.grow() if words.new and words.held < words.most else None  # after every text
    for t in texts:
        w, want = grams(t, most)
        n, got = ir.features(t.encode(), most, 997, words)
        assert n == len(w) and got.tolist() == [zlib.crc32(g) % 997 for g in want]


def test_long_texts_and_words_are_whole():
    rng = np.random.default_rng(1)
    text = " ".join(f"W{x}" for x in rng.integers(0, 3000, 200_000)) + " " + "y" * 700_000 + " é" * 1000 + " z" * 3
    words = ir.Dictionary(500)
    for _ in range(2):
        w, want = grams(text, 2)
        n, got = ir.features(text.encode(), 2, 10_000, words)
        assert n == len(w) and got.tolist() == [zlib.crc32(g) % 10_000 for g in want]
    assert 0 < words.held <= 500


def plain(docs, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    feats = [[zlib.crc32(g) % buckets for g in grams(t, most)[1]] for _, t in docs]
    s, t = Counter(b for f in feats for b in f), Counter(zlib.crc32(g) % buckets for x in target for g in grams(x, most)[1])
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    out = []
    for (i, text), f in zip(docs, feats):
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(grams(text, 1)[0]), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    drawn = sorted((-r[4], r[0] is None, r[0] or 0, k) for k, r in enumerate(out) if r[1] >= least)
    rank = {k: n for n, (*_, k) in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return [(*r, rank.get(k)) for k, r in enumerate(out)]


def key(r):
    return [(x is None, x or 0) for x in r]


def test_resample_equals_plain_version(spark):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 40 + i, 15 + i))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "—"), (103, " .,; "), (None, "w1 W2 w3 " * 9), (None, None), (5, docs[5][1]), (104, "x" * 300 + " y" * 40)]
    target = [(1, "w1 w2 w3 w4 w5"), (2, None), (3, "")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id", "text", "'a' AS bucket", "1 AS n", "2 AS rank", "3 AS place")
    goal = spark.createDataFrame(target, SCHEMA).selectExpr("doc_id AS item_id", "text", "0 AS n")
    for most, percent, least in ((1, 10, 20), (3, 50, 20), (2, 100, 0), (1, 1, 20)):
        got = [tuple(r) for r in ir.resample(df, goal, most, 500, percent, least).collect()]
        want = plain(docs, [t for _, t in target], most, 500, percent, least)
        assert sorted(got, key=key) == sorted(want, key=key)
    empty = ir.resample(df, goal.limit(0), 1, 500, 10, 20).collect()
    assert sorted(map(tuple, empty), key=key) == sorted(plain(docs, [], 1, 500), key=key)
    assert ir.resample(df.limit(0), goal).count() == 0


def test_query_equals_oracle(spark, sf_dir):
    got = queries.QUERIES["op12_importance_resample"](spark, sf_dir).toPandas()
    assert_same(got, queries.SQL["op12_importance_resample"], sf_dir)
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    found = {r.doc_id: (r.n_features, r.weight, r.score, None if r.rank != r.rank else int(r.rank)) for r in got.itertuples()}
    assert found == {i: (m, w, x, k) for i, _, m, w, x, k in want} and sum(r[-1] is not None for r in want) >= 10
