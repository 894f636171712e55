"""Token output, packing, rules, classifier, near-duplicates, sampling: edges and brute force."""

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.llm import elias_fano, packing, quality_classifier, quality_rules, queries, simhash_dedup, sp_sampling, text_stats, token_output
from volspark.llm.tokens import WordEncoder, default_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} and, So" for i in range(40_000))
#: Nulls in every column, empty and very long texts, ties, repeated rows, odd characters.
EDGES = [
    (3, "the cat sat on the mat", "en", "s", 22), (1, "the cat sat on the mat", None, None, None), (1, "the cat sat on the mat", None, None, None),
    (2, "", "en", "s", 0), (5, None, "en", "s", None), (None, "only here without an id", None, "s", 1), (-7, " \t\n ", "en", "s", 4),
    (8, "naïve ΣΑΣ İx <|endoftext|> 中文 a\u200bb\x1cc don't 3rd ½", "xx", "s", 9), (9, LONG, "en", "s", len(LONG)), (2**62, "two words", "en", "s", 9),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = {"fp": F.lit(1), "n_tokens": F.lit("x"), "s": F.lit(2), "kept": F.lit(None).cast("string"), "bucket": F.lit(0), "rank": F.lit(0), "score": F.lit("y")}
    return spark.createDataFrame(EDGES, SCHEMA).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    return WordEncoder(default_path()).full


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


# --- Elias-Fano and token output


@pytest.mark.parametrize("n,most", [(0, 0), (1, 0), (1, 9), (600, 3), (2000, 10**9), (3000, 3000)])
def test_elias_fano_round_trip(n, most):
    v = np.sort(np.random.default_rng(n).integers(0, most + 1, n))
    e = elias_fano.encode(v, int(v[-1]) if n else 0)
    assert elias_fano.decode(e).tolist() == v.tolist() == [elias_fano.select(e, i) for i in range(n)]
    if n > 1000:
        assert 8 * (len(e["low"]) + len(e["high"])) <= n * (2 + max(0, math.log2((most + 1) / n)) + 1) + 64
    with pytest.raises(IndexError):
        elias_fano.select(e, n)


def test_word_cache_is_exact_and_bounded(tokenizer):
    enc = WordEncoder(default_path(), cache_words=50)
    texts = [t for _, t, *_ in EDGES if t] + ["x" * 50_000, "İ" * 40, "A'LL 's'T!!"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(enc.encode([t.encode()])[0], enc.dtype).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def expected_tokens(tokenizer, rows):
    start, out = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = ids_of(tokenizer, t)
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_shards_edges(spark, docs, empty, tokenizer):
    found = token_output.read_documents(token_output.write_shards(docs, shard_tokens=40))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected_tokens(tokenizer, [(r[0], r[1]) for r in EDGES]), key=order)
    assert token_output.read_documents(token_output.write_shards(empty)).count() == 0


def test_token_shards_over_the_table(spark, sf_dir, corpus, tokenizer):
    found = [tuple(r) for r in queries.QUERIES["op2_elias_fano_tokens"](spark, sf_dir).orderBy("doc_id").collect()]
    assert found == expected_tokens(tokenizer, [(r.doc_id, r.text) for r in corpus.collect()])


def test_shard_select_reads_one_document():
    docs = [[1, 2, 3], [], [9] * 5]
    s = token_output.Shard(token_output.pack_shard([4, 4, 2**40], [np.array(d, "<u2").tobytes() for d in docs], 2))
    assert [s.tokens(i).tolist() for i in range(3)] == docs and s.doc_ids() == [4, 4, 2**40] and s.bounds(2) == (3, 8)


# --- Packing


def test_bounds_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x = np.sort(rng.choice(60, 9, replace=False)) + 1
        c = rng.integers(1, 20, 9)
        pad = lambda b: sum(n * (min(v for v in b if v >= l) - l) for l, n in zip(x, c))
        best = min(pad((*s, x[-1])) for s in itertools.combinations(x[:-1], 2))
        assert pad(packing.best_bounds(x, c, 3)) == best
    assert packing.best_bounds(np.array([]), np.array([]), 3) == []
    assert packing.best_bounds(np.array([5, 7]), np.array([1, 1]), 9) == [5, 7]


def test_packing_edges(spark, docs, empty, tokenizer):
    counts = packing.token_counts(docs)
    assert Counter(map(tuple, counts.collect())) == Counter((d, len(ids_of(tokenizer, t))) for d, t, *_ in EDGES)
    out = packing.pack(counts, buckets=3, budget=64, run=2).toPandas()
    assert len(out) == len(EDGES) and (out["padding"] >= 0).all()
    for (_, size), part in out.groupby(["bucket", "bucket_len"]):
        room = max(1, 64 // size)
        assert sorted(Counter(part["batch"]).values(), reverse=True)[:-1] == [room] * (part["batch"].nunique() - 1)
        assert set(part["batch"]) == set(range(-(-len(part) // room)))
    assert packing.pack(packing.token_counts(empty)).count() == 0


def test_packing_batches_hold_the_budget(spark, sf_dir):
    out = queries.QUERIES["op4_length_buckets"](spark, sf_dir).toPandas()
    size = out.groupby(["bucket", "batch"]).agg(n=("doc_id", "count"), l=("bucket_len", "first"))
    assert ((size["n"] * size["l"] <= 1 << 16) | (size["n"] == 1)).all()
    assert out["padding"].sum() < 0.2 * out["n_tokens"].sum()


# --- Rules and classifier


def brute_stats(text):
    text = text or ""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
    win = Counter(zip(words, words[1:], words[2:]))
    hit = {j for i in range(len(words) - 2) if win[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_counts_match_brute_force(spark, docs, corpus):
    for df in (docs, corpus.limit(150)):
        rows = df.select("text", text_stats.stats().alias("z")).collect()
        for r in rows:
            assert tuple(r.z[k] for k in text_stats.STATS[:5]) == brute_stats(r.text)
    assert text_stats.repeated_words(b"a b c a b c a b".split()) == 8
    assert text_stats.repeated_words(b"a a a a".split()) == 4


def test_rules_learn_and_spare(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    corpus, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = queries.QUERIES["op3_decision_list"](spark, sf_dir)
    joined = out.join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert len(out.columns) == 8 and out.count() == corpus.count()
    assert joined[joined["quality"] == 1]["kept"].mean() > 0.97
    bad = joined[joined["quality"] == 0]
    assert len(bad) and bad["kept"].mean() < 0.2


def test_rules_are_ordered_conditions():
    rng = np.random.default_rng(0)
    x = rng.random((900, len(quality_rules.RATES)))
    y = ((x[:, 0] > 0.8) | ((x[:, 3] < 0.3) & (x[:, 5] > 0.6))).astype(int)
    rules = quality_rules.learn(x, y)
    caught = np.zeros(900, bool)
    for r in rules:
        caught |= quality_rules._covers(r, x)
    assert (caught == y).mean() > 0.95 and all(len(r) <= 4 for r in rules)
    assert quality_rules.learn(x, np.zeros(900, int)) == [] and quality_rules.learn(x[:0], y[:0]) == []


def test_rules_and_classifier_edges(spark, docs, empty, labels):
    none = labels.limit(0)
    odd = spark.createDataFrame([(1, None, 1), (None, 0, 0), (3, 1, 0), (3, 0, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    for lab in (none, odd):
        rules, trees = quality_rules.fit(docs, lab), quality_classifier.fit(docs, lab)
        judged = quality_rules.judge(docs, rules).collect()
        assert Counter(r.doc_id for r in judged) == Counter(r[0] for r in EDGES)
        assert all(r.base_failed and not r.kept for r in judged if r.s.n_words < 50)
        scored = quality_classifier.classify(docs, trees).collect()
        assert len(scored) == len(EDGES) and all(0 <= r.score <= 1 for r in scored)
        assert quality_rules.keep(docs, rules).columns == docs.columns == quality_classifier.keep(docs, trees).columns
    assert quality_rules.judge(empty, []).count() == 0 and quality_classifier.classify(empty, trees).count() == 0


def test_classifier_accuracy_on_held_out_rows(spark, sf_dir, labels):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    out = queries.QUERIES["op10_boosted_trees"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(d).encode()) % 4 == 2 for d in out["doc_id"])
    assert (out["predicted"] == out["quality"]).mean() > 0.93 and (out["predicted"] == (out["score"] >= 0.7)).all()


def test_trees_traverse_as_one_by_one():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    t = quality_classifier.fit_trees(x, y, trees=40, depth=3)
    assert ((t.score(x) > 0.5) == y).mean() > 0.9
    for i in range(5):
        total = t.start
        for f, th, v in zip(t.feature, t.threshold, t.value):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (x[i, f[k]] > th[k])
            total += v[k - len(f)]
        assert t.score(x[i : i + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


# --- Near-duplicates


def brute_components(pairs_of, items):
    root = {i: i for i in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs_of:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    fps = {0, -1, -(2**63), 2**63 - 1, *base}
    for b in base[:25]:
        for k in (1, 2, 3, 4, 5):
            m = sum(1 << int(i) for i in rng.choice(64, k, replace=False))
            fps.add(int(np.array((b & (1 << 64) - 1) ^ m, np.uint64).view(np.int64)))
    want = {(a, b) for a, b in itertools.combinations(sorted(fps), 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    found = simhash_dedup.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert {tuple(r) for r in found.collect()} == want and len(want) > 60
    with pytest.raises(ValueError):
        simhash_dedup.links(found, 4)


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(200, 201)]
    df = spark.createDataFrame(edges, "a long, b long")
    want = brute_components(edges, {x for e in edges for x in e})
    assert {tuple(r) for r in simhash_dedup.components(df).collect()} == set(want.items())
    assert simhash_dedup.components(df.limit(0)).count() == 0


def test_near_duplicates_edges(spark, docs, empty):
    rows = simhash_dedup.near_duplicates(docs).select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("h"), "component_id").collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(EDGES) and by[1].component_id == by[3].component_id == 1
    assert by[2].h == by[5].h == by[-7].h == "0" * 16 and by[5].component_id == -7
    assert by[None].component_id is None
    assert simhash_dedup.near_duplicates(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, -7, None, 8, 9, 2**62])


def test_near_duplicates_equal_brute_force(spark, sf_dir, corpus):
    text = {r.doc_id: r.text for r in corpus.collect()}
    fp = {d: simhash_dedup.fingerprint(t.encode()) for d, t in text.items()}
    ids = sorted(fp)
    arr = np.array([fp[i] for i in ids], np.uint64)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3) if j > i]
    want = brute_components(pairs, ids)
    found = queries.QUERIES["op8_simhash_dedup"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in found} == {d: (f"{fp[d]:016x}", want[d]) for d in ids}


def test_fingerprint_equals_sparks_hash(spark):
    words = [f"w{i}" for i in range(9)]
    shingles = [" ".join(words[i : i + 3]) for i in range(7)]
    h = [r[0] & (1 << 64) - 1 for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 7)
    assert simhash_dedup.fingerprint(" ".join(words).upper().encode()) == want


# --- SentencePiece sampling


@pytest.fixture(scope="module")
def lattices():
    return sp_sampling.Lattices(sp_sampling.default_path())


def enumerate_unit(lattices, unit):
    first, _, logp, to = lattices.arrays()
    out = {}

    def go(node, lp, path):
        if first[node] == first[node + 1]:
            out[path] = lp
        for e in range(first[node], first[node + 1]):
            go(to[e], lp + logp[e], (*path, e))

    go(lattices.unit[unit], 0.0, ())
    return out


def test_samples_follow_the_law_without_replacement(lattices):
    unit = lattices.units("abc")[0]
    lattices.add([unit])
    p = {k: math.exp(v) for k, v in enumerate_unit(lattices, unit).items()}
    assert sum(p.values()) == pytest.approx(1)
    n = 20_000
    keys = np.array([sp_sampling.row_key(1, i, b"") for i in range(n)], np.uint64)
    found = sp_sampling.sample_many([np.array([lattices.unit[unit]])] * n, keys, lattices.arrays(), 2)
    pairs = Counter((tuple(x[0][0].tolist()), tuple(x[1][0].tolist())) for x in found)
    assert all(a != b for a, b in pairs) and all(x[0][2] >= x[1][2] >= x[2][2] for x in found)
    for (a, b), c in pairs.most_common(3):
        want = p[a] * p[b] / (1 - p[a])
        assert abs(c / n - want) < 5 * math.sqrt(want * (1 - want) / n)


def test_inclusion_scores_estimate_a_sum(lattices):
    """Sum over samples of p / inclusion is an unbiased estimate of 1."""
    keys = np.arange(4000).astype(np.uint64)
    found = sp_sampling.sample_texts(lattices, ["abcde"] * 4000, keys, 3)
    total = np.mean([sum(math.exp(lp) / inc for _, lp, _, inc in rows) for rows in found])
    assert total == pytest.approx(1, abs=0.05)


def test_sampling_edges(spark, docs, empty, lattices):
    rows = sp_sampling.sample_segmentations(docs, k=3).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r["sample"]), []).append(r)
    assert [len(by.get((2, i), [])) for i in (1, 2, 3)] == [1, 0, 0] and by[2, 1][0].ids == [] and by[2, 1][0].inclusion == 1.0
    assert by[1, 1][0] == by[1, 1][1]  # repeated rows draw alike
    text = dict((d, t) for d, t, *_ in EDGES)
    for (d, _), some in by.items():
        assert lattices.sp.decode(some[0].ids) == (text[d] or "") or d == -7
    for d in (3, 8, 9):
        assert len({tuple(by[d, i][0].ids) for i in (1, 2, 3)}) == 3
    again = sp_sampling.sample_segmentations(docs.repartition(7), k=3).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))
    assert sp_sampling.sample_segmentations(empty).count() == 0


def test_encode_and_decode_round_trip(spark, docs, empty):
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = sp_sampling.decode(sp_sampling.encode(docs))
    want = Counter((d, t or "") for d, t, *_ in EDGES)
    assert Counter(map(tuple, back.collect())) == want == Counter(map(tuple, texts.collect()))
    assert sp_sampling.decode(sp_sampling.encode(empty)).count() == 0
