"""Whole results where an operator once gave less: similar texts, exact lengths, repeated ids, lost text."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from volspark.llm import html_extract, packing, shingle_join, simhash_dedup, text_stats, va_search

SCHEMA = "doc_id long, text string"

# --- Near-duplicates of the pipeline


def jaccard(a, b):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def groups(rows):
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if jaccard(a, b) >= 0.8:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in rows}


def varied(rng, n, copies, changes, first):
    base = [f"w{x}" for x in rng.integers(0, 10_000, n)]
    out = []
    for c in range(copies):
        words = list(base)
        for i in rng.choice(n, changes, replace=False):
            words[i] = f"x{rng.integers(0, 10_000)}"
        out.append((first + c, " ".join(words)))
    return out


def test_pipeline_stage_joins_similar_texts(spark, sf_dir):
    import corpus_pipeline as cp

    rng = np.random.default_rng(3)
    rows = [r for g in range(6) for r in varied(rng, 150, 4, 1, 10 * g)] + varied(rng, 200, 60, 2, 1000)
    rows += [(900, "one two three"), (901, "ONE two\nthree"), (902, "one two four"), (903, ""), (904, " "), (905, "a b c d e")]
    want = {i for i, r in groups(rows).items() if i == r}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id for r in cp.near_duplicates(spark, df, sf_dir).collect()} == want
    thin = {r.doc_id for r in simhash_dedup.keep_one(df).collect()}
    assert len(want) < len(thin)  # copies that three bits of 64 do not reach
    assert cp.near_duplicates(spark, df.limit(0), sf_dir).count() == 0


def test_pipeline_stage_equals_brute_force_over_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = {i for i, r in groups(rows).items() if i == r}
    assert {r.doc_id for r in shingle_join.keep_one(docs).collect()} == want


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(5)
    rows = varied(rng, 150, 1, 0, 1) * 2 + varied(rng, 150, 1, 0, 2) + [(2, "a text of its own kind")]
    rows = [(1, rows[0][1]), (2, rows[0][1]), *rows[1:], (None, rows[0][1]), (None, "without an id"), (None, "without an id")]
    want = sorted({t for _, t in rows})
    df = spark.createDataFrame(rows, SCHEMA)
    for stage in (simhash_dedup.keep_one, shingle_join.keep_one):
        assert sorted(r.text for r in stage(df).collect()) == want
    labels = spark.createDataFrame([(i, 1) for i in range(1, 9)], "doc_id long, quality int")
    sample = text_stats.labelled_sample(df, labels, "quality", 10).collect()
    assert len(sample) == len({r.doc_id for r in sample}) > 0


def test_kept_row_is_one_whatever_the_order_of_rows(spark):
    rows = [(1, "a b c d e f", "x"), (1, "A b  c d e f", "y"), (1, "A b  c d e f", "x"), (2, "words of its own kind here", "x"), (None, "nobody has named this text", "x"), (None, "nobody has named THIS text", "y")]
    for keep in (simhash_dedup.keep_one, shingle_join.keep_one):
        found = [sorted(map(str, keep(spark.createDataFrame(r, "doc_id long, text string, lang string").coalesce(1)).collect())) for r in (rows, rows[::-1])]
        assert found[0] == found[1] and len(found[0]) == 3


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "A b c d e f"), (2, "words of its own kind here")], "doc_id long, text string")
    docs = docs.select(F.lit(1).alias("a.b"), "doc_id", "text", F.create_map(F.lit("k"), F.lit(2)).alias("a`b"))
    for name, stage in cp.STAGES[:3]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    assert sorted((r["a.b"], r["doc_id"], r["a`b"]["k"]) for r in cp.near_duplicates(spark, docs, sf_dir).collect()) == [(1, 1, 2), (1, 2, 2)]


# --- Packing


def test_bounds_are_real_lengths_and_optimal_above_1024(spark):
    lengths = [3, 3, 7, 1025, 1025, 1030, 2049, 2051, 29_999, 30_001]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    out = packing.pack(df, buckets=4).toPandas()
    x = sorted(set(lengths))
    best = min(sum(min(v for v in (*s, x[-1]) if v >= n) - n for n in lengths) for s in itertools.combinations(x[:-1], 3))
    assert set(out["bucket_len"]) <= set(x) and out["padding"].sum() == best
    alone = packing.pack(df.where("n_tokens = 1025")).collect()
    assert {(r.bucket_len, r.padding) for r in alone} == {(1025, 0)}


# --- Vector search


def test_copies_of_an_id_take_one_place(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(z) for z in rng.normal(0, 0.2, 6)]) for i in range(80)]
    hot = [1.0] * 6
    rows += [(500, hot)] * 40 + [(501, [0.9] * 6)] * 7 + [(500, [0.1 * i] * 6) for i in range(5)] + [(0, hot)] * 9
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(900, hot), (500, hot), (0, hot)], "vec_id long, embedding array<float>")
    exact = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    want = set()
    for qid in (900, 500, 0):
        best = {}
        for i, v in exact:
            if i != qid:
                best[i] = max(best.get(i, -(10**9)), int((v * np.full(6, 256.0)).sum()))
        top = sorted(best.items(), key=lambda z: (-z[1], z[0]))[:5]
        want |= {(qid, r + 1, i, s) for r, (i, s) in enumerate(top)}
    for page in (16, 2048):
        assert {tuple(r) for r in va_search.search(df, asked, page=page).collect()} == want


# --- HTML extraction


def test_article_keeps_what_stands_beside_its_inner_container(spark):
    lead, long = "A lead paragraph that says in sixty characters what comes next.", "many words of the text " * 90
    inner = f"<article><h1>The heading</h1><p>{lead}</p><div class='entry-content'><p>{long}</p></div><p>A last line.</p></article>"
    nested = f"<article><h1>Top</h1><section class='a'><div><p>{long}</p></div></section><section class='b'><div><p>{lead}</p></div></section></article>"
    posts = f"<div class='post'><h1>Name</h1><div class='entry-content'><p>{long}</p></div></div><div class='teasers'><p>{lead}</p></div>"
    links = f"<main><p>{lead}</p><div class='text'><p>{long}" + "<a href='/x'>a linked phrase</a> and words " * 200 + "</p></div></main>"
    rows = [(1, "http://a.com/1", inner), (2, "http://a.com/2", inner), (3, "http://b.com/", nested), (4, "http://c.com/", posts), (5, "http://d.com/", links)]
    df = spark.createDataFrame([(i, u, f"<body><nav>Menu</nav><div class='wrap'>{h}</div></body>") for i, u, h in rows], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert found[1] == found[2] == f"The heading {lead} {long.strip()} A last line."
    assert found[3] == f"Top {long.strip()} {lead}" and found[4] == f"Name {long.strip()}"
    assert found[5].startswith(lead) and found[5].endswith("and words")
