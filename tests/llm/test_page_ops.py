"""Vector search, URL filter, HTML extraction, chat snapshots and the pipeline."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import assert_same
from test_whole_job import groups
from volspark.llm import chat_format, html_extract, queries, url_filter, va_search

# --- Vector search


def brute_search(rows, queries_, k):
    good = [(i, np.floor(256 * np.array(v, float)).astype(object)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = set()
    for qid, q in [g for g in good if g[0] in queries_]:
        best = {}
        for i, v in good:
            if i != qid and len(v) == len(q):
                best[i] = max(best.get(i, -(10**30)), int((v * q).sum()))
        top = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out |= {(qid, r + 1, i, s) for r, (i, s) in enumerate(top)}
    return out


def test_search_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 5)]) for i in range(60)]
    rows += [(60, None), (61, []), (62, [1.0, None, 1.0, 1.0, 1.0]), (63, [float("nan")] * 5), (64, [float("inf")] * 5), (None, [1.0] * 5)]
    rows += [(65, rows[0][1]), (66, rows[0][1]), (67, [1.0, 2.0]), (100, [0.5, -0.5]), (68, [300.0, -200.0, 1.0, 0.0, 5.0]), (69, [0.0] * 5), (70, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"n": F.lit("x"), "ids": F.lit(0), "dim": F.lit(1)})
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for page in (4, 2048):
        found = va_search.search(df, df.where("vec_id % 10 = 0"), k=3, page=page, block=3)
        want = brute_search(rows, {i for i, _ in rows if i is not None and i % 10 == 0}, 3)
        assert {tuple(r) for r in found.collect()} == want
    assert va_search.search(df.limit(0), df, k=3).count() == 0 and va_search.search(df, df.limit(0), k=3).count() == 0


def test_search_equals_oracle(spark, sf_dir):
    assert_same(queries.QUERIES["op1_va_search"](spark, sf_dir).toPandas(), queries.SQL["op1_va_search"], sf_dir)


def test_bounds_spare_exact_reads():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 60, (20, 32))
    v = np.floor(centre[rng.integers(0, 20, 2000)] + rng.normal(0, 6, (2000, 32))).astype(np.int64)
    ids = np.arange(2000)
    low, width, cells = va_search.quantise(v, 6)
    assert ((v >= low + cells * width) & (v < low + (cells + 1) * width)).all()
    read = [r for *_, r in va_search.search_page(ids, v, low, width, cells, ids[:50], v[:50], 5)]
    assert np.mean(read) < 400


# --- URL filter

URLS = [
    (1, "http://WWW.Example.com/en/7?x#y", "example.com/en/7", "allow"), (2, "https://example.com/en/8", "com/en/", "block"), (3, "https://a.example.net/de/81", "example.net/de/8", "block"),
    (4, "x://b.net/de/", "net/de/", "allow"), (5, "http://q.org/es/1", "org/es/", "block"), (6, None, None, "allow"), (7, "no scheme", None, "allow"), (8, "http://notnet/de/", None, "allow"),
    (9, "http://www.casino-win.test/fr/1", None, "block"), (10, "https://cheap-pills.example.io/a", None, "block"), (11, "http://daily-gardening.org/news", None, "allow"), (12, "", None, "allow"),
    (13, "http://com/en/", "com/en/", "block"), (14, "http://x.com?u=/en/", None, "allow"), (15, "http://" + "a" * 5000 + ".org/", None, "allow"), (None, "http://free-bets.info#/en/", None, "block"),
]


def test_url_rules_and_model(spark):
    df = spark.createDataFrame([(i, u) for i, u, *_ in URLS] + [(1, URLS[0][1])], "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "rule": F.lit(3)})
    found = url_filter.judge(df).collect()
    by = {r.page_id: r for r in found}
    assert len(found) == len(URLS) + 1
    for i, _, rule, verdict in URLS:
        assert (by[i].rule, by[i].verdict) == (rule, verdict), i
    assert (by[1].host, by[1].path) == ("www.example.com", "/en/7") and (by[6].host, by[6].path) == ("", "") == (by[7].host, by[7].path)
    assert (by[14].host, by[14].path) == ("x.com", "") and url_filter.judge(df.limit(0)).count() == 0


def test_url_model_on_rows_left_out():
    rows = url_filter.table()
    w, b = url_filter.fit(rows)
    assert np.mean([(url_filter.probability(h, p, w, b) >= 0.5) == y for h, p, y in rows]) == 1.0
    names = sorted({r[0].removeprefix("www.").removeprefix("blog.").removeprefix("m.") for r in rows})
    right = total = 0
    for fold in range(3):
        out = set(names[fold::3])
        base = lambda h: h.removeprefix("www.").removeprefix("blog.").removeprefix("m.")
        w, b = url_filter.fit([r for r in rows if base(r[0]) not in out], epochs=20)
        for h, p, y in rows:
            if h in out:
                right += (url_filter.probability(h, p, w, b) >= 0.5) == y
                total += 1
    assert right / total > 0.7


# --- HTML extraction

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<div class="wrap"><div class="post-content"><h1>The   title</h1><p>First <b>bold</b>&nbsp;words &lt;here&gt; and much more text that goes on<br>and on.<p>Second paragraph with caf&eacute; &#x263A; text, long enough to be counted as a block of the article.
<div class="ad">Buy now</div><ul><li>An item of the article list</li></ul><form><p>Subscribe</p><input></form></div><aside><p>Related stories that are long enough to be blocks too</p></aside>
<section id="comments"><p>A reader's comment that is very long, longer than any of the paragraphs of the article itself, and goes on and on and on.</p></section></div><footer>&copy; us</footer></body></html>"""
TEXT = "The title First bold words <here> and much more text that goes on and on. Second paragraph with café ☺ text, long enough to be counted as a block of the article. An item of the article list"


def test_article_without_the_rest():
    found, nodes = html_extract.blocks(PAGE)
    best = html_extract.scores(found, nodes)
    assert html_extract.page_text(PAGE, None) == TEXT
    assert max(best, key=best.get).endswith("/div.post-content")


def test_host_vote_overrules_a_page(spark):
    def page(side, main):
        return f"<body><div class='teasers'><p>{side}</p></div><div class='story'><p>{main}</p></div></body>"

    long, short = "many words of text " * 20, "few words of the story here"
    rows = [(i, "http://h.com/a", page("tiny", long)) for i in range(5)] + [(9, "http://h.com/b", page(long, short)), (10, None, None), (11, "http://k.com/", ""), (12, None, "<p>loose text without any container</p>")]
    rows += [(13, "http://h.com/c", "<nav>all menu</nav>"), (14, "http://h.com/d", "<p>" + "x &amp; " * 100_000 + "</p>"), (0, "http://h.com/a", page("tiny", long)), (15, "http://z.com", "<div><p>cut of")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"path": F.lit(1), "host": F.lit(2), "text": F.lit("t")})
    found = Counter((r.page_id, r.text) for r in html_extract.extract(df).collect())
    want = Counter([(i, long.strip()) for i in (0, 0, 1, 2, 3, 4)] + [(9, short), (10, ""), (11, ""), (12, "loose text without any container"), (13, ""), (14, ("x & " * 100_000).strip()), (15, "cut of")])
    assert found == want
    assert html_extract.extract(df.limit(0)).count() == 0
    assert Counter((r.page_id, r.text) for r in html_extract.extract(df, broadcast_hosts=0).collect()) == want


def test_extraction_over_the_table(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries.QUERIES["op7_consensus_html"](spark, sf_dir).collect():
        h = pages[r.page_id]
        body = h[h.index("<article>") : h.index("</article>")]
        assert r.text == " ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", " ", body)).split()) and r.n_chars == len(r.text)


# --- Chat snapshots


def test_snapshots_edges(spark):
    turns = lambda c, texts, start=0: [(c, start + i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(texts)]
    rows = turns(1, ["a", "b"]) + turns(2, ["a", "b", "c", "d"]) + turns(3, ["a", "x"]) + turns(4, ["a", "b", "c", "d"]) + turns(5, ["a", "b", "c"], 10)
    rows += [(6, None, None, None), (7, 0, "user", None), (8, 0, "user", ""), (None, 0, "user", "a"), (9, 0, "user", "z"), (9, 0, "user", "z"), (9, 0, "user", "y")]
    rows += turns(20, [f"t{i}" for i in range(700)]) + turns(21, [f"t{i}" for i in range(699)]) + turns(22, ["L" * 200_000])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"rank": F.lit(0), "n": F.lit(1), "part": F.lit("x"), "run": F.lit(2)})
    out = chat_format.render(df).collect()
    assert {r.conv_id for r in out} == {2, 3, 6, 7, 8, 9, 20, 22}
    by = {(r.conv_id, r.part): r for r in out}
    assert by[2, 0].text == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user|>\nc<|end|>\n<|assistant|>\nd<|end|>\n" and by[9, 0].n_turns == 2
    assert [by[20, i].n_turns for i in range(3)] == [256, 256, 188] and by[6, 0].text == "<|user|>\n<|end|>\n"
    whole = "".join(by[20, i].text for i in range(3))
    assert whole.count("<|end|>") == 700 and whole.index("t698<") < whole.index("t699<")
    assert chat_format.render(df.limit(0)).count() == 0


def test_snapshots_equal_oracle(spark, sf_dir):
    assert_same(queries.QUERIES["op6_snapshot_collapse"](spark, sf_dir).toPandas(), queries.SQL["op6_snapshot_collapse"], sf_dir)


# --- Pipeline


def least_padding(n, buckets):
    """Of all ways to cut sorted lengths into ``buckets`` runs, the least padding up to each run's longest."""
    best = {0: 0}
    for _ in range(buckets):
        new = {}
        for j in range(1, len(n) + 1):
            new[j] = min(best[i] + (j - i) * n[j - 1] - sum(n[i:j]) for i in range(j) if i in best) if any(i in best for i in range(j)) else None
        best = {j: c for j, c in (best | {j: c if j not in best else min(c, best[j]) for j, c in new.items() if c is not None}).items()}
    return best[len(n)]


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline as cp
    from volspark.llm import packing, quality_classifier, quality_rules

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    left = {r.doc_id for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).where("kept").collect()}
    second = docs.where(F.col("doc_id").isin(*left))
    left = {r.doc_id for r in quality_classifier.classify(second, quality_classifier.fit(second, labels)).where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in second.collect() if r.doc_id in left}
    kept = {i for i, root in groups(sorted(texts.items())).items() if i == root}
    out = cp.run(spark, sf_dir).toPandas()
    assert set(out["doc_id"]) == kept and len(out) == len(kept) < len(texts)
    lengths = {r.doc_id: r.n_tokens for r in packing.token_counts(docs).collect()}
    assert {r.doc_id: r.n_tokens for r in out.itertuples()} == {i: lengths[i] for i in kept}
    assert out["padding"].sum() == least_padding(sorted(out["n_tokens"]), 16) and (out["bucket_len"] - out["n_tokens"] == out["padding"]).all()
    size = out.groupby(["bucket", "batch"])["bucket_len"].agg(["size", "first"])
    assert (size["size"] <= (65536 // size["first"].clip(1)).clip(1)).all()
    assert [n for n, _ in cp.STAGES] == ["rules", "classifier", "near_duplicates", "packing"]
    assert set(out.columns) == set(packing.pack(packing.token_counts(docs.limit(3))).columns)


def test_pipeline_stages_edges(spark, sf_dir):
    import corpus_pipeline as cp
    from test_text_ops import EDGES, SCHEMA

    docs = spark.createDataFrame(EDGES, SCHEMA).withColumns({"__p": F.lit(1.0), "fingerprint": F.lit("x"), "extra": F.array(F.lit(1))}).drop("__p")
    for df in (docs, docs.limit(0), docs.where("doc_id = 1")):
        for name, stage in cp.STAGES[:3]:
            assert stage(spark, df, sf_dir).columns == df.columns, name
            assert stage(spark, df, sf_dir).count() <= df.count()
        assert cp.STAGES[3][1](spark, df, sf_dir).count() == df.count()
