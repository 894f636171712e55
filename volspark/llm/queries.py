"""The registered queries of this package: thin digests over the operators, on whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, html_extract, hyper_minhash, importance_resample, packing, periodic_runs, quality_classifier, quality_rules, simhash_dedup, sp_sampling, token_output, url_filter, va_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_va_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return va_search.search(vectors, vectors.where("vec_id % 50 = 0"))


def op2_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_documents(token_output.write_shards(_table(spark, sf_dir, "documents")))


def op3_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = quality_rules.judge(docs, quality_rules.fit(docs, _table(spark, sf_dir, "labels")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return found.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in counts], "base_failed", "kept")


def op4_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_counts(_table(spark, sf_dir, "documents")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(_table(spark, sf_dir, "conversations"))


def op7_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sp_sampling.sample_segmentations(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "logp", "perturbed", "inclusion",
    )


def op10_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op11_hyper_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyper_minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth id's words from some place on, replaced by repetitions of their beginning."""
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    n = len(words)
    if doc_id is None or rest or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect(_table(spark, sf_dir, "documents"), change=repeated_tail)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumns({"top": top}).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.s")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.p")).alias("period"),
        F.expr("(1000 * top.length) div -top.p").alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_va_search": op1_va_search,
    "op2_elias_fano_tokens": op2_elias_fano_tokens,
    "op3_decision_list": op3_decision_list,
    "op4_length_buckets": op4_length_buckets,
    "op5_url_filter": op5_url_filter,
    "op6_snapshot_collapse": op6_snapshot_collapse,
    "op7_consensus_html": op7_consensus_html,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_gumbel_segmentations": op9_gumbel_segmentations,
    "op10_boosted_trees": op10_boosted_trees,
    "op11_hyper_minhash": op11_hyper_minhash,
    "op12_importance_resample": op12_importance_resample,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL: dict[str, str] = {
    "op1_va_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
            FROM embeddings
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op6_snapshot_collapse": r"""
        WITH t AS (
            SELECT conv_id, turn, chr(10) AS nl, coalesce(role, '<null>') || chr(0) || coalesce(text, '<null>') AS raw,
                   '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS line, role, text
            FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
        ), c AS (
            SELECT conv_id, count(*) AS n, list(raw ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
                   list(line ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS lines
            FROM t GROUP BY conv_id
        ), kept AS (
            SELECT * FROM c WHERE NOT EXISTS (
                SELECT 1 FROM c AS o WHERE o.turns[1] = c.turns[1] AND (o.n > c.n OR o.n = c.n AND o.conv_id < c.conv_id)
                AND o.turns[1:c.n] = c.turns
            )
        )
        SELECT conv_id, CAST(p AS BIGINT) AS part, CAST(least(256, n - 256 * p) AS BIGINT) AS n_turns,
               array_to_string(lines[256 * p + 1 : 256 * p + 256], '') AS text
        FROM kept, LATERAL unnest(range((n + 255) // 256)) AS u(p)
    """,
    "op12_importance_resample": r"""
        WITH tab AS (
            SELECT list(c ORDER BY b) AS tab FROM (
                SELECT b, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c FROM range(256) AS r(b)
            )
        ), d AS (
            SELECT row_number() OVER () AS r, doc_id,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words
            FROM documents
        ), dw AS (SELECT r, unnest(words) AS word FROM d), dc AS (SELECT r, word, count(*) AS n FROM dw GROUP BY ALL),
        tw AS (
            SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word
            FROM benchmark
        ), raw AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM dc UNION SELECT word FROM tw)),
        crc AS (
            SELECT word, xor(list_reduce(
                list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
            FROM raw, tab
        ), s AS (SELECT bucket, sum(n) AS n FROM dc JOIN crc USING (word) GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS n FROM tw JOIN crc USING (word) GROUP BY bucket),
        g AS (
            SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (S.total + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * (T.total + 10000)::DOUBLE))) AS BIGINT) AS gain
            FROM s FULL JOIN t USING (bucket), (SELECT coalesce(sum(n), 0) AS total FROM s) AS S, (SELECT coalesce(sum(n), 0) AS total FROM t) AS T
        ), m AS (SELECT r, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM dc JOIN crc USING (word) JOIN g USING (bucket) GROUP BY r),
        w AS (
            SELECT doc_id, coalesce(n, 0) AS n_features, coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
                   CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
            FROM d LEFT JOIN m USING (r)
        ), p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k,
                   count(*) FILTER (n_features >= 20) OVER () AS many
            FROM p
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * many // 100 THEN k END AS rank FROM o
    """,
}
