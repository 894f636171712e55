"""Packing: length buckets whose bounds minimise padding over the whole histogram, and token-budget
batches inside each bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, has_columns, materialize, text_slices
from .tokens import default_path, encoder


def token_counts(docs: DataFrame, tokenizer: str | None = None, cache_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens of every whole text, with one end id (a null or empty text: 1).

    Workers hold ``cache_words`` words, and the new words of the two runs of texts that filled the
    cache's halves; runs are small where the cache is. Null ids pass through, repeated rows count
    alike, a very long text is a run of its own, an empty table gives no rows.
    """
    path = tokenizer or default_path()
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType())])
    wanted = arrow_schema(out)
    run = min(max(4 * cache_words, 1 << 18), 4 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, cache_words)
        for batch in batches:
            n = [c + 1 for _, texts in text_slices(batch, "text", run) for c in enc.counts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64())], schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(count, out)


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Bucket bounds (each the largest length of its bucket) with the least total padding.

    Dynamic program over sorted lengths: with cost(i, j) = sum of counts i..j times length j, the
    best k buckets of a prefix extend the best k - 1 of a shorter one. The costs obey the quadrangle
    inequality, so each row is filled by divide and conquer in O(n log n).
    """
    order = np.argsort(lengths)
    x, c = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(x)
    if not n:
        return []
    total = np.concatenate([[0.0], np.cumsum(c)])
    best = total[1:] * x
    back = []
    for _ in range(1, min(buckets, n)):
        new, cut = best.copy(), np.zeros(n, np.int64)
        a, b, lo, hi = (np.array([z]) for z in (0, n - 1, 0, n - 1))
        while len(a):  # all middles of one depth at once
            mid = (a + b) // 2
            size = np.minimum(hi, mid) - lo + 1
            start = np.cumsum(size) - size
            i = np.arange(size.sum()) + np.repeat(lo - start, size)
            end = np.repeat(mid, size)
            cost = np.where(i > 0, best[i - 1], 0.0) + (total[end + 1] - total[i]) * x[end]
            least = np.minimum.reduceat(cost, start)
            at = np.flatnonzero(cost == np.repeat(least, size))
            k = i[at[np.searchsorted(at, start)]]
            new[mid], cut[mid] = least, k
            a, b, lo, hi = (np.concatenate(z) for z in ((a, mid + 1), (mid - 1, b), (lo, k), (k, hi)))
            some = a <= b
            a, b, lo, hi = a[some], b[some], lo[some], hi[some]
        best = new
        back.append(cut)
    out, j = [], n - 1
    for cut in reversed(back):
        out.append(int(x[j]))
        j = int(cut[j]) - 1
        if j < 0:
            break
    if j >= 0:
        out.append(int(x[j]))
    return sorted(out)


def pack(lengths: DataFrame, buckets: int = 16, budget: int = 1 << 16, run: int = 4096) -> DataFrame:
    """Per row of (doc_id, n_tokens): bucket, bucket_len, batch (id within the bucket), padding.

    Bounds come from the histogram of all rows, with a bin for each length. A batch of bucket length L holds budget // L rows
    (at least one, so a row longer than the budget is a batch alone). Rows of a bucket are numbered
    over salted runs of about ``run`` rows: each run is ranked by itself and starts where the runs
    before it end, so no bucket meets in one task. Repeated rows each take a place; null ``doc_id``s
    are ranked like others; null lengths count as 0; an empty table gives no rows.
    """
    spark = lengths.sparkSession
    rows = lengths.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialize(rows, "lengths")
    hist = rows.groupBy("n_tokens").count().toPandas()  # a row for each distinct length
    bounds = best_bounds(hist["n_tokens"].to_numpy(), hist["count"].to_numpy(), buckets)
    runs = max(1, int(hist["count"].sum()) // run)
    bucket = F.lit(len(bounds) - 1)
    size = F.lit(bounds[-1] if bounds else 0).cast("long")
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(bucket)
        size = F.when(F.col("n_tokens") <= bounds[i], F.lit(bounds[i]).cast("long")).otherwise(size)
    rows = rows.select(
        "doc_id", "n_tokens", bucket.alias("bucket"), size.alias("bucket_len"),
        F.pmod(F.xxhash64("doc_id", "n_tokens"), F.lit(runs)).alias("run"),
    )
    before = rows.groupBy("bucket", "run").agg(F.count("*").alias("n"))
    # Copies of one row may make one run long; a rank needs only its order, so ties fall anywhere.
    every = Window.partitionBy("bucket").orderBy("run")
    before = before.select("bucket", "run", (F.sum("n").over(every) - F.col("n")).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("bucket", "run").orderBy("doc_id", "n_tokens"))
    rows = rows.withColumn("rank", rank).join(before, ["bucket", "run"])
    room = F.greatest(F.lit(1).cast("long"), (F.lit(budget) / F.greatest("bucket_len", F.lit(1))).cast("long"))
    return rows.select(
        "doc_id", "n_tokens", "bucket", "bucket_len",
        F.floor((F.col("offset") + F.col("rank") - 1) / room).cast("long").alias("batch"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )
