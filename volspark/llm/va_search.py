"""Exact top-k inner-product search with a vector-approximation file.

Vectors are held in pages. A page keeps, for each dimension, a grid of 2^bits cells, the cell of each
vector, and the exact vectors. A query scans a page's cells for bounds of every score, then reads
exact vectors in the order of their bounds until the k-th exact score beats every bound left.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, materialize, partitions

PAGE = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("ids", T.BinaryType()),
    T.StructField("vectors", T.BinaryType()), T.StructField("low", T.BinaryType()), T.StructField("width", T.BinaryType()),
    T.StructField("cells", T.BinaryType()),
])
FOUND = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType()),
    T.StructField("n_read", T.LongType()), T.StructField("n_scanned", T.LongType()),
])


def quantise(v: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, width, cells) of integer vectors: cell c of a dimension holds [low + c * width, low +
    (c + 1) * width - 1]."""
    low = v.min(0)
    width = np.maximum(1, -(-(v.max(0) - low + 1) // (1 << bits)))
    return low, width, ((v - low) // width).astype(np.uint8)


def make_pages(vectors: DataFrame, scale: int = 256, bits: int = 6, page: int = 2048) -> DataFrame:
    """Pages of (vec_id, embedding), made where the rows lie. A component x becomes floor(scale * x).

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    with a null id; vectors of other lengths get pages of their own.
    """
    wanted = arrow_schema(PAGE)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        def close(dim: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([i for i, _ in held[dim]])
            v = np.concatenate([x for _, x in held[dim]])
            whole = len(ids) if all_rows else len(ids) // page * page
            for a in range(0, whole, page):
                part = v[a : min(a + page, whole)]
                low, width, cells = quantise(part, bits)
                kind = np.int16 if np.abs(part).max() < 1 << 15 else np.int64
                row = [
                    dim, len(part), ids[a : a + len(part)].tobytes(), part.astype(kind).tobytes(),
                    low.tobytes(), width.tobytes(), cells.tobytes(),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, wanted)], schema=wanted)
            held[dim] = [(ids[whole:], v[whole:])] if whole < len(ids) else []

        for batch in batches:
            col = batch.column(1)
            size = np.diff(np.asarray(col.offsets))
            flat = col.flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False)  # a null component is NaN here
            begin = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
            ids = batch.column(0).cast(pa.int64())
            good = np.asarray(ids.is_valid()) & np.asarray(col.is_valid()) & (size > 0)
            key = ids.fill_null(0).to_numpy()
            for dim in np.unique(size[good]).tolist():
                at = np.flatnonzero(good & (size == dim))
                v = x[begin[at][:, None] + np.arange(dim)]
                fine = np.isfinite(v).all(1)
                if fine.any():
                    whole = np.floor(scale * v[fine])
                    held[dim].append((key[at[fine]], np.clip(whole, -(2.0**62), 2.0**62).astype(np.int64)))
                    if sum(len(i) for i, _ in held[dim]) >= page:
                        yield from close(dim, False)
        for dim in list(held):
            if held[dim]:
                yield from close(dim, True)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(build, PAGE)


def search_page(
    ids: np.ndarray, v: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray, qid: np.ndarray,
    q: np.ndarray, k: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its id, the k best ids of the page (the query's own aside), each with the best
    exact score of its vectors, and how many exact vectors were read."""
    repeated = len(np.unique(ids)) < len(ids)
    lo = (low + cells * width).astype(np.float64)
    hi = lo + (width - 1)
    up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
    most = up @ hi.T + down @ lo.T
    # Products of doubles round; the slack keeps a bound a bound.
    slack = np.abs(q).astype(np.float64) @ np.maximum(np.abs(low), np.abs(low + width * 256)).astype(np.float64) * 1e-12
    step = max(4 * k, 32)
    for i in range(len(qid)):
        bound = most[i]
        order = np.argpartition(-bound, min(step, len(bound)) - 1)[:step] if step < len(bound) else np.arange(len(bound))
        order = order[np.argsort(-bound[order], kind="stable")]
        best_s, best_i, at, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        while at < len(order):
            rows = order[at : at + step]
            at += len(rows)
            read += len(rows)
            rows = rows[ids[rows] != qid[i]]
            s = np.concatenate([best_s, v[rows] @ q[i]])
            d = np.concatenate([best_i, ids[rows]])
            pick = np.lexsort((d, -s))
            if repeated:  # copies of an id take one place
                pick = pick[np.sort(np.unique(d[pick], return_index=True)[1])]
            pick = pick[:k]
            best_s, best_i = s[pick], d[pick]
            sure = len(pick) == k
            if at < len(order):
                if sure and bound[order[at]] + slack[i] < best_s[-1]:
                    break
            elif at < len(bound):
                left = np.ones(len(bound), bool)
                left[order] = False
                rest = np.flatnonzero(left & (bound + slack[i] >= best_s[-1])) if sure else np.flatnonzero(left)
                order = np.concatenate([order, rest[np.argsort(-bound[rest], kind="stable")]])
                if not len(rest):
                    break
        yield int(qid[i]), best_i, best_s, read


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, bits: int = 6, page: int = 2048, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best inner products; ties go to the
    smaller vec_id, a query's own id is no candidate of it.

    Pages of candidates and blocks of queries meet on a grid of r x s slots: a page lies in one row
    of slots, a block in one column, so a pair meets once, in a task of its own slot, and nothing is
    broadcast. What leaves a pair is k rows a query, and those are merged by query. A repeated
    vec_id competes with each of its vectors (equal pairs count once); fewer candidates than k give
    fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession
    tasks = max(partitions(spark), spark.sparkContext.defaultParallelism)
    pages = materialize(make_pages(vectors, scale, bits, page), "va-pages")
    blocks = materialize(make_pages(queries, scale, bits, block), "va-queries")
    n, m = (t.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for t in (pages, blocks))
    cols = max(1, round((tasks * m / max(n, 1)) ** 0.5))
    rows = max(1, -(-tasks // cols))
    pages = pages.withColumns({"r": F.pmod(F.xxhash64("ids"), F.lit(rows)).cast("int"), "c": F.explode(F.sequence(F.lit(0), F.lit(cols - 1)))})
    blocks = blocks.select(
        "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"),
        F.pmod(F.xxhash64("ids"), F.lit(cols)).cast("int").alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("r"),
    )
    pairs = pages.join(blocks, ["dim", "r", "c"]).drop("r", "c", "n")
    wanted = arrow_schema(FOUND)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                p = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                ids, q_ids, dim = np.frombuffer(p["ids"], np.int64), np.frombuffer(p["q_ids"], np.int64), p["dim"]
                raw = [(p["vectors"], len(ids)), (p["q_vectors"], len(q_ids))]
                v, q = (np.frombuffer(b, np.int16 if len(b) == 2 * n * dim else np.int64).reshape(n, dim).astype(np.int64) for b, n in raw)
                low, width = np.frombuffer(p["low"], np.int64), np.frombuffer(p["width"], np.int64)
                cells = np.frombuffer(p["cells"], np.uint8).reshape(v.shape)
                out: list[list] = [[], [], [], [], []]
                for qid, d, s, read in search_page(ids, v, low, width, cells, q_ids, q, k):
                    for col, x in zip(out, ([qid] * len(d), d.tolist(), s.tolist(), [read] * len(d), [len(ids)] * len(d))):
                        col += x
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=wanted)

    best = pairs.mapInArrow(scan, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
