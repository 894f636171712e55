"""Near-duplicates by HyperMinHash: per bucket the least hash is kept as its count of leading zeros and some bits
of its mantissa; texts meet on bands of these registers, the registers' collision-corrected estimate rules
pairs out, and what is left is verified on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingle_join
from .common import arrow_schema, has_columns, materialize, text_slices
from .simhash_dedup import components

#: Linked: 100 * intersection >= 85 * union. A register has 6 bits for the leading zeros (0: empty bucket) and
#: MANTISSA bits; a sketch has BANDS hash functions of BUCKETS buckets, a function's registers being a band. Sets
#: of similarity 0.85 share no band with probability (1 - 0.85^6)^32 = 3 in 10^7.
TOP, BOTTOM = 85, 100
BANDS, BUCKETS, MANTISSA = 32, 6, 10
#: A pair is ruled out if its estimate is more than so many standard deviations below the threshold.
SURE = 7.0
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(7).integers(0, 1 << 63, (2, BANDS), np.uint64) * np.uint64(2) + np.uint64(1)
_WIDTH = np.uint64((1 << 64) // BUCKETS)
SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("registers", T.BinaryType()), *[T.StructField(c, T.LongType()) for c in shingle_join.PARITY],
])


def registers(x: np.ndarray) -> np.ndarray:
    """BANDS x BUCKETS registers of a set of 64-bit hashes.

    A function's hash falls into bucket b if it lies in [b, b + 1) * _WIDTH; its rest below that bound is what is
    kept the least of. Leading zeros are counted from the bucket's width.
    """
    least = np.full((BANDS, BUCKETS), _WIDTH, np.uint64)
    for i in range(0, len(x), 2048):
        g = (x[i : i + 2048, None] ^ _ODD[0]) * _ODD[1]
        for b in range(BUCKETS):
            least[:, b] = np.minimum(least[:, b], (g - np.uint64(b) * _WIDTH).min(axis=0))  # others wrap to _WIDTH or more
    bits = 62  # _WIDTH has 62
    high = np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1].astype(np.int64)
    high -= (least >> np.minimum(np.maximum(high - 1, 0), 63).astype(np.uint64)) == 0  # where rounding went up a bit
    mantissa = np.where(high > MANTISSA, least >> np.maximum(high - 1 - MANTISSA, 0).astype(np.uint64), least << np.maximum(MANTISSA + 1 - high, 0).astype(np.uint64))
    kept = ((bits - np.maximum(high, 0) + 1).astype(np.uint64) << np.uint64(MANTISSA)) | (mantissa & np.uint64((1 << MANTISSA) - 1))
    return np.where(least >= _WIDTH, 0, kept).astype(np.uint16)


def bands(regs: np.ndarray) -> np.ndarray:
    """A hash for each band's registers."""
    out = np.arange(BANDS, dtype=np.uint64)
    for r in regs.T.astype(np.uint64):
        out = (out ^ r) * _MIX
        out ^= out >> np.uint64(29)
    return out


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """How likely a bucket's registers of two sets that share nothing agree: the published approximation
    0.1699 * 2^-r * 4q / (1 + q)^2, q being the ratio of sizes."""
    q = np.maximum(n, m) / np.minimum(n, m)
    return 0.169919487159739093975315012348630288992889 / (1 << MANTISSA) * 4 * q / (1 + q) ** 2


def estimate(u: np.ndarray, v: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The similarity that rows of registers speak for, without chance agreements, and how many registers speak."""
    used = (u > 0) | (v > 0)
    total = used.sum(axis=1)
    share = ((u == v) & used).sum(axis=1) / np.maximum(total, 1)
    c = chance(n, m)
    return (share - c) / (1 - c), total


def _likely(n: np.ndarray, m: np.ndarray, u: pa.Array, v: pa.Array) -> np.ndarray:
    if not len(n):
        return np.zeros(0, bool)
    u, v = (np.frombuffer(b"".join(x.to_pylist()), np.uint16).reshape(len(n), -1) for x in (u, v))
    found, total = estimate(u, v, n, m)
    t = TOP / BOTTOM
    return found + SURE * np.sqrt(t * (1 - t) / np.maximum(total, 1)) >= t


RULE = shingle_join.Rule(TOP, BOTTOM, ("n", *shingle_join.PARITY), lambda: shingle_join._sizes(TOP, BOTTOM), "registers", _likely)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the set), n, bands, registers and parities of every whole text's shingle set.

    Sets so small that one other shingle brings any two below the threshold get no bands: they are
    similar to themselves only, as the empty set of null, empty and wordless texts.
    """
    wanted = arrow_schema(SETS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, part in text_slices(batch, "text"):
                sets = [shingle_join.shingles(t) for t in part]
                regs = [registers(x) for x in sets]
                meet = [bands(r).view(np.int64) if len(x) * (BOTTOM - TOP) >= TOP else np.zeros(0, np.int64) for x, r in zip(sets, regs)]
                cols = [
                    ids.slice(first, len(part)), pa.array(np.array([shingle_join.set_key(x) for x in sets], np.uint64).view(np.int64)),
                    pa.array([len(x) for x in sets], pa.int64()), pa.array(meet, wanted.field("bands").type), pa.array([r.tobytes() for r in regs], pa.binary()),
                    *[pa.array(c) for c in np.array([shingle_join.parity(x) for x in sets], np.uint64).reshape(-1, 4).view(np.int64).T.copy()],
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(each, SETS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (least doc_id that links reach) and kept (is it its own id?).

    Links: sets of five-word shingles with 100 * intersection >= 85 * union, on whole texts; fewer words
    are one shingle. Copies share a set, so they are one node. Null, empty and wordless texts have the
    empty set, link with nothing and are each their own component. Repeated rows are kept, each with its
    id's component; a null id names a component only if no other id does (null), and is kept then; other columns
    take no part; an empty table gives no rows.
    """
    sets = materialize(sketches(docs), "sketches", "lz4")
    some = sets.where("n > 0")
    roots = components(shingle_join.links(docs, some, RULE)).withColumnRenamed("node", "key")
    nodes = some.groupBy("key").agg(F.min("doc_id").alias("least"))
    named = materialize(nodes.join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")), "nodes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("key", "component_id")
    rows = some.select("doc_id", "n", "key").join(names, "key").select("doc_id", "n", "component_id")
    rows = rows.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
