"""Near-duplicates by exact shingle similarity: texts meet on bands of least hashes of their shingles,
and each pair is verified on its whole shingle sets. Texts of crowded bands meet on their rarest shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, has_columns, materialize, small, text_slices
from .simhash_dedup import _LOWER, SEED, components, keep_first

#: Two texts are near-duplicates where |a & b| / |a | b| of their shingle sets is TOP / BOTTOM or more.
WIDTH, TOP, BOTTOM = 5, 4, 5
#: Texts of similarity J share no band with probability (1 - J^ROWS)^BANDS: 5 in 10^8 at 0.8, less above;
#: texts that share a passage only (J of 0.1) meet with probability 3 in 10^3.
BANDS, ROWS = 32, 4
#: Of the BANDS * ROWS least hashes' two-bit marks, texts of similarity 0.8 share fewer with probability
#: 3 in 10^7.
LEAST_MARKS = 88
_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = [(0x5851F42D4C957F2D * i) % (1 << 63) for i in range(4)]
SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("n", T.LongType()), T.StructField("bins", T.BinaryType()), *[T.StructField(f"{c}{i}", T.LongType()) for c in "kp" for i in range(4)],
])
WHOLE = T.StructType([T.StructField("key", T.LongType()), T.StructField("shingles", T.BinaryType())])
MARKS = [f"{c}{i}" for c in "kp" for i in range(4)]
PARITY = [f"p{i}" for i in range(4)]
#: In a band with more texts than this outside its largest component, texts meet on their rarest shingles instead.
CROWD = 64
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of a text's distinct word shingles; fewer words than ``width`` are one shingle."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w, SEED) for w in words], np.uint64)
    k = min(width, len(h))
    n = len(h) - k + 1
    x = np.full(n, k, np.uint64)
    for j in range(k):
        x = (x ^ h[j : j + n]) * _MIX
        x ^= x >> np.uint64(29)
    return np.unique(x)


def set_key(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes(), SEED)


def bands(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each band of ROWS least hashes of a set (an empty set has none), and two bits of each
    least hash in four numbers."""
    if not len(x):
        return np.zeros(0, np.uint64), np.zeros(4, np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(x), 2048):
        least = np.minimum(least, ((x[i : i + 2048, None] ^ _ODD[0]) * _ODD[1]).min(axis=0))
    out = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        out = (out ^ m) * _MIX
        out ^= out >> np.uint64(29)
    marks = ((least * _MIX) >> np.uint64(62)).reshape(4, -1) << np.arange(0, 64, 2, dtype=np.uint64)
    return out, np.bitwise_or.reduce(marks, axis=1)


def parity(x: np.ndarray) -> np.ndarray:
    """Whether each of 256 bins holds an odd number of shingles, as bits of four numbers: every shingle
    that only one of two sets has turns one bit, so bits that differ are never more than such shingles."""
    c = np.bincount((x >> np.uint64(8) & np.uint64(255)).astype(np.int64), minlength=256)
    return np.packbits((c & 1).astype(np.uint8)).view(np.uint64)


@dataclass(frozen=True)
class Rule:
    """When are two sets similar (|a & b| / |a | b| >= top / bottom), and what rules a pair out before?

    ``columns`` of a node (numbers) serve ``alike`` inside joins, on rows with columns x_c and y_c; its
    ``sketch`` (binary) serves ``likely``, on sizes and sketches of a batch of pairs.
    """

    top: int
    bottom: int
    columns: tuple[str, ...]
    alike: Callable[[], Column]
    sketch: str
    likely: Callable[[np.ndarray, np.ndarray, pa.Array, pa.Array], np.ndarray]


def _sizes(top: int, bottom: int) -> Column:
    """Can rows with columns x_n, x_p0.. and y_n.. be similar, by sizes and parities?"""
    n, m, odd = F.col("x_n"), F.col("y_n"), F.lit(0)
    for i in range(4):
        odd += F.bit_count(F.col(f"x_p{i}").bitwiseXOR(F.col(f"y_p{i}")))
    return (F.least(n, m) * bottom >= F.greatest(n, m) * top) & (odd * (bottom + top) <= (n + m) * (bottom - top))


def _alike() -> Column:
    """The same with marks of least hashes, x_k0.. and y_k0.."""
    out = F.lit(0)
    for i in range(4):
        z = F.col(f"x_k{i}").bitwiseXOR(F.col(f"y_k{i}"))
        out += F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    return _sizes(TOP, BOTTOM) & (out <= BANDS * ROWS - LEAST_MARKS)


def _binned(n: np.ndarray, m: np.ndarray, u: pa.Array, v: pa.Array) -> np.ndarray:
    """Could pairs of sizes n and m share enough, by the counts of their bins?"""
    most = np.minimum(n, m)
    for i, (x, y) in enumerate(zip(u.to_pylist(), v.to_pylist())):
        if x and y:
            most[i] = np.minimum(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)).sum(dtype=np.int64)
    return BOTTOM * most >= TOP * (n + m - most)


def bins(x: np.ndarray) -> bytes:
    """How many shingles fall in each of 256 bins (none where one holds more than 255): the summed
    lesser counts of two sets are never below what they share."""
    c = np.bincount((x & np.uint64(255)).astype(np.int64), minlength=256)
    return c.astype(np.uint8).tobytes() if c.max() < 256 else b""


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the set), bands, n and bins of the shingle set of every whole text."""
    wanted = arrow_schema(SETS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for first, part in text_slices(batch, "text"):
                sets = [shingles(t) for t in part]
                key = np.array([set_key(x) for x in sets], np.uint64).view(np.int64)
                made = [bands(x) for x in sets]
                marks = np.array([[*m, *parity(x)] for (_, m), x in zip(made, sets)], np.uint64).reshape(-1, 8).view(np.int64)
                cols = [
                    ids.slice(first, len(part)), pa.array(key), pa.array([h.view(np.int64) for h, _ in made], wanted.field("bands").type),
                    pa.array([len(x) for x in sets], pa.int64()), pa.array([bins(x) for x in sets], pa.binary()), *[pa.array(m) for m in marks.T.copy()],
                ]
                yield pa.RecordBatch.from_arrays(cols, schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(each, SETS)


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, key of every row."""
    wanted = arrow_schema(T.StructType(SETS.fields[:2]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [set_key(shingles(t)) for _, part in text_slices(batch, "text") for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(np.array(key, np.uint64).view(np.int64))], schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(each, T.StructType(SETS.fields[:2]))


def whole_sets(docs: DataFrame, sets: DataFrame, met: DataFrame, tag: str) -> DataFrame:
    """key, shingles of the keys in ``met``, made again from their texts: most texts meet no other, so
    no set is kept before it is asked for. One row stands for all of a key's."""
    wanted = arrow_schema(WHOLE)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in text_slices(batch, "text"):
                x = [shingles(t) for t in part]
                key = pa.array(np.array([set_key(v) for v in x], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([key, pa.array([v.tobytes() for v in x], pa.binary())], schema=wanted)

    ids = sets.join(met, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    ids = small(materialize(ids, f"{tag}-ids"))
    rows = has_columns(docs, "doc_id", "text")
    rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    held = rows.select("text").mapInArrow(each, WHOLE).join(small(met), "key", "left_semi")
    return materialize(held.dropDuplicates(["key"]), tag)


def _joined(pairs: DataFrame, table: DataFrame, *cols: str) -> DataFrame:
    """a, b and, for each column c, c_a and c_b of the two keys."""
    x = table.select(F.col("key").alias("a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    y = table.select(F.col("key").alias("b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return pairs.join(x, "a").join(y, "b").select("a", "b", *[f"{c}_{z}" for c in cols for z in "ab"])


def _verified(pairs: DataFrame, whole: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets (key, shingles) are similar enough."""
    wanted = arrow_schema(EDGE)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, total = (np.zeros(batch.num_rows, np.int64) for _ in range(2))
            for i, (u, v) in enumerate(zip(batch.column(2), batch.column(3))):
                u, v = (np.frombuffer(s.as_buffer(), np.uint64) for s in (u, v))
                shared[i], total[i] = len(np.intersect1d(u, v, assume_unique=True)), len(u) + len(v)
            kept = batch.select([0, 1]).filter(pa.array(rule.bottom * shared >= rule.top * (total - shared)))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=wanted)

    return _joined(pairs, whole, "shingles").mapInArrow(check, EDGE)


def likely(pairs: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that sizes and sketches (of ``nodes``: key, n, sketch) don't rule out."""
    wanted = arrow_schema(EDGE)

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(i).to_numpy() for i in (2, 3))
            kept = batch.select([0, 1]).filter(pa.array(rule.likely(n, m, batch.column(4), batch.column(5))))
            yield pa.RecordBatch.from_arrays(kept.columns, schema=wanted)

    near = _joined(pairs, nodes, "n", rule.sketch)
    return near.where(F.least("n_a", "n_b") * rule.bottom >= F.greatest("n_a", "n_b") * rule.top).mapInArrow(prune, EDGE)


def similar(pairs: DataFrame, docs: DataFrame, sets: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) of keys whose whole sets are similar enough; pairs that sizes and sketches rule
    out are dropped before any set is moved."""
    near = materialize(likely(pairs, nodes, rule), "near")
    met = materialize(near.select(F.col("a").alias("key")).union(near.select("b")).distinct(), "met")
    return _verified(near, whole_sets(docs, sets, met, "met-sets"), rule)


def rare_pairs(whole: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Candidates (a, b) among whole sets (key, shingles) of ``nodes`` (key, root, n, rule's columns): each
    pair of two roots that is similar enough is one of them.

    A shingle that one root alone has can't be shared by a pair of two roots: it is *dead*. Sets are
    ordered by dead shingles first, then rarest first. Of n shingles, similar sets share one of the first
    n - ceil(t n) + 1 of each; so a set with as many dead ones takes no part, as texts of one template do,
    and others meet on the few live ones that stand so early. Two sets never share more than the live
    shingles of each, so a set looks for no partner (of its size at most) of a size that would take more.
    """
    top, bottom = rule.top, rule.bottom
    one = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "root", "n", "h")])
    wanted = arrow_schema(one)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *own, held in zip(*[batch.column(i).to_pylist() for i in range(3)], batch.column(3)):
                h = np.frombuffer(held.as_buffer(), np.int64)
                for i in range(0, len(h), 1 << 16):
                    part = h[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([*[pa.array(np.full(len(part), x)) for x in own], pa.array(part)], schema=wanted)

    # Root and size go with each set before its shingles are spread, so no join carries a row for each of them.
    each = whole.join(nodes.select("key", "root", "n"), "key").select("key", "root", "n", "shingles").mapInArrow(spread, one)
    each = materialize(each, "crowd-shingles")
    live = each.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("f")).where("lo < hi")
    each = each.join(small(materialize(live.select("h", "f"), "live")), "h")
    early = F.floor(F.col("n") * (bottom - top) / bottom).cast("long") + 1 - F.col("n") + F.col("live")
    rows = each.withColumn("live", F.count("*").over(Window.partitionBy("key")))
    place = F.row_number().over(Window.partitionBy("key").orderBy("f", "h"))
    rows = rows.withColumn("place", place).where(F.col("place") <= early).select("h", "key", "root", "n", "live")
    cell = lambda n: F.floor(F.log(n) * 20).cast("long")
    largest = F.least(F.col("n"), F.floor(F.col("live") * (bottom + top) / top).cast("long") - F.col("n"))
    least = F.greatest(F.lit(1), F.ceil(F.col("n") * top / bottom)).cast("long")
    rows = rows.withColumns({"cell": cell(F.col("n")), "least": least, "largest": largest})
    rows = materialize(rows.join(nodes.select("key", *[c for c in rule.columns if c != "n"]), "key"), "rare")
    cols = ("root", "n", "live", *[c for c in rule.columns if c != "n"])
    x = rows.where("least <= largest").select("h", F.explode(F.sequence(cell(F.col("least")), cell(F.col("largest")))).alias("cell"), "least", "largest", F.col("key").alias("x"), *[F.col(c).alias(f"x_{c}") for c in cols])
    y = rows.select("h", "cell", F.col("key").alias("y"), *[F.col(c).alias(f"y_{c}") for c in cols])
    enough = F.least("x_live", "y_live") * (bottom + top) >= (F.col("x_n") + F.col("y_n")) * top
    met = x.join(y, (x["h"] == y["h"]) & (x["cell"] == y["cell"]) & (F.col("x_root") != F.col("y_root")) & (F.col("y_n") <= F.col("largest")) & (F.col("y_n") >= F.col("least")) & enough & rule.alike())
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(docs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b), a < b, of similar sets; each two similar sets are connected by them.

    Sets that share a band meet. First each set of a band meets up to four heads of it, so a large group of
    near copies is joined in linear work; then, where a band still holds several components, every set
    outside its largest one meets all sets of other components, if no more than ``CROWD`` are outside.
    Of a band with more (a template, a licence: alike, but not enough) the sets meet by ``rare_pairs``. What is left
    out are pairs that are connected already.
    """
    nodes = materialize(sets.groupBy("key").agg(*[F.first(c).alias(c) for c in dict.fromkeys(("n", rule.sketch, "bands", *rule.columns))]), "set-bins")
    pre = nodes.select("key", F.posexplode("bands").alias("i", "s"))
    shared = pre.groupBy("s").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("s")
    pre = materialize(pre.join(shared, "s"), "bands")
    least = [F.min(F.col("key").bitwiseXOR(F.lit(z))).bitwiseXOR(F.lit(z)) for z in _SALTS]
    heads = pre.groupBy("s").agg(F.array_distinct(F.array(*least)).alias("heads"))
    met = pre.join(heads, "s").select("key", F.explode("heads").alias("head")).where("key <> head")
    met = materialize(met.select(F.least("key", "head").alias("a"), F.greatest("key", "head").alias("b")).distinct(), "pairs")
    edges = materialize(similar(met, docs, sets, nodes, rule), "similar")
    roots = components(edges).withColumnRenamed("node", "key")
    rows = materialize(pre.join(roots, "key", "left").select("s", "i", "key", F.coalesce("root", "key").alias("root")), "band-roots")
    main = rows.groupBy("s", "root").count().groupBy("s").agg(F.max_by("root", "count").alias("main"), F.count("*").alias("n"), (F.sum("count") - F.max("count")).alias("others"))
    main = materialize(main.where("n > 1").select("s", "main", "others"), "open-bands")
    some = ("n", *[c for c in rule.columns if c != "n"])
    open_ = rows.join(main.where(F.col("others") <= CROWD), "s")
    open_ = materialize(open_.join(nodes.select("key", "bands", *some), "key"), "open")
    side = lambda df, z: df.select("s", F.col("key").alias(z), F.col("root").alias(f"{z}_root"), *[F.col(c).alias(f"{z}_{c}") for c in ("i", "bands", *some)])
    x, y = side(open_.where("root <> main"), "x"), side(open_, "y")
    # A pair is made in the first of the bands that it shares alone; if that one is crowded, below.
    first = F.array_position(F.zip_with("x_bands", "y_bands", lambda a, b: a == b), True) == F.col("x_i") + 1
    pair = x.join(y, (x["s"] == y["s"]) & (F.col("x_root") != F.col("y_root")) & rule.alike() & first)
    rest = pair.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    rest = materialize(rest.distinct().join(met, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        edges = edges.unionByName(materialize(similar(rest, docs, sets, nodes, rule), "similar"))
    crowd = rows.join(main.where(F.col("others") > CROWD).select("s"), "s", "left_semi").select("key", "root").distinct()
    crowd = materialize(crowd.join(nodes, "key").select("key", "root", rule.sketch, *some), "crowd")
    if crowd.isEmpty():
        return edges
    whole = whole_sets(docs, sets, crowd.select("key"), "crowd-sets")
    rest = materialize(likely(rare_pairs(whole, crowd, rule), crowd, rule), "near")
    return edges.unionByName(materialize(_verified(rest, whole, rule), "similar"))


#: The pipeline's rule: five words, a similarity of 0.8 or more.
RULE = Rule(TOP, BOTTOM, ("n", *MARKS), _alike, "bins", _binned)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, key, root; rows of one root are connected by similar texts.

    Texts of one set are one node. Null, empty and wordless texts have the empty set and are alike.
    """
    sets = materialize(shingle_sets(docs), "shingle-sets", "lz4")
    roots = components(links(docs, sets, RULE)).withColumnRenamed("node", "key")
    return sets.select("doc_id", "key").join(roots, "key", "left").select("doc_id", "key", F.coalesce("root", "key").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the least ``doc_id``."""
    return keep_first(docs, near_duplicates(docs), keys)
