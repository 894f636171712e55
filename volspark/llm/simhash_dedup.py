"""SimHash near-duplicates: fingerprints are mapped to bit counts of short segments, joined on a grid
under the Manhattan distance of those counts, and verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, free_name, has_columns, materialize, quoted, small, text_slices

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash (unsigned) of a UTF-8 text's word shingles, repeats included."""
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    elif width == 3:
        shingles = [b"%b %b %b" % t for t in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 1 << 16):  # a long text's bits are spread out piece by piece
        h = np.array([digest(s, SEED) for s in shingles[i : i + (1 << 16)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every whole text."""
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    wanted = arrow_schema(out)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(t, width) for _, texts in text_slices(batch, "text") for t in texts]
            fp = np.array(fp, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], schema=wanted)

    return has_columns(docs, "doc_id", "text").mapInArrow(each, out)


def _counts(fp: Column, half: int) -> Column:
    """Bit counts of a half's 16 two-bit segments, each in its own two bits: a point of {0, 1, 2}^16."""
    x = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
    odd = F.lit(0x55555555).cast("long")
    return x.bitwiseAND(odd) + F.shiftrightunsigned(x, 1).bitwiseAND(odd)


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """(a, b), a < b: each pair of distinct fingerprints with Hamming distance 1..``most`` (at most 3).

    |count(a) - count(b)| over a segment never exceeds the bits that differ in it, so the Manhattan
    distance of two points is a lower bound of the Hamming distance. Of a pair within 3, one of the
    two halves (16 segments) is within 1. So every point stands in its grid cell of each half, and
    probes, in each half, the cells one step up in one segment; of two points one step apart just
    one probes the other. Cells meet by an equi-join, pairs are verified on all 64 bits, and a pair
    is kept in the first half that finds it. The rows of a fingerprint are at most 34 whatever the
    data, and at most 43,744 fingerprints can lie within 3 bits of one, copies being joined before.
    """
    if most > 3:
        raise ValueError("two halves cover at most 3 differing bits")
    cells = [F.struct(F.lit(h).alias("h"), _counts(F.col("fp"), h).alias("c")) for h in (0, 1)]
    home = fps.select("fp", F.inline(F.array(*cells)))
    # The two bits of segment i hold 0, 1 or 2; a step up exists unless they hold 2.
    steps = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.call_function("getbit", F.col("c"), 2 * i + 1) == 0)
    up = home.select("fp", "h", F.explode(steps).alias("i"), "c")
    up = up.select("fp", "h", F.expr("c + shiftleft(1L, 2 * i)").alias("c"))
    probes = home.select("fp", "h", "c", F.lit(True).alias("own")).unionByName(up.withColumn("own", F.lit(False)))
    x, y = home.alias("x"), probes.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= most
    apart = (~F.col("y.own")) | (F.col("x.fp") < F.col("y.fp"))
    pair = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") == F.col("y.c")) & near & apart)
    return pair.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node reachable, for every node of ``edges`` (a, b).

    Alternating large-star and small-star steps (each a grouped minimum and an equi-join, so a hub's
    edges can be split over tasks), written after each round, until no edge changes, however many
    rounds that takes (the square of the logarithm of the nodes at most).
    """
    e = materialize(edges.select("a", "b"), "edges")

    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        m = F.least("a", "m")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), m.alias("b"))
        large = large.where("a <> b").distinct()  # a > b from here on
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        new = materialize(small.select(F.col("b").alias("a"), F.col("a").alias("b")), "edges")
        if new.exceptAll(e).isEmpty() and new.count() == e.count():
            break
        e = new
    roots = e.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(e.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """Per row of ``docs``: doc_id, fp, component_id (least doc_id of its component).

    Copies share a fingerprint, so they are one node. Null, empty and wordless texts have fingerprint
    zero and link like others; fewer words than ``width`` make one shingle; repeated rows are kept;
    a null ``doc_id`` is a row of its component and names it only if no other id does (null); an
    empty table gives no rows.
    """
    return _grouped(docs, width, most).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, width: int, most: int) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component) and component_id of every row."""
    fps = materialize(fingerprints(docs, width), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes, most))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = materialize(named, "nodes")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(least, "root").select("fp", "root", "component_id")
    return fps.join(names, "fp").select("doc_id", "fp", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, found: DataFrame, keys: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` with one row of each root of ``found`` (doc_id, key, root): that of the least (doc_id,
    key), a null id last; of rows with one id and key that of the least digest of all its columns, so the
    rows' order has no say; of equal rows one. ``keys`` gives doc_id, key of a table.

    A row whose id is its own stays unless the id goes, so texts are not shuffled: the ids that go are
    broadcast where they are few. Rows whose id is null or stands on several rows are told apart by
    their keys, for which ``keys`` is called again on them alone.
    """
    found = materialize(found.select("doc_id", "key", "root"), "found")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f"))
    stay = materialize(first.select("f.doc_id", "f.key"), "stay")
    shared = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1").select("doc_id")
    shared = small(materialize(shared, "shared-ids"))
    gone = found.join(stay, "doc_id", "left_anti").where("doc_id IS NOT NULL").select("doc_id").union(shared.where("doc_id IS NOT NULL"))
    gone = small(materialize(gone.distinct(), "gone-ids"))
    kept = docs.where("doc_id IS NOT NULL").join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
    if shared.isEmpty():
        return kept
    same = docs["doc_id"].eqNullSafe(shared["doc_id"])
    own = free_name(docs, "__row")
    texts = materialize(docs.join(shared, same, "left_semi").withColumn(own, F.monotonically_increasing_id()), "shared-rows")
    rows = keys(texts.select(F.col(own).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "key")
    mark = F.sha2(F.to_json(F.struct(*quoted(*docs.columns))), 256).alias("mark")
    rows = rows.join(texts.select(F.col(own).alias("row"), "doc_id", mark), "row")
    staying = rows["doc_id"].eqNullSafe(stay["doc_id"]) & (rows["key"] == stay["key"])
    rows = rows.join(stay, staying, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct("mark", "row"))["row"].alias(own))
    return kept.union(texts.join(rows.select(own), own, "left_semi").drop(own))


def keep_one(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the least (doc_id, fp), once.

    A group whose ids are all null keeps one of its rows.
    """
    found = _grouped(docs, width, most).withColumnRenamed("fp", "key")
    return keep_first(docs, found, lambda rows: fingerprints(rows, width).withColumnRenamed("fp", "key"))
