"""Chat formatting: cumulative snapshots of a conversation collapse to the longest, by rolling hashes of
turn prefixes and an anti-join, before the rest is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_columns

#: Turns of a rendered part, and turn numbers of a run that is ranked by itself.
PART = 256
#: The run of turns without a number, before every other.
NULLS = -(2**62)


def _hashes(*values: Column) -> list[Column]:
    """Four 32-bit halves of two hashes; a null differs from every text."""
    whole = [x for v in values for x in (v.isNull(), F.coalesce(v.cast("string"), F.lit("")))]
    out = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *whole)
        out += [F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))]
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), role, text, n (turns of its conversation), p0..p3 (prefix hash).

    A turn's hash takes in its rank, so their running sums identify the ordered prefix. Ranks and
    sums are made in runs of PART turn numbers and shifted by the sums of the runs before, so a hot
    conversation is spread over tasks.
    """
    rows = has_columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").distinct()
    rows = rows.withColumn("run", F.coalesce(F.floor(F.col("turn") / PART), F.lit(NULLS)))
    order = Window.partitionBy("conv_id", "run").orderBy("turn", "role", "text")
    runs = rows.groupBy("conv_id", "run").agg(F.count("*").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("run")
    runs = runs.select(
        "conv_id", "run", (F.sum("c").over(before) - F.col("c")).alias("shift"),
        F.sum("c").over(Window.partitionBy("conv_id")).alias("n"),
    )
    rows = rows.withColumn("rank", F.row_number().over(order)).join(runs, ["conv_id", "run"])
    rows = rows.withColumn("rank", F.col("rank") + F.col("shift")).drop("shift", "turn")
    rows = rows.select("*", *[h.alias(f"h{i}") for i, h in enumerate(_hashes(F.col("rank"), F.col("role"), F.col("text")))])
    names = [f"h{i}" for i in range(4)]
    sums = rows.groupBy("conv_id", "run").agg(*[F.sum(h).alias(h) for h in names])
    sums = sums.select("conv_id", "run", *[(F.sum(h).over(before) - F.col(h)).alias(f"b{h}") for h in names])
    inner = Window.partitionBy("conv_id", "run").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "run", "rank", "role", "text", "n", *[F.sum(h).over(inner).alias(h) for h in names])
    rows = rows.join(sums, ["conv_id", "run"])
    return rows.select("conv_id", "rank", "role", "text", "n", *[(F.col(h) + F.col(f"b{h}")).alias(f"p{i}") for i, h in enumerate(names)])


def covered(found: DataFrame) -> DataFrame:
    """conv_id of each conversation that is the start of a longer one, or equals one of lesser id.

    Prefixes are grouped before the join (a common first turn is one row), keeping the length of the
    longest conversation that has them and the least id that ends there.
    """
    key = ["rank", "p0", "p1", "p2", "p3"]
    ends = found.where("rank = n").select("conv_id", *key)
    own = F.min(F.when(F.col("rank") == F.col("n"), F.col("conv_id")))
    groups = found.groupBy(*key).agg(F.max("n").alias("longest"), own.alias("least")).where("least IS NOT NULL")
    hit = ends.join(groups, key).where((F.col("longest") > F.col("rank")) | (F.col("least") < F.col("conv_id")))
    return hit.select("conv_id")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, text of the maximal conversations, in the form <|role|>, line break,
    text, <|end|>, line break.

    Parts hold PART turns each, in order; together they are the conversation, and all but very long
    ones have part 0 alone. Rows without a conv_id take no part; equal rows count once; turns that
    tie are ordered by role and text, null numbers first; a null role reads ``user``, a null text is
    empty (both differ from the same written out when prefixes are compared). An empty table gives
    no rows.
    """
    found = turns(conversations)
    kept = found.join(covered(found), "conv_id", "left_anti")
    line = F.concat(
        F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n")
    )
    part = ((F.col("rank") - 1) / PART).cast("long")
    lines = kept.select("conv_id", part.alias("part"), F.struct("rank", line.alias("line")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["line"]), "")
    return lines.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), joined.alias("text"))
