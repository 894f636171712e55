"""As-of, range and alignment joins of dated series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along, bfill, cum, ffill

Keys = Sequence[str]


def asof(left: DataFrame, right: DataFrame, keys: Keys, order: str, values: Sequence[str]) -> DataFrame:
    """``left`` with each value of the last ``right`` row on or before its date, nulls carried over.

    Both sides are stacked and filled forward in one sort: no range join, each row moves once."""
    r = right.select(*keys, order, *[F.col(v).alias(f"__{v}") for v in values], F.lit(0).alias("__side"))
    l = left.withColumn("__side", F.lit(1))
    w = Window.partitionBy(*keys).orderBy(order, "__side")
    both = l.unionByName(r, allowMissingColumns=True)
    filled = both.withColumns({v: F.last(f"__{v}", ignorenulls=True).over(cum(w)) for v in values})
    return filled.where("__side = 1").drop("__side", *[f"__{v}" for v in values])


def align_fill(left: DataFrame, right: DataFrame, keys: Keys, order: str, values: Sequence[str], back: bool = False) -> DataFrame:
    """Exact-date join, then fill forward (and back): right dates that left lacks are lost, unlike asof."""
    out = left.join(right.select(*keys, order, *values), [*keys, order], "left")
    w = along(keys, order)
    out = out.withColumns({v: ffill(F.col(v), w) for v in values})
    return out.withColumns({v: bfill(F.col(v), w) for v in values}) if back else out


def common_dates(df: DataFrame, pair: str, order: str) -> DataFrame:
    """Rows on the dates that every pair has."""
    n = df.select(pair).distinct().agg(F.count("*").alias("__n"))
    dates = df.groupBy(order).agg(F.countDistinct(pair).alias("__k"))
    keep = dates.join(F.broadcast(n), F.col("__k") == F.col("__n")).select(order)
    return df.join(keep, order, "left_semi")


def outer_align(frames: dict[str, DataFrame], keys: Keys, order: str, value: str) -> DataFrame:
    """One column per frame over the union of dates; rows without any value go. Stacked and grouped,
    so the plan has one shuffle however many frames."""
    long = reduce(DataFrame.unionByName, [f.select(*keys, order, value, F.lit(n).alias("__f")) for n, f in frames.items()])
    wide = long.groupBy(*keys, order).agg(*[F.max(F.when(F.col("__f") == n, F.col(value))).alias(n) for n in frames])
    return wide.where(F.coalesce(*[F.col(n) for n in frames]).isNotNull())


def pair_universe(estimators: DataFrame, controllers: DataFrame) -> DataFrame:
    """Every estimator with every controller; both are lists that users write."""
    return estimators.crossJoin(controllers).withColumn("pair", F.concat("estimator", F.lit("__"), "controller"))


def parameter_grid(df: DataFrame, grid: dict[str, Sequence[float]]) -> DataFrame:
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def trailing_rows(decisions: DataFrame, rows: DataFrame, keys: Keys, order: str, months: int) -> DataFrame:
    """Each decision date (as_of) with the rows of the ``months`` before it (its own date excluded).

    A range join on year buckets: a decision meets its months / 12 + 1 years by equality, then the
    exact range filters."""
    d = decisions.withColumn("__from", F.add_months("as_of", -months))
    d = d.withColumn("__y", F.explode(F.sequence(F.year("__from"), F.year("as_of"))))
    out = rows.withColumn("__y", F.year(order)).join(d, [*keys, "__y"])
    return out.where((F.col(order) >= F.col("__from")) & (F.col(order) < F.col("as_of"))).drop("__y", "__from")


def labelled_past(decisions: DataFrame, rows: DataFrame, labels: DataFrame, keys: Keys, order: str, label: str, months: int) -> DataFrame:
    """trailing_rows of those dates whose label equals the decision's."""
    named = rows.join(labels.select(*keys, order, label), [*keys, order])
    d = decisions.withColumnRenamed(label, "__want")
    out = trailing_rows(d, named, keys, order, months)
    return out.where(F.col(label) == F.col("__want")).drop("__want")


def recorded_regime(days: DataFrame, records: DataFrame, keys: Keys, order: str) -> DataFrame:
    """Adds regime: on each date, of the record of the latest prediction_date among those with
    prediction_date on or before the date and feature_end before it. A record counts from the day on which
    both hold, and an older one that ends its features later never covers a newer one."""
    start = F.greatest("prediction_date", F.date_add("feature_end", 1))
    r = records.select(*keys, start.alias(order), F.struct("prediction_date", "regime").alias("__r"), F.lit(0).alias("__side"))
    both = days.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(order, "__side")
    return both.withColumn("regime", F.max("__r").over(cum(w))["regime"]).where("__side = 1").drop("__side", "__r")


def hold_until_next(df: DataFrame, keys: Keys, order: str, col: str, interval: int) -> DataFrame:
    """Adds <col>_held: the value at every ``interval``-th row, held until the next."""
    w = along(keys, order)
    at = (F.row_number().over(w) - 1) % interval == 0
    return df.withColumn("__a", F.when(at, F.col(col))).withColumn(f"{col}_held", ffill(F.col("__a"), w)).drop("__a")


def first_available(*cols: str) -> Column:
    return F.coalesce(*[F.col(c) for c in cols])
