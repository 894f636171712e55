"""Cleaning, filters, calendars and set operations over dated rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, contains_any, pair_parts
from ..functions.frames import along, ffill, roll, std

Keys = Sequence[str]


def resample_last(df: DataFrame, keys: Keys, order: str, unit: str, cols: Sequence[str]) -> DataFrame:
    """keys, bucket and the last non-null value of each column in it."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in cols]
    return df.groupBy(*keys, F.to_date(F.date_trunc(unit, order)).alias("bucket")).agg(*last)


def clean_prices(df: DataFrame, keys: Keys, order: str, price: str, tie: str, symbol: str | None = None, token: str | None = None) -> DataFrame:
    """The first row of each timestamp, where the price is positive and the symbol has the token."""
    out = df.where(F.col(price) > 0)
    if symbol and token:
        out = out.where(F.col(symbol).contains(token))
    first = F.row_number().over(Window.partitionBy(*keys, order).orderBy(tie))
    return out.withColumn("__n", first).where("__n = 1").drop("__n")


def sample_split(df: DataFrame, keys: Keys, order: str, share: float = 0.5) -> DataFrame:
    """Adds in_sample: the first floor(share * rows) rows of each series."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("in_sample", F.row_number().over(along(keys, order)) <= F.floor(n * share))


def between(df: DataFrame, order: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends included; literals, so the filter reaches a Parquet scan."""
    if start:
        df = df.where(F.col(order) >= F.lit(start).cast("date"))
    return df.where(F.col(order) <= F.lit(end).cast("date")) if end else df


def exclude_pairs(df: DataFrame, pair: str, estimators: Sequence[str] = (), controllers: Sequence[str] = (), pairs: Sequence[str] = ()) -> DataFrame:
    est, ctrl = pair_parts(F.col(pair))
    bad = contains_any(est, list(estimators)) | contains_any(ctrl, list(controllers)) | contains_any(F.col(pair), list(pairs))
    return df.where(~bad)


def include_pairs(df: DataFrame, pool: DataFrame, pair: str = "pair") -> DataFrame:
    return df.join(pool.select(pair).distinct(), pair, "left_semi")


def returns_frame(df: DataFrame, date: str, r: str) -> DataFrame:
    """Dates with at least one value, other nulls as 0."""
    some = F.count(r).over(Window.partitionBy(date)) > 0
    return df.withColumn("__s", some).where("__s").drop("__s").withColumn(r, F.coalesce(r, F.lit(0.0)))


def winsor_global(df: DataFrame, keys: Keys, col: str, q: float) -> DataFrame:
    """Adds <col>_w: clipped to the series' own q and 1 - q quantiles (looks ahead, as documented)."""
    cut = df.groupBy(*keys).agg(F.percentile(col, q).alias("__lo"), F.percentile(col, 1 - q).alias("__hi"))
    return df.join(cut, list(keys)).withColumn(f"{col}_w", clip(F.col(col), F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def winsor_trailing(df: DataFrame, keys: Keys, order: str, col: str, sigmas: float = 5.0, n: int = 252, least: int = 20) -> DataFrame:
    """Adds <col>_w: clipped to +-sigmas of the trailing std; a null std doesn't clip."""
    bound = F.col("__sd") * sigmas
    out = df.withColumn("__sd", std(F.col(col), roll(along(keys, order), n), least))
    return out.withColumn(f"{col}_w", clip(F.col(col), -bound, bound)).drop("__sd")


def business_days(df: DataFrame, keys: Keys, order: str) -> DataFrame:
    """keys, order: every weekday between a series' first and last date."""
    span = df.groupBy(*keys).agg(F.min(order).alias("__a"), F.max(order).alias("__b"))
    days = span.select(*keys, F.explode(F.sequence("__a", "__b")).alias(order))
    return days.where(F.weekday(order) < 5)


def on_spine(df: DataFrame, keys: Keys, order: str, cols: Sequence[str]) -> DataFrame:
    """Rows on the business-day spine, ``cols`` filled forward, filled = the date had no row."""
    here = df.select(*keys, order, *cols, F.lit(True).alias("__here"))
    out = business_days(df, keys, order).join(here, [*keys, order], "left")
    w = along(keys, order)
    return out.select(*keys, order, *[ffill(F.col(c), w).alias(c) for c in cols], F.col("__here").isNull().alias("filled"))


def rebalance_flag(order: str, freq: str):
    """D: every date; W: Sundays (so business days never match); M: month ends; Q: quarter ends."""
    d = F.col(order)
    if freq == "D":
        return F.lit(True)
    if freq.startswith("W"):
        day = {"MON": 0, "TUE": 1, "WED": 2, "THU": 3, "FRI": 4, "SAT": 5, "SUN": 6}[freq[2:] or "SUN"]
        return F.weekday(d) == day
    end = d == F.last_day(d)
    return end & (F.month(d) % 3 == 0) if freq.startswith("Q") else end


def covering(df: DataFrame, pair: str, order: str, end: str) -> DataFrame:
    """Rows of the pairs whose last date reaches ``end``."""
    ok = df.groupBy(pair).agg(F.max(order).alias("__m")).where(F.col("__m") >= F.lit(end).cast("date")).select(pair)
    return df.join(ok, pair, "left_semi")


def one_per_estimator(strategies: DataFrame, name: str, prefer: Sequence[str]) -> DataFrame:
    """One strategy per estimator: the first whose name has the earliest preferred tag, else by name."""
    est, _ = pair_parts(F.col(name))
    order = F.lit(len(prefer))
    for i in range(len(prefer) - 1, -1, -1):
        order = F.when(F.col(name).contains(prefer[i]), i).otherwise(order)
    rank = F.row_number().over(Window.partitionBy("estimator").orderBy("__o", name))
    return strategies.withColumns({"estimator": est, "__o": order}).withColumn("__n", rank).where("__n = 1").drop("__o", "__n")


def keep_first(df: DataFrame, keys: Keys, order: Sequence[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")
