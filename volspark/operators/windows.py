"""Ordered-window operators over (keys, order)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along, bias_corrected_skew, cum, ffill, gated, mean, quantile, roll, std

Keys = Sequence[str]


def with_returns(df: DataFrame, keys: Keys, order: str, price: str) -> DataFrame:
    """Adds simple and log returns; a non-positive price gives a null log return."""
    prev = F.lag(price).over(along(keys, order))
    ok = (F.col(price) > 0) & (prev > 0)
    return df.withColumns({
        "simple_return": F.when(prev != 0, F.col(price) / prev - 1), "log_return": F.when(ok, F.log(F.col(price) / prev)),
    })


def rolling(df: DataFrame, keys: Keys, order: str, col: str, n: int, least: int | None = None) -> DataFrame:
    """Adds {mean,sum,std,var,min,max,skew}_{n} of ``col`` over the last n rows, null below ``least``."""
    w, c, m = roll(along(keys, order), n), F.col(col), least or n
    found = {
        "mean": F.avg(c).over(w), "sum": F.sum(c).over(w), "std": F.stddev_samp(c).over(w), "var": F.var_samp(c).over(w),
        "min": F.min(c).over(w), "max": F.max(c).over(w), "skew": bias_corrected_skew(c, w),
    }
    return df.withColumns({f"{k}_{n}": gated(v, c, w, m) for k, v in found.items()})


def lag_features(df: DataFrame, keys: Keys, order: str, col: str, lags: Sequence[int]) -> DataFrame:
    """Adds lags, the first and second difference and the lead of ``col``."""
    w, c = along(keys, order), F.col(col)
    out = {f"lag_{k}": F.lag(c, k).over(w) for k in lags}
    out |= {"diff_1": c - F.lag(c).over(w), "diff_2": c - 2 * F.lag(c).over(w) + F.lag(c, 2).over(w), "lead_1": F.lead(c).over(w)}
    return df.withColumns(out)


def expanding_mean(df: DataFrame, keys: Keys, order: str, col: str, lag: int = 1) -> DataFrame:
    return df.withColumn("expanding_mean", F.avg(col).over(cum(along(keys, order), lag)))


def equity_curve(df: DataFrame, keys: Keys, order: str, col: str, log: bool = True) -> DataFrame:
    """Adds equity, peak and drawdown (0 or below) of a return column."""
    w = cum(along(keys, order))
    growth = F.col(col) if log else F.log1p(F.greatest(F.col(col), F.lit(-0.999999)))
    out = df.withColumn("equity", F.exp(F.sum(F.coalesce(growth, F.lit(0.0))).over(w)))
    out = out.withColumn("peak", F.max("equity").over(w))
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def ewma(df: DataFrame, keys: Keys, order: str, col: str, halflife: float | None = None, span: float | None = None) -> DataFrame:
    """Adds ewma (not adjusted, seeded by the first value): a fold per series."""
    schema = df.withColumn("ewma", F.lit(0.0)).schema

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pdf.assign(ewma=pdf[col].astype(float).ewm(halflife=halflife, span=span, adjust=False).mean())

    return df.groupBy(*keys).applyInPandas(fold, schema)


def rolling_rank(c: Column, keys: Keys, order: str, n: int) -> Column:
    """Average percentile rank of the last value among the last n (null until n values)."""
    w = roll(along(keys, order), n)
    seen = F.collect_list(c).over(w)
    below = F.size(F.filter(seen, lambda x: x < c))
    same = F.size(F.filter(seen, lambda x: x == c))
    return F.when((F.size(seen) >= n) & c.isNotNull(), (below + (same + 1) / 2) / n)


def cross_rank(c: Column, by: Keys, *ties: str) -> Column:
    """Percentile rank within ``by``; equal values share their average rank."""
    w = Window.partitionBy(*by).orderBy(c)
    same = F.count("*").over(Window.partitionBy(*by, *ties)) if ties else F.lit(1)
    return (F.rank().over(w) + (same - 1) / 2) / F.count("*").over(Window.partitionBy(*by))


def market_label(df: DataFrame, keys: Keys, order: str, col: str, n: int) -> DataFrame:
    """Adds market_vol, market_mean, market_skew and market_regime of the n rows before each date:
    high where |last| >= |80 % quantile|, low where |last| <= |20 % quantile|, else middle."""
    w = along(keys, order)
    f, c = roll(w, n, 1), F.col(col)
    out = df.withColumns({
        "market_vol": std(c, f, n), "market_mean": mean(c, f, n), "market_skew": gated(bias_corrected_skew(c, f), c, f, n),
        "__hi": F.abs(quantile(c, 0.8, f, n)), "__lo": F.abs(quantile(c, 0.2, f, n)), "__last": F.abs(F.lag(c).over(w)),
    })
    label = F.when(F.col("__last") >= F.col("__hi"), "high").when(F.col("__last") <= F.col("__lo"), "low").when(F.col("__hi").isNotNull(), "middle")
    return out.withColumn("market_regime", label).drop("__hi", "__lo", "__last")


def next_vol_proxy(df: DataFrame, keys: Keys, order: str, col: str, n: int = 21, ann: float = 252.0) -> DataFrame:
    """Adds rv_next: sqrt(ann / n * sum of squared next-row returns) over the trailing n rows."""
    w = along(keys, order)
    nxt = df.withColumn("__next", F.lead(col).over(w))
    sq = F.col("__next") * F.col("__next")
    return nxt.withColumn("rv_next", gated(F.sqrt(F.sum(sq).over(roll(w, n)) * ann / n), sq, roll(w, n), n)).drop("__next")


def back_adjust(df: DataFrame, keys: Keys, order: str, close: str, contract: str) -> DataFrame:
    """Adds is_roll_day and close_adj: close plus the gaps of all later rolls (its own excluded).

    A row is a roll day where the next row has another contract; the last row is one too, with no
    gap. The gap is the next close minus this one."""
    w = along(keys, order)
    nxt = F.lead(contract).over(w)
    gap = F.when(nxt.isNull() | (nxt != F.col(contract)), F.coalesce(F.lead(close).over(w) - F.col(close), F.lit(0.0))).otherwise(0.0)
    out = df.withColumns({"is_roll_day": nxt.isNull() | (nxt != F.col(contract)), "__gap": gap})
    later = F.coalesce(F.sum("__gap").over(w.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return out.withColumn("close_adj", F.col(close) + later).drop("__gap")


def series_summary(df: DataFrame, keys: Keys, order: str, col: str, windows: Sequence[int] = (20, 63, 126)) -> DataFrame:
    """Per key: latest value, and mean, change, min and max over the last n non-null rows."""
    rows = df.where(F.col(col).isNotNull())
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    rows = rows.withColumn("__n", F.row_number().over(back))
    aggs = [F.max(F.when(F.col("__n") == 1, F.col(col))).alias("latest")]
    for n in windows:
        c = F.when(F.col("__n") <= n, F.col(col))
        first = F.max_by(c, F.when(F.col("__n") <= n, F.col("__n")))
        last = F.max(F.when(F.col("__n") == 1, F.col(col)))
        aggs += [F.avg(c).alias(f"mean_{n}"), (last - first).alias(f"change_{n}"), F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}")]
    return rows.groupBy(*keys).agg(*aggs)


def equity_snapshot(df: DataFrame, keys: Keys, order: str, equity: str, points: int = 12) -> DataFrame:
    """Rows at up to ``points`` equally spaced positions of each series, with return_from_start."""
    w = along(keys, order)
    every = Window.partitionBy(*keys)
    rows = df.withColumns({"__i": F.row_number().over(w) - 1, "__n": F.count("*").over(every), "__e0": F.first(equity).over(w)})
    k = F.least(F.lit(points), F.col("__n"))
    wanted = F.transform(F.sequence(F.lit(0), k - 1), lambda j: F.rint(j * (F.col("__n") - 1) / F.greatest(k - 1, F.lit(1))).cast("int"))
    out = rows.where(F.array_contains(wanted, F.col("__i").cast("int")))
    return out.select(*keys, order, equity, (F.col(equity) / F.col("__e0") - 1).alias("return_from_start"))


def hold_days(df: DataFrame, keys: Keys, order: str, choice: str) -> DataFrame:
    """Adds switched, hold_rows (rows since the last switch) and days_since_switch."""
    w = along(keys, order)
    prev = F.lag(choice).over(w)
    out = df.withColumns({"switched": prev.isNotNull() & (prev != F.col(choice)), "__i": F.row_number().over(w)})
    start = F.col("switched") | (F.col("__i") == 1)
    since = ffill(F.when(start, F.struct(F.col(order).alias("d"), F.col("__i").alias("i"))), w)
    out = out.withColumn("__s", since)
    return out.withColumns({
        "hold_rows": F.col("__i") - F.col("__s.i"), "days_since_switch": F.datediff(F.col(order), F.col("__s.d")),
    }).drop("__i", "__s")


def rank_history(df: DataFrame, keys: Keys, order: str, rank: str, k: int = 3, reviews: int = 6) -> DataFrame:
    """Adds top_hits and mean_rank over the last reviews of each key."""
    w = roll(along(keys, order), reviews)
    return df.withColumns({"top_hits": F.avg((F.col(rank) <= k).cast("double")).over(w), "mean_rank": F.avg(rank).over(w)})
