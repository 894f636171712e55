"""Grouped performance and risk metrics of return ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll, std
from .windows import equity_curve

Keys = Sequence[str]


def sharpe(r: Column, ann: float = 252.0) -> Column:
    """0 with fewer than two values or no spread."""
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), F.avg(r) / sd * ann**0.5).otherwise(0.0)


def ann_vol(r: Column, ann: float = 252.0) -> Column:
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * ann**0.5)


def ann_return(r: Column, ann: float = 252.0, kind: str = "arithmetic") -> Column:
    if kind == "arithmetic":
        return F.avg(r) * ann
    return F.exp(F.sum(F.log1p(F.greatest(r, F.lit(-0.999999)))) * ann / F.count(r)) - 1


def max_drawdown(df: DataFrame, keys: Keys, order: str, r: str, log: bool = True) -> DataFrame:
    """keys, max_drawdown as a positive loss."""
    return equity_curve(df, keys, order, r, log).groupBy(*keys).agg((-F.min("drawdown")).alias("max_drawdown"))


def with_quantile(df: DataFrame, keys: Keys, r: str, q: float, name: str) -> DataFrame:
    """Adds a group's quantile to its rows (aggregate, then an equi-join on the keys)."""
    return df.join(df.groupBy(*keys).agg(F.percentile(r, q).alias(name)), list(keys))


def cvar(df: DataFrame, keys: Keys, r: str, alpha: float = 0.05, least: int = 1) -> DataFrame:
    """keys, var, cvar: the quantile, and the mean at or below it, both as losses."""
    cut = with_quantile(df.where(F.col(r).isNotNull()), keys, r, alpha, "__q")
    tail = F.avg(F.when(F.col(r) <= F.col("__q"), F.col(r)))
    return cut.groupBy(*keys).agg((-F.first("__q")).alias("var"), F.when(F.count(r) >= least, -tail).alias("cvar"))


def performance(df: DataFrame, keys: Keys, order: str, r: str, weight: str | None = None, ann: float = 252.0) -> DataFrame:
    """One row per key: n, total_return, ann_return, ann_vol, sharpe, sortino, max_drawdown, calmar,
    ulcer, var_95, cvar_95, win_rate, win_loss, stress_days and, given weights, turnover.

    One window pass (equity and peak share its sort), one quantile aggregate, one grouped pass."""
    c = F.col(r)
    rows = equity_curve(df.where(c.isNotNull()), keys, order, r)
    if weight:
        rows = rows.withColumn("__dw", F.abs(F.col(weight) - F.lag(weight).over(along(keys, order))))
    cut = rows.groupBy(*keys).agg(F.percentile(r, 0.05).alias("__q"))
    rows = rows.join(cut, list(keys))
    down = F.stddev_pop(F.when(c < 0, c))
    dd = F.col("drawdown")
    aggs = [
        F.count("*").alias("n"), (F.exp(F.sum(c)) - 1).alias("total_return"), ann_return(c, ann).alias("ann_return"),
        ann_vol(c, ann).alias("ann_vol"), sharpe(c, ann).alias("sharpe"),
        F.when(down > 0, F.avg(c) / down * ann**0.5).alias("sortino"), (-F.min(dd)).alias("max_drawdown"),
        F.sqrt(F.avg(dd * dd)).alias("ulcer"), (-F.first("__q")).alias("var_95"),
        (-F.avg(F.when(c <= F.col("__q"), c))).alias("cvar_95"), F.avg((c > 0).cast("double")).alias("win_rate"),
        (F.avg(F.when(c > 0, c)) / -F.avg(F.when(c < 0, c))).alias("win_loss"), F.count_if(dd < -0.05).alias("stress_days"),
    ]
    if weight:
        aggs.append(F.avg("__dw").alias("turnover"))
    out = rows.groupBy(*keys).agg(*aggs)
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 1e-12, F.col("ann_return") / F.col("max_drawdown")))


def checkpoint_metrics(df: DataFrame, keys: Keys, order: str, r: str, weight: str, n: int, wanted: Column, ann: float = 252.0) -> DataFrame:
    """keys, order, ann, vol, sharpe, drawdown, turnover, total over the last ``n`` rows, for rows that ``wanted`` chooses
    and that have as many.

    Frames are gathered for chosen rows only: a row is sent to the checkpoints whose last n rows hold it by
    arithmetic on its position, so the work is checkpoints times n, not rows times n.
    """
    w = along(keys, order)
    rows = df.select(*keys, order, F.col(r).alias("__r"), F.abs(F.col(weight) - F.lag(weight).over(w)).alias("__dw"), wanted.alias("__at"), F.row_number().over(w).alias("__k"))
    ahead = F.collect_list(F.when(F.col("__at") & (F.col("__k") >= n), F.struct(F.col(order).alias("at"), F.col("__k").alias("k")))).over(w.rowsBetween(0, n - 1))
    rows = rows.withColumn("__ahead", ahead).withColumn("__to", F.explode("__ahead")).select(*keys, F.col("__to.at").alias(order), "__k", "__r", "__dw")
    by, x = [*keys, order], F.col("__r")
    rows = equity_curve(rows, by, "__k", "__r")
    return rows.groupBy(*by).agg(
        (F.avg(x) * ann).alias("ann"), (F.stddev_samp(x) * ann**0.5).alias("vol"), sharpe(x, ann).alias("sharpe"), (-F.min("drawdown")).alias("drawdown"), F.avg("__dw").alias("turnover"), F.sum(x).alias("total"),
    )


def vol_control(df: DataFrame, keys: Keys, order: str, r: str, target: float, n: int = 21, ann: float = 252.0) -> DataFrame:
    """keys, mean_vol, vol_cv, vol_deviation of the rolling n-row vol."""
    v = std(F.col(r), roll(along(keys, order), n), n) * ann**0.5
    out = df.withColumn("__v", v).groupBy(*keys)
    return out.agg(
        F.avg("__v").alias("mean_vol"), (F.stddev_pop("__v") / F.avg("__v")).alias("vol_cv"),
        F.abs(F.avg("__v") - target).alias("vol_deviation"),
    )


def active_metrics(df: DataFrame, keys: Keys, order: str, r: str, weight: str, target: float, ann: float = 252.0) -> DataFrame:
    """Metrics over rows with a non-zero return: vol, vol_gap, total_return, cagr, sharpe, max_drawdown, ulcer, turnover."""
    rows = df.withColumn("__dw", F.abs(F.col(weight) - F.lag(weight).over(along(keys, order)))).where(F.col(r) != 0)
    rows = equity_curve(rows, keys, order, r)
    c = F.col(r)
    out = rows.groupBy(*keys).agg(
        ann_vol(c, ann).alias("vol"), (F.exp(F.sum(c)) - 1).alias("total_return"), (F.exp(F.sum(c) * ann / F.count(c)) - 1).alias("cagr"),
        sharpe(c, ann).alias("sharpe"), (-F.min("drawdown")).alias("max_drawdown"),
        F.sqrt(F.avg(F.col("drawdown") * F.col("drawdown"))).alias("ulcer"), F.avg("__dw").alias("turnover"),
    )
    return out.withColumn("vol_gap", F.abs(F.col("vol") - target))


def long_metrics(table: DataFrame, keys: Keys) -> DataFrame:
    """keys, metric, value: the comparison table turned long."""
    names = [c for c, k in table.dtypes if c not in keys and k == "double"]
    return table.unpivot(list(keys), names, "metric", "value")


def window_metrics(df: DataFrame, keys: Keys, order: str, r: str, weight: str, target: float, n: int, shift: int = 0, ann: float = 252.0) -> DataFrame:
    """As of each row, over the last n rows (ending ``shift`` rows before it): obs, ret_20, ret_40,
    momentum, sharpe, drawdown (0 or below), cvar, vol_error, turnover.

    The frame is collected once for drawdown and tail; n is a parameter, so a frame is bounded."""
    w = along(keys, order)
    f, c = roll(w, n, shift), F.col(r)
    rows = df.withColumn("__dw", F.abs(F.col(weight) - F.lag(weight).over(w)))
    rows = rows.withColumns({
        "obs": F.count(c).over(f), "ret_20": F.exp(F.sum(c).over(roll(w, 20, shift))) - 1, "ret_40": F.exp(F.sum(c).over(roll(w, 40, shift))) - 1,
        "__m": F.avg(c).over(f), "__sd": F.stddev_samp(c).over(f), "__q": F.percentile(c, 0.05).over(f),
        "__all": F.collect_list(c).over(f), "turnover_n": F.avg("__dw").over(f),
    })
    step = frame_drawdown(F.col("__all"))
    tail = F.filter(F.col("__all"), lambda x: x <= F.col("__q"))
    return rows.withColumns({
        "momentum": F.col("ret_20") > F.col("ret_40"),
        "sharpe": F.when((F.col("obs") >= 2) & (F.col("__sd") > 0), F.col("__m") / F.col("__sd") * ann**0.5).otherwise(0.0),
        "drawdown_n": step, "cvar_n": F.when(F.size(tail) > 0, -F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)),
        "vol_error": F.abs(F.col("__sd") * ann**0.5 - target),
    }).drop("__dw", "__m", "__sd", "__q", "__all")


def frame_drawdown(returns: Column) -> Column:
    """Drawdown (0 or below) of an array of log returns, from the level before the first."""
    return F.aggregate(
        returns,
        F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("p"), F.lit(0.0).alias("d")),
        lambda s, x: F.struct(
            (s["e"] + x).alias("e"), F.greatest(s["p"], s["e"] + x).alias("p"),
            F.least(s["d"], s["e"] + x - F.greatest(s["p"], s["e"] + x)).alias("d"),
        ),
        lambda s: F.exp(s["d"]) - 1,
    )


def regime_blocks(df: DataFrame, keys: Keys, order: str, label: str) -> DataFrame:
    """Adds block: a number for each run of rows with one label."""
    w = along(keys, order)
    prev = F.lag(label).over(w)
    new = F.when(prev.isNull() | (prev != F.col(label)), 1).otherwise(0)
    return df.withColumn("block", F.sum(new).over(cum(w)))


def worst_block_drawdown(df: DataFrame, keys: Keys, order: str, label: str, r: str, least: int = 10) -> DataFrame:
    """keys, label, n, ann_return, ann_vol, sharpe, worst_drawdown: of blocks of ``least`` rows or more."""
    rows = equity_curve(regime_blocks(df, keys, order, label), [*keys, label, "block"], order, r)
    per = rows.groupBy(*keys, label, "block").agg(F.min("drawdown").alias("dd"), F.count("*").alias("k"))
    worst = per.where(F.col("k") >= least).groupBy(*keys, label).agg(F.min("dd").alias("worst_drawdown"))
    c = F.col(r)
    all_rows = df.groupBy(*keys, label).agg(F.count("*").alias("n"), ann_return(c).alias("ann_return"), ann_vol(c).alias("ann_vol"), sharpe(c).alias("sharpe"))
    return all_rows.join(worst, [*keys, label], "left")


def regime_stats(df: DataFrame, keys: Keys, order: str, label: str, r: str) -> DataFrame:
    """keys, label, days, share, ann_return, ann_vol, sharpe, blocks, mean_block."""
    rows = regime_blocks(df.where(F.col(label).isNotNull()), keys, order, label)
    c = F.col(r)
    out = rows.groupBy(*keys, label).agg(
        F.count("*").alias("days"), ann_return(c).alias("ann_return"), ann_vol(c).alias("ann_vol"), sharpe(c).alias("sharpe"),
        F.countDistinct("block").alias("blocks"),
    )
    total = F.sum("days").over(Window.partitionBy(*keys))
    return out.withColumns({"share": F.col("days") / total, "mean_block": F.col("days") / F.col("blocks")})


def oos_r2_by(df: DataFrame, keys: Keys, order: str, label: str, y: str, forecast: str) -> DataFrame:
    """keys, label, oos_r2 against the lagged expanding mean of ``y``."""
    bench = F.avg(y).over(cum(along(keys, order), 1))
    rows = df.withColumn("__b", bench).where(F.col("__b").isNotNull() & F.col(forecast).isNotNull() & F.col(y).isNotNull())
    se, sb = (F.col(y) - F.col(forecast)), (F.col(y) - F.col("__b"))
    return rows.groupBy(*keys, label).agg((1 - F.sum(se * se) / F.sum(sb * sb)).alias("oos_r2"), F.count("*").alias("n"))


def dispersion(df: DataFrame, by: Keys, metrics: Sequence[str]) -> DataFrame:
    """Median and quartiles over the pairs of each date."""
    aggs = []
    for m in metrics:
        aggs += [F.percentile(m, q).alias(f"{m}_{n}") for n, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75))]
    return df.groupBy(*by).agg(*aggs)


def drawdown_consistency(df: DataFrame, by: Keys, drawdown: str, target: float | None = 0.07) -> DataFrame:
    """Over a key's windows: mean, std, min, max of |drawdown|, its mean distance from a target, and a score,
    the larger the better: minus that distance (without a target: the mean) and the std."""
    a = F.abs(F.col(drawdown))
    out = df.groupBy(*by).agg(
        F.avg(a).alias("dd_mean"), F.stddev_pop(a).alias("dd_std"), F.min(a).alias("dd_min"), F.max(a).alias("dd_max"),
        F.avg(F.abs(a - (target or 0.0))).alias("dd_gap"),
    )
    return out.withColumn("dd_score", -(F.col("dd_gap") + F.col("dd_std")))


def switch_stats(df: DataFrame, keys: Keys, order: str, choice: str, recent: int = 60) -> DataFrame:
    """keys, n, switches, switch_rate, pairs, top_share, recent_switches of a chosen-pair series."""
    w = along(keys, order)
    prev = F.lag(choice).over(w)
    rows = df.withColumns({
        "__s": (prev.isNotNull() & (prev != F.col(choice))).cast("int"),
        "__n": F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))),
    })
    top = rows.groupBy(*keys, choice).count().groupBy(*keys).agg(F.max("count").alias("__top"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("__s").alias("switches"), F.countDistinct(choice).alias("pairs"),
        F.sum(F.when(F.col("__n") <= recent, F.col("__s")).otherwise(0)).alias("recent_switches"),
    )
    out = out.join(top, list(keys))
    return out.withColumns({"switch_rate": F.col("switches") / F.col("n"), "top_share": F.col("__top") / F.col("n")}).drop("__top")


def calibration(df: DataFrame, keys: Keys, forecast: str, realized: str, bins: int = 10) -> DataFrame:
    """keys, bin, n, mean_forecast, mean_realized: equal-count bins by quantile edges, ties together."""
    rows = df.where(F.col(forecast).isNotNull() & F.col(realized).isNotNull())
    qs = [i / bins for i in range(1, bins)]
    edges = rows.groupBy(*keys).agg(F.percentile(forecast, F.array(*[F.lit(q) for q in qs])).alias("__e"))
    at = F.size(F.filter(F.col("__e"), lambda e: e < F.col(forecast))) + 1
    return rows.join(edges, list(keys)).withColumn("bin", at).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(forecast).alias("mean_forecast"), F.avg(realized).alias("mean_realized")
    )
