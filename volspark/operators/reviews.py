"""Reviews of the active pair: challengers, candidate sources, gates and the vol-target score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along

Keys = Sequence[str]

#: Fixed values by sensitivity: challengers that lift the hold, and days to hold.
GROUP: dict[str, tuple[int, int]] = {"very_low": (4, 90), "low": (3, 60), "normal": (2, 30), "high": (1, 0), "very_high": (1, 0)}


def challengers(ranks: DataFrame, active: DataFrame, keys: Keys, order: str, short: int = 20, sensitivity: str = "normal") -> DataFrame:
    """keys, order, active, hold, short_n, multi_n, held, exception: how many pairs beat the active one.

    ``ranks`` has one row per pair and window (win, rank, sharpe, ann, drawdown), ``active`` the pair and its
    hold. A short-term challenger has the better Sharpe (return, on ties) in the ``short`` window; one of many
    windows has the better rank in two, with no worse Sharpe or drawdown there. The active pair's rows are
    joined once; both counts are conditional aggregates."""
    group, days = GROUP[sensitivity]
    by = [*keys, order]
    now = active.select(*by, "active", "hold").join(ranks, by)
    mine = now.where("pair = active").select(*by, "win", *[F.col(c).alias(f"a_{c}") for c in ("rank", "sharpe", "ann", "drawdown")])
    rows = now.where("pair != active").join(mine, [*by, "win"], "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    quick = (F.col("win") == short) & ((F.col("sharpe") > none("a_sharpe")) | ((F.col("sharpe") >= none("a_sharpe")) & (F.col("ann") > none("a_ann"))))
    beats = (F.col("rank") < F.col("a_rank")) & ((F.col("sharpe") >= F.col("a_sharpe")) | (F.col("drawdown") <= F.col("a_drawdown")))
    pairs = rows.groupBy(*by, "active", "hold", "pair").agg(F.max(quick).alias("quick"), F.count_if(beats).alias("beats"))
    out = pairs.groupBy(*by, "active", "hold").agg(F.count_if("quick").alias("short_n"), F.count_if(F.col("beats") >= 2).alias("multi_n"))
    return out.withColumns({"held": F.col("hold") >= days, "exception": F.col("multi_n") >= group})


def first_source(parts: Sequence[DataFrame], by: Keys) -> DataFrame:
    """Rows of the first part that has any for the key, with its number as ``source``."""
    out = None
    for i, df in enumerate(parts):
        rows = df.withColumn("source", F.lit(i))
        out = rows if out is None else out.unionByName(rows)
    w = Window.partitionBy(*by)
    return out.withColumn("__s", F.min("source").over(w)).where("source = __s").drop("__s")


def vol_target_score(sharpe: Column, edge: Column, vol: Column, vol_error: Column, drawdown: Column, cvar: Column, turnover: Column, target: float) -> Column:
    """Sharpe and its edge over a benchmark, less vol error, vol below 70 % or above 130 % of the target,
    drawdown, CVaR and turnover."""
    zero = F.lit(0.0)
    low, high = F.greatest(target * 0.70 - vol, zero), F.greatest(vol - target * 1.30, zero)
    return 1.35 * sharpe + 0.45 * edge - 4.0 * vol_error - 2.0 * low - 2.5 * high - 1.75 * F.abs(drawdown) - 0.75 * F.abs(cvar) - 0.10 * turnover


def vol_target_order(pair: str = "pair") -> list[Column]:
    """Vol error in millionths first, then -Sharpe, drawdown, turnover, name."""
    return [F.floor(F.round(F.col("vol_error") * 1e6, 2)), -F.col("sharpe"), F.col("drawdown"), F.col("turnover"), F.col(pair)]


def reviewed_switches(df: DataFrame, keys: Keys, order: str, windows: Sequence[int], interval: int = 5, cooldown: int = 20, poor: int = 3, group: int = 2, hold: int = 30, least_windows: int = 2) -> DataFrame:
    """keys, order, active, reason: switches that pass the review gates, as a fold per key.

    Rows hold ``scores`` and one map of ranks per window (``rank_<n>``). A review comes ``interval`` rows after
    the last. Within ``cooldown`` rows of a switch the active pair stays unless its rank is missing or worse
    than ``poor`` in every window; within ``hold`` rows it stays unless ``group`` others rank before it in
    ``least_windows`` windows. Then the best score takes over, ties to the lesser name."""
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", active string, reason string"

    def verdict(active, since, gap, scores, ranks):
        if gap < interval:
            return "interval"
        mine = [r.get(active) for r in ranks]
        if since < cooldown and not all(m is None or m > poor for m in mine):
            return "cooldown"
        if since < hold:
            wins = [sum(1 for m, r in zip(mine, ranks) if p in r and (m is None or r[p] < m)) for p in scores if p != active]
            if sum(n >= least_windows for n in wins) < group:
                return "group"
        return "review"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        active, since, last, rows = None, 0, 0, []
        for i, row in enumerate(zip(pdf["scores"], *[pdf[f"rank_{n}"] for n in windows])):
            scores = {k: v for k, v in dict(row[0] or {}).items() if v is not None and v == v}
            ranks = [dict(r or {}) for r in row[1:]]
            best = min(scores, key=lambda k: (-scores[k], k)) if scores else None
            if active is None:
                active, since, last, reason = best, 0, i, "initial"
            else:
                since += 1
                reason = verdict(active, since, i - last, scores, ranks)
                if reason != "interval":
                    last = i
                if reason == "review":
                    reason = "keep"
                    if best is not None and best != active and scores[best] > scores.get(active, float("-inf")):
                        active, since, reason = best, 0, "switch"
            rows.append((active, reason))
        out = pdf[[*keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["active", "reason"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


def run_length(df: DataFrame, keys: Keys, order: str, choice: str) -> DataFrame:
    """Adds hold: rows since the choice last changed (0 on the row of the change)."""
    w = along(keys, order)
    rows = df.withColumn("__i", F.row_number().over(w))
    new = F.lag(choice).over(w).isNull() | (F.lag(choice).over(w) != F.col(choice))
    rows = rows.withColumn("__f", F.when(new, F.col("__i")))
    start = F.last("__f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("hold", F.col("__i") - start).drop("__i", "__f")
