"""Rankings of pairs as of a date: multi-key orders, tie bands, tolerance cascades and pools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along

Keys = Sequence[str]


def ranked(df: DataFrame, by: Keys, order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def train_order(pair: str = "pair") -> list[Column]:
    """Turnover, drawdown, -Sharpe, vol error, QLIKE, then the name."""
    return [F.col("turnover"), F.col("drawdown"), -F.col("sharpe"), F.col("vol_error"), F.col("qlike"), F.col(pair)]


def tie_band_order(band: float = 0.05, pair: str = "pair") -> list[Column]:
    """Sharpe in steps of ``band`` first, then drawdown, turnover, CVaR, -return, name."""
    return [-F.floor(F.col("sharpe") / band), F.col("drawdown"), F.col("turnover"), F.col("cvar"), -F.col("ret"), F.col(pair)]


def best_of(df: DataFrame, by: Keys, value: Column, pair: str = "pair", largest: bool = True) -> DataFrame:
    """by, pair, value: the best pair (ties to the lesser name), by a grouped aggregate."""
    v = -value if largest else value
    return df.where(value.isNotNull()).groupBy(*by).agg(F.min_by(F.struct(pair, value.alias("value")), F.struct(v, pair)).alias("__b")).select(*by, "__b.*")


def tolerance_cascade(df: DataFrame, by: Keys, steps: Sequence[tuple[str, float, bool]], pair: str = "pair") -> DataFrame:
    """Filters by steps (column, tolerance, smallest first): each keeps rows within the tolerance of
    the best left; the last one's best, by name on ties, stays."""
    w = Window.partitionBy(*by)
    for col, tol, low in steps:
        best = F.min(col).over(w) if low else F.max(col).over(w)
        df = df.withColumn("__b", best).where((F.col(col) <= F.col("__b") + tol) if low else (F.col(col) >= F.col("__b") - tol)).drop("__b")
    col, _, low = steps[-1]
    return ranked(df, by, [F.col(col) if low else -F.col(col), F.col(pair)], "__n").where("__n = 1").drop("__n")


def turnover_buckets(df: DataFrame, by: Keys, pair: str = "pair", least: float = 0.0025) -> DataFrame:
    """Adds turnover_bucket and rank: pairs sorted by turnover are cut where a gap exceeds the mean
    positive gap (``least`` at least); inside a bucket drawdown, then -Sharpe, decide."""
    w = Window.partitionBy(*by).orderBy("turnover", pair)
    rows = df.withColumn("__g", F.col("turnover") - F.lag("turnover").over(w))
    width = F.greatest(F.coalesce(F.avg(F.when(F.col("__g") > 0, F.col("__g"))).over(Window.partitionBy(*by)), F.lit(0.0)), F.lit(least))
    rows = rows.withColumn("__w", width)
    cut = F.coalesce((F.col("__g") > F.col("__w")).cast("int"), F.lit(0))
    rows = rows.withColumn("turnover_bucket", F.sum(cut).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__g", "__w")
    return ranked(rows, by, [F.col("turnover_bucket"), F.col("drawdown"), -F.col("sharpe"), F.col(pair)])


def top_with_forced(df: DataFrame, k: int, forced: Column, rank: str = "rank") -> DataFrame:
    return df.where((F.col(rank) <= k) | forced)


def pool(parts: dict[str, DataFrame], by: Keys, pair: str = "pair") -> DataFrame:
    """by, pair, sources: the union of several top lists, each pair once with the lists that name it."""
    out = None
    for name, df in parts.items():
        rows = df.select(*by, pair, F.lit(name).alias("__s"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(*by, pair).agg(F.concat_ws(",", F.array_sort(F.collect_set("__s"))).alias("sources"))


def before_date(df: DataFrame, order: str, date: str) -> DataFrame:
    return df.where(F.col(order) < F.lit(date).cast("date"))


def train_shape(sharpe: Column, drawdown: Column, turnover: Column, vol: Column, target: float) -> Column:
    return sharpe - 0.75 * drawdown - 0.05 * turnover - 0.15 * F.abs(vol - target) / target


def regime_block_ranks(rows: DataFrame, by: Keys, order: str, regime: str = "regime", pair: str = "pair", least: int = 20, ann: float = 252.0) -> DataFrame:
    """by, regime, pair, n, metrics, rank: pairs ranked by the tie-band order on the past rows that carry
    one regime, where a pair has ``least`` of them. ``rows`` have ret and dw (the change of weight)."""
    from . import metrics as M
    from .windows import equity_curve

    key = [*by, regime, pair]
    rows = equity_curve(rows, key, order, "ret")
    rows = M.with_quantile(rows, key, "ret", 0.05, "__q")
    c = F.col("ret")
    out = rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.round(M.sharpe(c, ann), 8).alias("sharpe"), F.round(-F.min("drawdown"), 8).alias("drawdown"), F.round(F.avg("dw"), 8).alias("turnover"),
        F.round(-F.avg(F.when(c <= F.col("__q"), c)), 8).alias("cvar"), F.round(F.avg(c) * ann, 8).alias("ret"),
    )
    return ranked(out.where(F.col("n") >= least), [*by, regime], tie_band_order(pair=pair))


def calibrated_score(vol_error: Column, drawdown: Column, turnover: Column, sharpe: Column) -> Column:
    """Vol error + |drawdown| / 2 + turnover / 50 - Sharpe / 20; the least is best, after the vol error."""
    return vol_error + 0.5 * F.abs(drawdown) + 0.02 * turnover - 0.05 * sharpe


def borrowed_regimes(df: DataFrame, by: Keys, regime: str, names: Sequence[str]) -> DataFrame:
    """Rows by regime; a regime without rows as of a key borrows all of that key's rows."""
    have = df.groupBy(*by).agg(F.collect_set(regime).alias("__h"))
    lack = have.select(*by, F.explode(F.filter(F.array(*[F.lit(n) for n in names]), lambda x: ~F.array_contains("__h", x))).alias("__r"))
    lent = df.join(lack, list(by)).withColumn(regime, F.col("__r")).drop("__r")
    return df.withColumn("borrowed", F.lit(False)).unionByName(lent.withColumn("borrowed", F.lit(True)))
