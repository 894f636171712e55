"""Walk-forward protocols: splits, train-window metrics, champions, and the rolling regime mix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qlike
from ..functions.frames import along
from . import metrics as M
from .joins import labelled_past
from .ranking import best_of, tolerance_cascade
from .windows import equity_curve

Keys = Sequence[str]


def splits(df: DataFrame, keys: Keys, order: str, train: int = 504, test: int = 126, step: int = 126) -> DataFrame:
    """Rows of each split: split, role (train / test) and the row itself. Split k trains on rows
    k step .. k step + train - 1 (by position) and tests on the ``test`` rows behind.

    A row finds its splits by arithmetic on its position, so there is no range join."""
    w = along(keys, order)
    n = F.max("__i").over(Window.partitionBy(*keys))
    rows = df.withColumn("__i", F.dense_rank().over(w) - 1).withColumn("__n", n + 1)
    last = F.floor((F.col("__n") - train - 1) / step)
    first = F.greatest(F.ceil((F.col("__i") - train - test + 1) / step), F.lit(0))
    upto = F.least(F.floor(F.col("__i") / step), last)
    rows = rows.withColumn("split", F.explode(F.when(first <= upto, F.sequence(first.cast("int"), upto.cast("int"))).otherwise(F.array().cast("array<int>"))))
    role = F.when(F.col("__i") < F.col("split") * step + train, "train").otherwise("test")
    return rows.withColumn("role", role).drop("__i", "__n")


def train_metrics(rows: DataFrame, keys: Keys, order: str, r: str, vol: str, weight: str, asset_r: str, target: float, ann: float = 252.0) -> DataFrame:
    """Per key: n, sharpe, drawdown (loss), vol_error, tail_loss, turnover, qlike."""
    rows = equity_curve(rows, keys, order, r)
    rows = rows.withColumn("__dw", F.abs(F.col(weight) - F.lag(weight).over(along(keys, order))))
    cut = rows.groupBy(*keys).agg(F.percentile(r, 0.05).alias("__q"))
    c, v = F.col(r), F.col(vol) * F.col(vol) / ann
    loss = F.when(F.col(vol) > 0, qlike(v, F.col(asset_r) * F.col(asset_r)))
    return rows.join(cut, list(keys)).groupBy(*keys).agg(
        F.count("*").alias("n"), M.sharpe(c, ann).alias("sharpe"), (-F.min("drawdown")).alias("drawdown"), F.abs(F.stddev_samp(c) * ann**0.5 - target).alias("vol_error"),
        (-F.avg(F.when(c <= F.col("__q"), c))).alias("tail_loss"), F.coalesce(F.avg("__dw"), F.lit(0.0)).alias("turnover"), F.avg(loss).alias("qlike"),
    )


def champion_score() -> Column:
    """Sharpe - drawdown / 2 - turnover / 2 - vol error / 2 - QLIKE."""
    return F.col("sharpe") - 0.5 * F.col("drawdown") - 0.5 * F.col("turnover") - 0.5 * F.col("vol_error") - F.coalesce("qlike", F.lit(0.0))


def champions(table: DataFrame, by: Keys) -> DataFrame:
    return best_of(table, by, F.round(champion_score(), 9))


def walk_forward(ledger: DataFrame, keys: Keys, order: str, target: float = 0.10, train: int = 504, test: int = 126) -> tuple[DataFrame, DataFrame]:
    """(champions, test rows): per split the train window's champion, and what it earns in the test."""
    rows = splits(ledger, [*keys, "pair"], order, train, test, test)
    table = train_metrics(rows.where("role = 'train'"), [*keys, "split", "pair"], order, "ret", "vol", "weight", "r", target)
    best = champions(table, [*keys, "split"])
    return best, rows.where("role = 'test'").join(best.select(*keys, "split", "pair"), [*keys, "split", "pair"])


def routed_splits(scores: DataFrame, keys: Keys, order: str, configs: dict[str, tuple[str, bool]], train: int = 504, test: int = 126, sticky: int = 5) -> DataFrame:
    """config, keys, split, order, selected, switched, score: the sticky selection run afresh in the test
    rows of every split. A config names its score column, and whether scores are frozen as of the last
    train row; ablations differ in the column, so all configs share one pass over the splits."""
    from .routing import score_map, sticky_argmax

    rows = splits(scores, [*keys, "pair"], order, train, test, test)
    w = Window.partitionBy(*keys, "split", "pair")
    at = F.when(F.col("role") == "train", F.col(order))
    options = []
    for name, (col, freeze) in configs.items():
        score = F.max_by(col, at).over(w) if freeze else F.col(col)
        options.append(F.struct(F.lit(name).alias("config"), score.alias("score")))
    long = rows.withColumn("__c", F.array(*options)).where("role = 'test'").select(*keys, "split", "pair", order, F.inline("__c"))
    by = ["config", *keys, "split"]
    return sticky_argmax(score_map(long, by, order, "pair", "score"), by, order, sticky)


def oos_summary(rows: DataFrame, keys: Keys, order: str, ann: float = 252.0) -> DataFrame:
    """Per key: n, sharpe, calmar, cvar_95 of the routed returns, those of buy and hold, the excess."""
    a = M.performance(rows, keys, order, "ret", ann=ann).select(*keys, "n", "sharpe", "calmar", "cvar_95")
    b = M.performance(rows, keys, order, "r", ann=ann).select(*keys, F.col("sharpe").alias("bh_sharpe"), F.col("calmar").alias("bh_calmar"), F.col("cvar_95").alias("bh_cvar_95"))
    return a.join(b, list(keys)).withColumn("excess_sharpe", F.col("sharpe") - F.col("bh_sharpe"))


def regime_mix(ledger: DataFrame, labels: DataFrame, keys: Keys, order: str, regime: str = "regime", months: int = 24, every: int = 21) -> DataFrame:
    """keys, as_of, regime, objective, pair: per decision date, the winners among rows of its regime in
    the months before, for Sharpe, drawdown, CVaR and the tolerance cascade."""
    days = labels.withColumn("__n", F.row_number().over(along(keys, order)))
    when = days.where((F.col("__n") % every == 0) & F.col(regime).isNotNull()).select(*keys, F.col(order).alias("as_of"), regime)
    past = labelled_past(when, ledger, labels, keys, order, regime, months)
    by = [*keys, "as_of", regime]
    table = train_metrics(past, [*by, "pair"], order, "ret", "vol", "weight", "r", 0.10)
    turn = F.col("turnover")
    objectives = {
        "sharpe": -F.round(F.col("sharpe") - 0.5 * turn, 9), "drawdown": F.round(F.col("drawdown") + 0.04 * turn, 9), "cvar": F.round(F.col("tail_loss"), 9),
    }
    best = table.groupBy(*by).agg(*[F.min_by("pair", F.when(v.isNotNull(), F.struct(v, "pair"))).alias(n) for n, v in objectives.items()])
    out = best.unpivot(by, list(objectives), "objective", "pair").where("pair IS NOT NULL")
    rounded = table.withColumns({c: F.round(c, 9) for c in ("turnover", "drawdown", "sharpe")})
    last = tolerance_cascade(rounded, by, [("turnover", 0.01, True), ("drawdown", 0.01, True), ("sharpe", 0.0, False)])
    return out.unionByName(last.select(*by, F.lit("ultimate").alias("objective"), "pair"))
