"""Parameters of portfolios chosen on their first year: every combination is a key, not a loop."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along
from ..sources.series import settled
from . import covariance as C
from . import portfolio as B
from .metrics import sharpe

Keys = Sequence[str]
PARAMS = ("halflife", "max_weight", "max_gross")


def complete(returns: DataFrame, keys: Keys, order: str) -> DataFrame:
    """keys, order, asset, r, n (date's number from 1): each asset of a portfolio on each of its dates, 0 where it
    has no return. Dates and assets meet by the portfolio's key."""
    days = returns.select(*keys, order).distinct().withColumn("n", F.row_number().over(along(keys, order)))
    names = returns.select(*keys, "asset").distinct()
    rows = days.join(names, list(keys)).join(returns.select(*keys, order, "asset", "r"), [*keys, order, "asset"], "left")
    return rows.withColumn("r", F.coalesce("r", F.lit(0.0)))


def target_weights(cov: DataFrame, order: str, caps: Sequence[float], most: Sequence[float], target: float, keys: Keys) -> DataFrame:
    """keys, max_weight, max_gross, order, asset, weight, vol (of the weights held) for every cap and gross limit:
    inverse vols, normalised, capped, scaled to the target vol."""
    raw = B.inverse_vol(cov, order, keys).select(*keys, order, "asset", "weight")
    raw = raw.withColumn("max_weight", F.explode(F.array(*[F.lit(float(c)) for c in caps])))
    cut = B.capped_by_room(raw, order, "max_weight", [*keys, "max_weight"])
    vol = C.portfolio_vol(cov, cut, order, keys=keys, more=["max_weight"])
    rows = cut.join(vol, [*keys, "max_weight", order]).withColumn("max_gross", F.explode(F.array(*[F.lit(float(m)) for m in most])))
    k = F.least(target / F.greatest("vol", F.lit(1e-8)), F.col("max_gross"))
    return rows.select(*keys, "max_weight", "max_gross", order, "asset", (F.col("weight") * k).alias("weight"), (F.col("vol") * k).alias("vol"))


def grid_scores(returns: DataFrame, keys: Keys, order: str, halflives: Sequence[float], caps: Sequence[float], most: Sequence[float], target: float = 0.10, days: int = 252, window: int = 126) -> DataFrame:
    """keys, PARAMS, n, vol_error, turnover, sharpe, score of every combination on a portfolio's first ``days`` dates.

    ``returns`` is a ``complete`` panel. The weights of a date are made from the ``window`` dates before it and earn
    the next date's return; score = mean |vol - target| + 0.02 mean turnover - 0.01 Sharpe, the less the better.
    Combinations with fewer than 20 dates are left out.
    """
    last = F.least(F.lit(days), F.max("n").over(Window.partitionBy(*keys)) - 2)
    train = returns.withColumn("__last", last).where(F.col("n") <= F.col("__last")).drop("__last")
    panel = C.pair_panel(train, "asset", order, "r", keys)
    panel = panel.withColumn("halflife", F.explode(F.array(*[F.lit(float(h)) for h in halflives])))
    by, all_ = [*keys, "halflife"], [*keys, *PARAMS]
    cov = settled(C.ewma(panel, order, "halflife", window, keys=by).where("cov IS NOT NULL").select(*by, order, "i", "j", "cov"), "grid-cov")
    rows = target_weights(cov, order, caps, most, target, by)
    w = along([*keys, "asset"], order)
    ahead = train.select(*keys, order, "asset", F.lead("r").over(w).alias("__next")).where("__next IS NOT NULL")
    rows = rows.join(ahead, [*keys, order, "asset"])
    rows = rows.withColumn("__dw", F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(along([*all_, "asset"], order)), F.lit(0.0))))
    day = rows.groupBy(*all_, order).agg(F.sum(F.col("weight") * F.col("__next")).alias("__r"), F.abs(F.first("vol") - target).alias("__e"), F.sum("__dw").alias("__t"))
    out = day.groupBy(*all_).agg(F.count("*").alias("n"), F.avg("__e").alias("vol_error"), F.avg("__t").alias("turnover"), sharpe(F.col("__r")).alias("sharpe"))
    return out.where("n >= 20").withColumn("score", F.col("vol_error") + 0.02 * F.col("turnover") - 0.01 * F.col("sharpe"))


def best_params(scores: DataFrame, keys: Keys) -> DataFrame:
    """keys, PARAMS of the least score (ties, to nine digits, to the lesser parameters)."""
    best = F.min_by(F.struct(*PARAMS), F.struct(F.round("score", 9), *PARAMS))
    return scores.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def tuned_ledger(returns: DataFrame, best: DataFrame, keys: Keys, order: str, target: float = 0.10, window: int = 126, bps: float = 5.0, rf: str | None = None) -> DataFrame:
    """The ledger of every portfolio under its own best parameters, over all dates of the ``complete`` panel."""
    best = settled(best, "best-params")
    panel = C.pair_panel(returns, "asset", order, "r", keys).join(best.select(*keys, "halflife"), list(keys))
    by = [*keys, "halflife"]
    cov = settled(C.ewma(panel, order, "halflife", window, keys=by).where("cov IS NOT NULL").select(*by, order, "i", "j", "cov"), "tuned-cov")
    raw = B.inverse_vol(cov, order, by).join(best, by).select(*keys, *PARAMS, order, "asset", "weight")
    cut = B.capped_by_room(raw, order, "max_weight", [*keys, *PARAMS])
    weights = B.to_target(cut, cov, order, target, "max_gross", by, ["max_weight", "max_gross"])
    return B.portfolio_ledger(weights, returns, order, bps, keys=keys, rf=rf)
