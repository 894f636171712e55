"""Wanted weights of the position rules: windows over forecasts and returns, before the fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.frames import along, roll, std
from .fold import Rule, linear_brake

Keys = Sequence[str]
EPS = 1e-8


def scaled(vol: str, target: float) -> Column:
    """target / vol; null (hold) where the forecast is missing or not positive."""
    return F.when(F.col(vol) > 0, target / F.greatest(F.col(vol), F.lit(EPS)))


def inverse_variance(vol: str, target: float, keys: Keys, order: str, n: int = 252) -> Column:
    """target times the mean of the last n valid forecasts over the forecast's square."""
    ok = F.when(F.col(vol) > 0, F.col(vol))
    bar = F.avg(ok).over(roll(along(keys, order), n))
    return F.when(ok.isNotNull(), target * bar / F.greatest(ok * ok, F.lit(EPS)))


def regime_scaled(vol: str, target: float, keys: Keys, order: str, n: int = 252, q: float = 0.8, high: float = 0.5) -> Column:
    """Half the weight where the forecast is at or above the q quantile of the last n (50 at least)."""
    ok = F.when(F.col(vol) > 0, F.col(vol))
    f = roll(along(keys, order), n)
    hot = (F.count(ok).over(f) >= max(20, int(0.2 * n))) & (ok >= F.percentile(ok, q).over(f))
    return scaled(vol, target) * F.when(hot, high).otherwise(1.0)


def trend_gate(r: str, keys: Keys, order: str, n: int = 63, floor: float = 0.85, slope: float = 0.75, hard: bool = False) -> Column:
    f, c = roll(along(keys, order), n), F.col(r)
    sd = F.stddev_samp(c).over(f)
    z = F.when((F.count(c).over(f) >= max(5, n // 5)) & (sd > 0), F.avg(c).over(f) / sd).otherwise(0.0)
    if hard:
        return F.when(F.count(c).over(f) < max(5, n // 5), 1.0).when(z > 0, 1.0).otherwise(floor)
    return clip(0.5 + 0.5 * F.tanh(slope * z), floor, 1.0)


def expected_shortfall(r: str, keys: Keys, order: str, n: int = 252, alpha: float = 0.95) -> Column:
    """Mean of the losses at or above their alpha quantile, over the last n rows (n / 4 at least)."""
    f, loss = roll(along(keys, order), n), -F.col(r)
    cut = F.percentile(loss, alpha).over(f)
    tail = F.filter(F.collect_list(loss).over(f), lambda x: x >= cut)
    return F.when(F.count(loss).over(f) >= max(20, n // 4), F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / F.size(tail))


def es_scaled(r: str, es_target: float, keys: Keys, order: str, n: int = 252) -> Column:
    es = expected_shortfall(r, keys, order, n)
    return F.when(es > 0, es_target / F.greatest(es, F.lit(EPS)))


def shock_throttled(vol: str, target: float, keys: Keys, order: str, n: int = 30, shock: float = 1.75, cut: float = 0.5) -> Column:
    """The weight cut where the forecast is ``shock`` times the median of the last n (5 at least)."""
    ok = F.when(F.col(vol) > 0, F.col(vol))
    f = roll(along(keys, order), n)
    hot = (F.count(ok).over(f) >= 5) & (ok >= shock * F.percentile(ok, 0.5).over(f))
    return scaled(vol, target) * F.when(hot, cut).otherwise(1.0)


def peg_multiplier(r: str, soft: float = 0.0015, hard: float = 0.006) -> Column:
    """1 up to a deviation of ``soft`` of the last return, falling to 0 at ``hard``."""
    dev = F.abs(F.expm1(F.coalesce(F.col(r), F.lit(0.0))))
    return clip(1 - (dev - soft) / (hard - soft), 0.0, 1.0)


def tail_gate(r: str, keys: Keys, order: str, limit: float, n: int = 252, floor: float = 0.5) -> Column:
    es = expected_shortfall(r, keys, order, n)
    return F.coalesce(clip(limit / F.greatest(es, F.lit(EPS)), floor, 1.0), F.lit(1.0))


def combined(gates: Sequence[Column], mode: str = "min") -> Column:
    if mode == "product":
        out = gates[0]
        for g in gates[1:]:
            out = out * g
        return out
    return F.least(*gates) if mode == "min" else sum(gates[1:], gates[0]) / len(gates)


#: Rules of the named controllers.
RULES: dict[str, Rule] = {
    "constant": Rule(band=0.0), "naive_scaling": Rule(), "clip": Rule(high=1.5), "hysteresis": Rule(inclusive=True, high=1.5), "variance": Rule(),
    "regime": Rule(high=2.0), "trend": Rule(high=1.5), "es": Rule(high=1.5), "drawdown_brake": Rule(brake=linear_brake(0.10, 0.30, 1.0, 0.75), high=1.5),
    "drawdown_modulated": Rule(brake=linear_brake(0.10, 0.30, 0.35, 0.65), high=1.5),
    "priority": Rule(brake=linear_brake(0.10, 0.30, 1.0, 0.8), high=1.5, inclusive=True, step_up=0.35, step_down=0.35, gates=2),
    "shock": Rule(band=0.025, step_up=0.20, step_down=0.75), "peg": Rule(band=0.01, brake=linear_brake(0.02, 0.08), step_up=0.25, step_down=0.25),
}


def priority_gates(r: str, keys: Keys, order: str, limit: float = 0.03, floor: float = 0.80) -> Column:
    """Sum of the priority stack's trend and tail gates; the fold averages them with its drawdown gate."""
    return trend_gate(r, keys, order, 63, floor, hard=True) + tail_gate(r, keys, order, limit, 252, floor)


def wanted(name: str, vol: str, r: str, target: float, keys: Keys, order: str) -> Column:
    """The wanted weight of a named controller."""
    if name == "constant":
        return F.lit(1.0)
    if name == "variance":
        return inverse_variance(vol, target, keys, order)
    if name == "regime":
        return regime_scaled(vol, target, keys, order)
    if name == "trend":
        return scaled(vol, target) * trend_gate(r, keys, order)
    if name == "es":
        return es_scaled(r, target / 5, keys, order)
    if name == "shock":
        return shock_throttled(vol, target, keys, order)
    if name == "peg":
        return scaled(vol, target) * peg_multiplier(r)
    if name == "priority":
        return clip(scaled(vol, target), 0.0, 1.5)
    return scaled(vol, target)
