"""Scalar helpers: guards, losses, labels, and small array arithmetic. All stay JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-12


def num(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def finite(c: Column, default: float | None = None) -> Column:
    """``c`` as double; null, NaN and infinities become ``default`` (bad text too)."""
    d = c.try_cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    return F.when(~bad, d).otherwise(F.lit(default).cast("double"))


def clip(c: Column, low: Column | float | None, high: Column | float | None) -> Column:
    """A null bound doesn't clip; a null value stays null."""
    out = c
    if high is not None:
        out = F.least(out, num(high))
    if low is not None:
        out = F.greatest(out, num(low))
    return F.when(c.isNotNull(), out)


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def qlike(variance: Column, realized: Column, floor: float = TINY) -> Column:
    """ln(variance) + realized / variance, the variance floored (0: no floor)."""
    v = F.greatest(variance, F.lit(floor)) if floor else variance
    return F.log(v) + realized / v


def pair_parts(pair: Column) -> tuple[Column, Column]:
    """(estimator, controller) of ``estimator__controller``."""
    return F.split_part(pair, F.lit("__"), F.lit(1)), F.split_part(pair, F.lit("__"), F.lit(2))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def vol_regime(c: Column) -> Column:
    """low / middle / high from the spellings in use; others null."""
    x = F.lower(F.trim(c))
    return (
        F.when(x.isin("low", "calm", "low_vol"), "low").when(x.isin("mid", "middle", "medium", "normal"), "middle")
        .when(x.isin("high", "high_vol", "volatile", "stress"), "high")
    )


#: Spellings of the sensitivity levels.
SENSITIVITY_NAMES = {
    "very_low": ("very_low", "verylow", "vl"), "low": ("low", "l"), "normal": ("normal", "medium", "mid", "n"),
    "high": ("high", "h"), "very_high": ("very_high", "veryhigh", "vh"),
}


def sensitivity(c: Column, default: str = "normal") -> Column:
    """One of the five levels from the spellings in use; anything else is ``default``."""
    x = F.regexp_replace(F.lower(F.trim(c)), "[ -]+", "_")
    out = F.lit(default)
    for level, names in SENSITIVITY_NAMES.items():
        out = F.when(x.isin(*names), level).otherwise(out)
    return out


def contains_any(text: Column, tokens: list[str]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out |= F.lower(text).contains(t.lower())
    return out


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def array_mean(a: Column) -> Column:
    return F.when(F.size(a) > 0, array_sum(a) / F.size(a))


def array_std(a: Column, ddof: int = 0) -> Column:
    m = array_mean(a)
    return F.when(F.size(a) > ddof, F.sqrt(array_sum(F.transform(a, lambda x: (x - m) * (x - m))) / (F.size(a) - ddof)))


def array_quantile(a: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    s = F.array_sort(F.filter(a, lambda x: x.isNotNull()))
    at = (F.size(s) - 1) * F.lit(q)
    i = F.floor(at).cast("int")
    low, high = F.get(s, i), F.get(s, F.least(i + 1, F.size(s) - 1))
    return F.when(F.size(s) > 0, low + (high - low) * (at - i))


def normalized(weights: Column) -> Column:
    """Weights over their sum; a zero sum gives equal weights."""
    total = array_sum(weights)
    return F.transform(weights, lambda w: F.when(F.abs(total) > TINY, w / total).otherwise(1.0 / F.size(weights)))


def weighted_sum(values: Column, weights: Column) -> Column:
    return array_sum(F.zip_with(values, weights, lambda v, w: v * w))
