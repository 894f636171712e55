"""Windows over (keys, order): trailing frames gated by a count, as pandas' ``min_periods``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def along(keys: Sequence[str], order: str | Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*([order] if isinstance(order, str) else order))


def roll(w: WindowSpec, n: int, shift: int = 0) -> WindowSpec:
    """The last n rows up to ``shift`` rows before the current one."""
    return w.rowsBetween(-(n - 1) - shift, -shift)


def cum(w: WindowSpec, shift: int = 0) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -shift)


def gated(value: Column, c: Column, w: WindowSpec, least: int) -> Column:
    """``value`` over the frame where it has ``least`` non-null values of ``c``."""
    return F.when(F.count(c).over(w) >= least, value)


def std(c: Column, w: WindowSpec, least: int = 2) -> Column:
    return gated(F.stddev_samp(c).over(w), c, w, max(least, 2))


def mean(c: Column, w: WindowSpec, least: int = 1) -> Column:
    return gated(F.avg(c).over(w), c, w, least)


def total(c: Column, w: WindowSpec, least: int = 1) -> Column:
    return gated(F.sum(c).over(w), c, w, least)


def quantile(c: Column, q: float, w: WindowSpec, least: int = 1) -> Column:
    """Exact, linear (``median`` isn't allowed over a frame; this with 0.5 is)."""
    return gated(F.percentile(c, q).over(w), c, w, least)


def ffill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(cum(w))


def bfill(c: Column, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))


def bias_corrected_skew(c: Column, w: WindowSpec) -> Column:
    """Skewness as pandas has it: the population form times sqrt(n (n - 1)) / (n - 2)."""
    n = F.count(c).over(w)
    return F.when(n > 2, F.skewness(c).over(w) * F.sqrt(n * (n - 1)) / (n - 2))
