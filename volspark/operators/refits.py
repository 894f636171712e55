"""Forecasts whose parameters are chosen again every N rows, on rows before the refit, and held until the next."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll, std
from ..sources.series import settled
from .forecast import CURVE, ewma_window, learned

Keys = Sequence[str]
ANN = 252.0
#: (alpha, gamma, beta) of a GJR variance recursion; omega follows from the window's mean square. Combinations with
#: alpha + gamma / 2 + beta of 0.9999 or more are no fit.
GRID = [(a, g, b) for a in (0.03, 0.08, 0.15) for g in (0.0, 0.06, 0.12) for b in (0.70, 0.80, 0.90) if a + g / 2 + b < 0.9999]
PARAMS = ("omega", "alpha", "gamma", "beta")
#: Rows that a first variance is the mean square of.
SEED = 20


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def _squares(seen: Column) -> Column:
    return F.transform(seen, lambda x: x * x)


def _next(v: Column, x: Column, p: Column) -> Column:
    """The variance after a return ``x``, given its own variance."""
    leverage = F.when(x < 0, p["gamma"]).otherwise(0.0)
    return F.greatest(p["omega"] + (p["alpha"] + leverage) * x * x + p["beta"] * v, F.lit(1e-18))


def likeliest(seen: Column, grid: Sequence[tuple[float, float, float]] = GRID) -> Column:
    """The struct of PARAMS from the grid by which the returns ``seen`` (in order) are likeliest; ties, to six
    digits, go to the lesser parameters."""
    level, first = _mean(_squares(seen)), _mean(_squares(F.slice(seen, 1, SEED)))
    options = F.array(*[F.struct(((1 - a - g / 2 - b) * level).alias("omega"), *[F.lit(float(x)).alias(n) for n, x in zip(PARAMS[1:], (a, g, b))]) for a, g, b in grid])
    start = F.struct(F.greatest(first, F.lit(1e-18)).alias("v"), F.lit(0.0).alias("l"))

    def told(p: Column) -> Column:
        step = lambda s, x: F.struct(_next(s["v"], x, p).alias("v"), (s["l"] - 0.5 * (F.log(2 * math.pi * s["v"]) + x * x / s["v"])).alias("l"))
        return F.aggregate(seen, start, step, lambda s: s["l"])

    scored = F.transform(options, lambda p: F.struct((-F.round(told(p), 6)).alias("loss"), p["alpha"].alias("a"), p["gamma"].alias("g"), p["beta"].alias("b"), p.alias("p")))
    return F.array_min(scored)["p"]


def gjr_recalibrated(df: DataFrame, keys: Keys, order: str, r: str, n: int = 252, least: int = 126, every: int = 63, halflife: float = 21.0, grid: Sequence[tuple[float, float, float]] = GRID, ann: float = ANN) -> DataFrame:
    """Adds params (of the last refit), gjr and gjr_source (model, ewma or realized).

    Every ``every`` rows from the first with ``least`` rows before it, the parameters are chosen by likelihood over
    the ``n`` rows before; a row's forecast runs them through its own ``n`` rows before. Where there are too few
    rows or no positive forecast it is the EWMA vol of that window, else its realised vol, else null.
    """
    w = along(keys, order)
    f = roll(w, n, 1)
    rows = df.withColumns({"__seen": F.collect_list(r).over(f), "__i": F.row_number().over(w), "__ewma": ewma_window(F.col(r), keys, order, n, halflife, ann), "__std": std(F.col(r), f, 2) * ann**0.5})
    seen = F.col("__seen")
    due = (F.size(seen) >= least) & ((F.col("__i") - 1 - least) % every == 0)
    rows = rows.withColumn("__fit", F.when(due, likeliest(seen, grid)))
    rows = rows.withColumn("params", F.last("__fit", ignorenulls=True).over(cum(w)))
    p = F.col("params")
    v = F.aggregate(seen, F.greatest(_mean(_squares(F.slice(seen, 1, SEED))), F.lit(1e-18)), lambda s, x: _next(s, x, p))
    rows = rows.withColumn("__v", F.when((F.size(seen) >= least) & p.isNotNull(), F.sqrt(v * ann)))
    chain = [F.when(F.col(c) > 0, F.struct(F.col(c).alias("v"), F.lit(n_).alias("s"))) for c, n_ in (("__v", "model"), ("__ewma", "ewma"), ("__std", "realized"))]
    best = F.coalesce(*chain)
    return rows.withColumns({"gjr": best["v"], "gjr_source": best["s"]}).select(*df.columns, "params", "gjr", "gjr_source")


def spaced_refits(df: DataFrame, keys: Keys, order: str, label: str, ready: str, every: int = 63) -> DataFrame:
    """Adds refit: a label is fitted at its first row that is ``ready`` and again at the first such row of the
    label ``every`` rows or more after. One fold per series over small integers; a null label takes no step."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", refit boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        last: dict = {}
        out, i = [], 0
        for k, ok in zip(pdf[label].tolist(), pdf[ready].tolist()):
            due = False
            if k is not None and k == k:
                i += 1
                due = bool(ok) and (k not in last or i - last[k] >= every)
                if due:
                    last[k] = i
            out.append(due)
        return pdf.assign(refit=out)

    return df.groupBy(*keys).applyInPandas(run, schema)


def variance_regimes(df: DataFrame, keys: Keys, order: str, r: str, n: int = 252, least: int = 126, low: float = 0.33, high: float = 0.67) -> DataFrame:
    """Adds regime (0 low, 1 middle, 2 high; null with under ``least`` rows before): the five-row mean square of the
    row before against its own quantiles over the ``n`` rows before; and own: the returns of those rows that
    lie in the same regime by the same bounds, in order."""
    w = along(keys, order)
    f, five = roll(w, n, 1), roll(w, 5)
    rows = df.withColumn("__q", F.col(r) * F.col(r))
    rows = rows.withColumn("__rv", F.when(F.count("__q").over(five) >= 3, F.avg("__q").over(five)))
    rows = rows.withColumns({
        "__now": F.lag("__rv").over(w), "__lo": F.percentile("__rv", low).over(f), "__hi": F.percentile("__rv", high).over(f), "__k": F.count("__rv").over(f),
        "__n": F.count(r).over(f), "__all": F.collect_list(F.when(F.col("__rv").isNotNull(), F.struct(F.col(r).alias("r"), F.col("__rv").alias("v")))).over(f),
    })
    regime = F.when(F.col("__k") < 10, 1).when(F.col("__now") < F.col("__lo"), 0).when(F.col("__now") >= F.col("__hi"), 2).otherwise(1)
    rows = rows.withColumn("regime", F.when(F.col("__n") >= least, regime))
    of = lambda v: F.when(v < F.col("__lo"), 0).when(v >= F.col("__hi"), 2).otherwise(1)
    own = F.transform(F.filter("__all", lambda x: of(x["v"]) == F.col("regime")), lambda x: x["r"])
    return rows.withColumn("own", own).select(*df.columns, "regime", "own")


def tail_factor(r: Column, keys: Keys, order: str, n: int = 63, q: float = 0.90, most: float = 1.5) -> Column:
    """Root of the mean square beyond the q quantile of the n squares before (five at least) over their mean, in
    [1, most]; 1 where there are fewer. The threshold plus the mean excess is what a tail fitted by moments expects."""
    f = roll(along(keys, order), n, 1)
    sq = r * r
    cut = F.percentile(sq, q).over(f)
    tail = F.filter(F.collect_list(sq).over(f), lambda x: x > cut)
    mean = F.avg(sq).over(f)
    k = F.sqrt(F.greatest(_mean(tail), mean) / mean)
    return F.when((F.count(sq).over(f) >= 10) & (F.size(tail) >= 5) & (mean > 0), F.least(F.greatest(k, F.lit(1.0)), F.lit(most))).otherwise(1.0)


def regime_gjr(df: DataFrame, keys: Keys, order: str, r: str, n: int = 252, least: int = 126, every: int = 63, halflife: float = 21.0, grid: Sequence[tuple[float, float, float]] = GRID, ann: float = ANN) -> DataFrame:
    """keys, order, regime, refit, regime_gjr: a GJR variance with parameters and state of its own in each regime.

    ``variance_regimes`` names the active regime of a row; its parameters are the likeliest on the window's returns
    of that regime (31 at least), chosen again by ``spaced_refits``. The last return advances the active regime's
    state alone, the forecast is one step from there; in the high regime it is raised by ``tail_factor``. Without
    a forecast in (0, 5) it is the EWMA vol of the window, else its realised vol.
    """
    f = roll(along(keys, order), n, 1)
    rows = df.select(*keys, order, r).withColumns({"__tail": tail_factor(F.col(r), keys, order), "__ewma": ewma_window(F.col(r), keys, order, n, halflife, ann), "__std": std(F.col(r), f, 2) * ann**0.5, "__last": F.lag(r).over(along(keys, order))})
    rows = variance_regimes(rows, keys, order, r, n, least).withColumn("__ok", F.size("own") >= max(20, least // 4))
    flags = spaced_refits(rows.select(*keys, order, "regime", "__ok"), keys, order, "regime", "__ok", every)
    rows = rows.join(flags.select(*keys, order, "refit"), [*keys, order])
    own = F.col("own")
    m = _mean(own)
    rows = rows.withColumn("__p", F.when(F.col("refit"), likeliest(own, grid)))
    rows = rows.withColumn("__v0", F.when(F.col("refit"), F.aggregate(own, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / (F.size(own) - 1)))
    rows = rows.withColumn("__x0", F.when(F.col("refit"), F.element_at(own, -1)))
    fields = [F.col("__p")[c].alias(f"__{c}") for c in PARAMS]
    rows = rows.select(*keys, order, "regime", "refit", "__last", "__v0", "__x0", "__tail", "__ewma", "__std", *fields)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", regime int, refit boolean, __var double, __tail double, __ewma double, __std double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        fit: list = [None] * 3
        var, sq, neg = [np.nan] * 3, [np.nan] * 3, [0.0] * 3
        out = []
        for k, due, x, v0, x0, *p in zip(*(pdf[c].tolist() for c in ("regime", "refit", "__last", "__v0", "__x0", *[f"__{c}" for c in PARAMS]))):
            if k is None or k != k:
                out.append(np.nan)
                continue
            k = int(k)
            if due:
                fit[k] = p
                if not np.isfinite(var[k]):
                    var[k], sq[k], neg[k] = max(v0, 1e-16), x0 * x0, float(x0 < 0)
            if fit[k] is None:
                sq[k], neg[k] = x * x, float(x < 0)
                out.append(np.nan)
                continue
            o, a, g, b = fit[k]
            var[k] = max(o + (a + g * neg[k]) * sq[k] + b * var[k], 1e-18)
            sq[k], neg[k] = x * x, float(x < 0)
            out.append(o + (a + g * neg[k]) * sq[k] + b * var[k])
        return pdf[[*keys, order, "regime", "refit"]].assign(__var=out, **{c: pdf[c] for c in ("__tail", "__ewma", "__std")})

    rows = rows.groupBy(*keys).applyInPandas(run, schema)
    vol = F.sqrt(F.nanvl("__var", F.lit(None).cast("double")) * ann)
    vol = F.when((vol > 0) & (vol < 5), vol * F.when(F.col("regime") == 2, F.col("__tail")).otherwise(1.0))
    chain = F.coalesce(vol, F.when(F.col("__ewma") > 0, F.col("__ewma")), F.when(F.col("__std") > 0, F.col("__std")))
    return rows.select(*keys, order, "regime", "refit", chain.alias("regime_gjr"))


def refit_dates(df: DataFrame, order: str, warm: int = 24, months: int = 6) -> list[str]:
    """First days of months, ``months`` apart, from ``warm`` months after the table's first: as many as its years hold."""
    first, last = df.agg(F.min(order), F.max(order)).first()
    out, k = [], warm
    while first is not None:
        at = dt.date(first.year + (first.month - 1 + k) // 12, (first.month - 1 + k) % 12 + 1, 1)
        if at > last:
            break
        out.append(str(at))
        k += months
    return out


def curve_boosted(features: DataFrame, keys: Keys, order: str, warm: int = 24, months: int = 6, decay: float = 0.999, ann: float = ANN) -> DataFrame:
    """keys, order, boosted_curve: vol from boosted trees on the 20 curve features, fitted again on every refit date on
    the rows before it (weights ``decay`` to their age in days) and used until the next. A row's features give the next row's
    log variance, so the value stands on the row whose variance it is."""
    w = along(keys, order)
    features = settled(features, "curve")
    rows = features.na.drop(subset=CURVE).withColumn("target", F.log(F.lead("rv_d").over(w) + 1e-8))
    cuts = refit_dates(features, order, warm, months)
    if not cuts:
        return features.select(*keys, order, F.lit(None).cast("double").alias("boosted_curve")).limit(0)
    made = learned(rows, keys, order, CURVE, "target", cuts, "gbt", decay).select(*keys, order, "forecast")
    held = F.sqrt(F.exp(F.lag("forecast").over(w)) * ann)
    return made.withColumn("boosted_curve", held).select(*keys, order, "boosted_curve")
