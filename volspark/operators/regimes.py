"""Regime labels: quantile buckets, rule lists, change points, filters and clusters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import along, gated, roll
from .windows import rolling_rank

Keys = Sequence[str]


def bucket(df: DataFrame, keys: Keys, col: str, low: float = 0.3, high: float = 0.7, names: Sequence[str] = ("low", "mid", "high"), out: str = "bucket") -> DataFrame:
    """Adds a label by the series' own quantiles: at or above the upper one wins, a null value is mid."""
    cut = df.groupBy(*keys).agg(F.percentile(col, low).alias("__lo"), F.percentile(col, high).alias("__hi"))
    label = F.when(F.col(col) >= F.col("__hi"), names[2]).when(F.col(col) <= F.col("__lo"), names[0]).otherwise(names[1])
    return df.join(cut, list(keys)).withColumn(out, label).drop("__lo", "__hi")


def trailing_bucket(df: DataFrame, keys: Keys, order: str, col: str, n: int = 252, low: float = 0.3, high: float = 0.7, names: Sequence[str] = ("low", "mid", "high"), least: int = 10, out: str = "bucket") -> DataFrame:
    """Adds a label by the quantiles of the last n rows, the own one included: below the lower one, at or
    above the upper one; with fewer than ``least`` values it is the middle one."""
    f, c = roll(along(keys, order), n), F.col(col)
    label = F.when(F.count(c).over(f) < least, names[1]).when(c < F.percentile(c, low).over(f), names[0])
    return df.withColumn(out, F.when(c.isNotNull(), label.when(c >= F.percentile(c, high).over(f), names[2]).otherwise(names[1])))


def vol_trend(vol: str, keys: Keys, order: str, n: int = 5, threshold: float = 0.05) -> Column:
    prev = F.lag(vol, n).over(along(keys, order))
    change = F.when(prev > 0, F.col(vol) / prev - 1)
    return F.when(change > threshold, "rising").when(change < -threshold, "falling").otherwise("flat")


def spread_bucket(spread: Column, threshold: float) -> Column:
    """inverted at or below -threshold, wide at or above it."""
    return F.when(spread <= -threshold, "inverted").when(spread >= threshold, "wide").otherwise("normal")


def rule_list(rules: Sequence[tuple[Column, str]]) -> Column:
    """The label of the last rule that holds, ``normal`` where none does."""
    out = F.lit("normal")
    for test, label in rules:
        out = F.when(test, label).otherwise(out)
    return out


def one_hot(label: str, names: Sequence[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.when(F.col(label) == n, 1.0).otherwise(0.0) for n in names]))


def change_point(df: DataFrame, keys: Keys, order: str, col: str, n: int = 21, least: int = 7, threshold: float = 2.5) -> DataFrame:
    """Adds z, change_score = 1 - exp(-|z|) and is_change against the trailing frame (its own row in it)."""
    f, c = roll(along(keys, order), n), F.col(col)
    sd = F.stddev_samp(c).over(f)
    z = gated(F.when(sd > 0, (c - F.avg(c).over(f)) / sd), c, f, least)
    out = df.withColumn("z", z)
    return out.withColumns({"change_score": 1 - F.exp(-F.abs("z")), "is_change": F.coalesce(F.abs("z") >= threshold, F.lit(False))})


def hmm_filter(df: DataFrame, keys: Keys, order: str, col: str, means: Sequence[float], sds: Sequence[float], stay: float = 0.97) -> DataFrame:
    """Adds p_stress: filtered probability of the second of two Gaussian states with given parameters."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", p_stress double"
    norm = [1 / (s * math.sqrt(2 * math.pi)) for s in sds]

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        p, out = 0.5, []
        for x in pdf[col].to_numpy(float):
            prior = p * stay + (1 - p) * (1 - stay)
            if not math.isnan(x):
                a, b = (norm[i] * math.exp(-0.5 * ((x - means[i]) / sds[i]) ** 2) for i in (0, 1))
                total = (1 - prior) * a + prior * b
                prior = prior * b / total if total > 0 else prior
            p = prior
            out.append(p)
        return pdf.assign(p_stress=out)

    return df.groupBy(*keys).applyInPandas(step, schema)


def persistent(df: DataFrame, keys: Keys, order: str, label: str, hold: int = 3, confidence: str | None = None, least: float = 0.65) -> DataFrame:
    """Adds <label>_held: a new label counts only after ``hold`` rows in a row have it.

    With ``confidence``, rows count that have any label but the held one and ``least`` confidence; other
    rows start the count anew, and the label of the ``hold``-th one is taken."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + f", {label}_held string"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, last, run, out = None, None, 0, []
        if confidence:
            for x, sure in zip(pdf[label], pdf[confidence]):
                if state is None:
                    state = x
                run = run + 1 if x != state and sure >= least else 0
                if run >= hold:
                    state, run = x, 0
                out.append(state)
            return pdf.assign(**{f"{label}_held": out})
        for x in pdf[label]:
            run = run + 1 if x == last else 1
            last = x
            if state is None or x != state and run >= hold:
                state = x
            out.append(state)
        return pdf.assign(**{f"{label}_held": out})

    return df.groupBy(*keys).applyInPandas(step, schema)


def bocpd(df: DataFrame, keys: Keys, order: str, col: str, hazard: float = 1 / 100, scale: str | None = None) -> DataFrame:
    """Adds p_change: probability that a run began at one of the last five rows (Student-t predictive).

    ``scale`` names a column with the spread that was known at each row (rows without one are passed over);
    without it values are scaled by their spread over the whole series, which suits the study of a closed
    series only. All run lengths are kept; only runs whose probability is zero as a double, which cannot come back,
    leave the arrays."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", p_change double"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[col].to_numpy(float)
        spread = pdf[scale].to_numpy(float) if scale else float(np.nanstd(x)) or 1.0
        spread = np.where(spread > 0, spread, np.nan)
        k, a, b, m, p, out = np.ones(1), np.ones(1), np.ones(1), np.zeros(1), np.ones(1), []
        gammas = np.array([math.lgamma((2 + i) / 2) - math.lgamma((1 + i) / 2) for i in range(len(x) + 8)])
        for v in x / spread:
            if math.isnan(v):
                out.append(None)
                continue
            dof = 2 * a
            s2 = b * (k + 1) / (a * k)
            g = gammas[(dof - 1).astype(int)]
            logp = g - 0.5 * np.log(dof * math.pi * s2) - (dof + 1) / 2 * np.log1p((v - m) ** 2 / (dof * s2))
            w = p * np.exp(logp)
            new = np.concatenate([[w.sum() * hazard], w * (1 - hazard)])
            p = new / max(new.sum(), 1e-300)
            b = np.concatenate([[1.0], b + k * (v - m) ** 2 / (2 * (k + 1))])
            m = np.concatenate([[0.0], (k * m + v) / (k + 1)])
            k, a = np.concatenate([[1.0], k + 1]), np.concatenate([[1.0], a + 0.5])
            live = p > 0
            live[:5] = True
            if not live.all():
                k, a, b, m, p = (z[live] for z in (k, a, b, m, p))
            out.append(float(p[:5].sum()))
        return pdf.assign(p_change=out)

    return df.groupBy(*keys).applyInPandas(step, schema)


def stress_score(df: DataFrame, keys: Keys, order: str, rv: str, vrp: str, n: int = 126, smooth: int = 5) -> DataFrame:
    """Adds stress: 0.6 rank(rv) + 0.4 (1 - rank(vrp)) over n rows, averaged over ``smooth``."""
    raw = 0.6 * rolling_rank(F.col(rv), keys, order, n) + 0.4 * (1 - rolling_rank(F.col(vrp), keys, order, n))
    rows = df.withColumn("__raw", raw)
    f = roll(along(keys, order), smooth)
    return rows.withColumn("stress", gated(F.avg("__raw").over(f), F.col("__raw"), f, smooth)).drop("__raw")


def metric_regime(sharpe: Column, drawdown: Column, vol_error: Column, vol: Column, ret: Column) -> Column:
    """risk_on / balanced / defensive of a pair's window metrics (drawdown 0 or below, annual vol and
    return). A strong Sharpe inside the vol band counts before any sign of stress."""
    strong = (sharpe >= 0.85) & (ret >= 0.08) & vol.between(0.075, 0.115)
    bad = (drawdown <= -0.07) | (vol_error >= 0.035) | (ret < 0.02)
    good = (sharpe >= 0.65) & (ret >= 0.05) & (vol_error <= 0.03)
    return F.when(strong, "risk_on").when(bad, "defensive").when(good, "risk_on").otherwise("balanced")


def macro_regime(vol: Column, vix: Column, spread: Column | None = None, change: Column | None = None) -> Column:
    """risk_on / balanced / defensive of the equal-weight vol, the VIX and, where given, the credit spread's
    level and change over 20 rows."""
    vol, vix = F.coalesce(vol, F.lit(0.0)), F.coalesce(vix, F.lit(0.0))
    bad, good = (vol >= 0.14) | (vix >= 24), (vol <= 0.09) & (vix <= 18)
    if spread is not None:
        bad |= F.coalesce(spread, F.lit(0.0)) >= 5.0
    if change is not None:
        bad |= F.coalesce(change, F.lit(0.0)) >= 0.50
        good &= change.isNull() | (change <= 0.15)
    return F.when(bad, "defensive").when(good, "risk_on").otherwise("balanced")


def macro_inputs(returns: DataFrame, order: str, aux: dict[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """order, r, vol_21, vol_63 of the equal-weight return, and each auxiliary series that its table has a column for.

    ``aux`` names a series, its table and the columns that it may stand in, the first one found counts. Its dates are
    matched exactly and filled forward, so what is dated between two rows is lost, as in the source tables."""
    from ..functions.frames import std
    from ..sources.series import first_column
    from .joins import align_fill

    w = along([], order)
    ew = returns.groupBy(order).agg(F.avg("r").alias("r"))
    out = ew.withColumns({f"vol_{n}": std(F.col("r"), roll(w, n), least) * 252.0**0.5 for n, least in ((21, 10), (63, 20))})
    for name, (table, candidates) in aux.items():
        found = first_column(table, candidates, name)
        if found is not None:
            out = align_fill(out, found.select(order, name), [], order, [name])
    return out


def past_quantile_regime(df: DataFrame, keys: Keys, order: str, col: str, n: int = 1512, least: int = 252, low: float = 1 / 3, high: float = 2 / 3) -> DataFrame:
    """Adds regime: low at or below the lower quantile of the last n rows, high at or above the upper one,
    else middle; null with fewer than ``least`` values. Nothing of a later row is used."""
    f, c = roll(along(keys, order), n), F.col(col)
    lo, hi = F.round(F.percentile(c, low).over(f), 10), F.round(F.percentile(c, high).over(f), 10)
    x = F.round(c, 10)
    label = F.when(x <= lo, "low").when(x >= hi, "high").otherwise("middle")
    return df.withColumn("regime", F.when(F.count(c).over(f) >= least, label))


def clusters(df: DataFrame, features: Sequence[str], order_by: str, k: int = 3, kind: str = "kmeans", seed: int = 7) -> DataFrame:
    """Adds state 0..k-1, in rising mean of ``order_by``: Spark ML KMeans or GaussianMixture on
    standardized features."""
    from pyspark.ml.clustering import GaussianMixture, KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="__x").transform(df.na.drop(subset=list(features)))
    rows = StandardScaler(inputCol="__x", outputCol="__z", withMean=True).fit(rows).transform(rows)
    model = (KMeans if kind == "kmeans" else GaussianMixture)(k=k, seed=seed, featuresCol="__z", predictionCol="__c")
    found = model.fit(rows).transform(rows)
    order = found.groupBy("__c").agg(F.avg(order_by).alias("__m")).orderBy("__m").collect()  # k rows
    label = F.lit(None).cast("int")
    for i, row in enumerate(order):
        label = F.when(F.col("__c") == row["__c"], i).otherwise(label)
    return found.withColumn("state", label).select(*df.columns, "state")
