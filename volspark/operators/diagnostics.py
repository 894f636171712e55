"""Forecast-quality diagnostics: losses, regressions, coverage tests, turning points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qlike
from ..functions.frames import along, roll

Keys = Sequence[str]
ANN = 252.0


def evaluate(df: DataFrame, keys: Keys, forecast: str, r: str, ann: float = ANN) -> DataFrame:
    """Per key: n, mse_var, mae_vol, qlike, corr_vol, corr_var, mse_const, rel_mse, oos_r2, mz_alpha,
    mz_beta, mz_r2 of a vol forecast against squared returns."""
    ok = df.where((F.col(forecast) > 0) & F.col(r).isNotNull())
    v, y = F.col(forecast) * F.col(forecast) / ann, F.col(r) * F.col(r)
    rows = ok.select(*keys, v.alias("v"), y.alias("y"), F.col(forecast).alias("f"), (F.abs(r) * ann**0.5).alias("a"))
    base = rows.groupBy(*keys).agg(F.avg("y").alias("m"))
    rows = rows.join(base, list(keys))
    e2 = (F.col("y") - F.col("v")) * (F.col("y") - F.col("v"))
    c2 = (F.col("y") - F.col("m")) * (F.col("y") - F.col("m"))
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e2).alias("mse_var"), F.avg(F.abs(F.col("f") - F.col("a"))).alias("mae_vol"),
        F.avg(qlike(F.col("v"), F.col("y"))).alias("qlike"), F.corr("f", "a").alias("corr_vol"), F.corr("v", "y").alias("corr_var"),
        F.avg(c2).alias("mse_const"), F.regr_intercept("y", "v").alias("mz_alpha"), F.regr_slope("y", "v").alias("mz_beta"), F.regr_r2("y", "v").alias("mz_r2"),
    )
    return out.withColumns({"rel_mse": F.col("mse_var") / F.col("mse_const"), "oos_r2": 1 - F.col("mse_var") / F.col("mse_const")})


def violations(df: DataFrame, keys: Keys, order: str, r: str, vol: str, z: float = 1.645, ann: float = ANN) -> DataFrame:
    """Adds viol (1 where r is below -z vol / sqrt(ann)) on rows with a forecast, and the one before."""
    rows = df.where(F.col(vol).isNotNull() & F.col(r).isNotNull())
    rows = rows.withColumn("viol", (F.col(r) < -z * F.col(vol) / ann**0.5).cast("int"))
    return rows.withColumn("prev_viol", F.lag("viol").over(along(keys, order)))


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x > 0, x * F.log(F.greatest(y, F.lit(1e-12)))).otherwise(0.0)


def coverage_tests(df: DataFrame, keys: Keys, alpha: float = 0.05) -> DataFrame:
    """Per key: n, violations, violation_rate, kupiec_lr, christoffersen_lr."""
    c = lambda a, b: F.sum(((F.col("prev_viol") == a) & (F.col("viol") == b)).cast("int"))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("viol").alias("violations"),
        c(0, 0).alias("n00"), c(0, 1).alias("n01"), c(1, 0).alias("n10"), c(1, 1).alias("n11"),
    )
    n, x = F.col("n"), F.col("violations")
    p = x / n
    null = _xlogy(n - x, F.lit(1 - alpha)) + _xlogy(x, F.lit(alpha))
    kupiec = 2 * (_xlogy(n - x, 1 - p) + _xlogy(x, p) - null)
    n00, n01, n10, n11 = (F.col(k) for k in ("n00", "n01", "n10", "n11"))
    one = F.lit(1)
    p01, p11 = n01 / F.greatest(n00 + n01, one), n11 / F.greatest(n10 + n11, one)
    pi = (n01 + n11) / F.greatest(n00 + n01 + n10 + n11, one)
    free = _xlogy(n00, 1 - p01) + _xlogy(n01, p01) + _xlogy(n10, 1 - p11) + _xlogy(n11, p11)
    tied = _xlogy(n00 + n10, 1 - pi) + _xlogy(n01 + n11, pi)
    return out.withColumns({"violation_rate": p, "kupiec_lr": F.greatest(kupiec, F.lit(0.0)), "christoffersen_lr": F.greatest(2 * (free - tied), F.lit(0.0))}).drop("n00", "n01", "n10", "n11")


def turning_delay(df: DataFrame, keys: Keys, order: str, forecast: str, real: str, most: int = 10) -> DataFrame:
    """keys, delay, corr: the lag 0..most at which the forecast's change signs follow the realized ones best."""
    w = along(keys, order)
    rows = df.where(F.col(forecast).isNotNull() & F.col(real).isNotNull())
    rows = rows.withColumns({"__f": F.signum(F.col(forecast) - F.lag(forecast).over(w)), "__r": F.signum(F.col(real) - F.lag(real).over(w))})
    rows = rows.withColumns({f"__{k}": F.lead("__f", k).over(w) for k in range(most + 1)})
    lags = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__{k}").alias("f")) for k in range(most + 1)])
    long = rows.select(*keys, "__r", F.inline(lags))
    per = long.groupBy(*keys, "k").agg(F.coalesce(F.round(F.corr("__r", "f"), 10), F.lit(-2.0)).alias("c"))
    return per.groupBy(*keys).agg(F.min_by(F.struct("k", "c"), F.struct(-F.col("c"), "k")).alias("b")).select(*keys, F.col("b.k").alias("delay"), F.col("b.c").alias("corr"))


def halves_qlike(df: DataFrame, keys: Keys, forecast: str, r: str, ann: float = ANN) -> DataFrame:
    """keys, qlike_high, qlike_low: loss above and at or below the median absolute return."""
    ok = df.where((F.col(forecast) > 0) & F.col(r).isNotNull())
    med = ok.groupBy(*keys).agg(F.percentile(F.abs(r), 0.5).alias("__m"))
    q = qlike(F.col(forecast) * F.col(forecast) / ann, F.col(r) * F.col(r))
    rows = ok.join(med, list(keys))
    hi = F.abs(r) > F.col("__m")
    return rows.groupBy(*keys).agg(F.avg(F.when(hi, q)).alias("qlike_high"), F.avg(F.when(~hi, q)).alias("qlike_low"))


def exposure_convexity(df: DataFrame, keys: Keys, order: str, r: str, weight: str, n: int = 21) -> DataFrame:
    """keys, convexity: mean weight where the n-row mean of |r| is in its top fifth, less that elsewhere."""
    rows = df.withColumn("__a", F.avg(F.abs(r)).over(roll(along(keys, order), n)))
    cut = rows.groupBy(*keys).agg(F.percentile("__a", 0.8).alias("__q"))
    hot = F.col("__a") >= F.col("__q")
    return rows.join(cut, list(keys)).groupBy(*keys).agg((F.avg(F.when(hot, F.col(weight))) - F.avg(F.when(~hot, F.col(weight)))).alias("convexity"))


def aligned_errors(df: DataFrame, keys: Keys, order: str, forecast: str, r: str, n: int = 21, horizon: int = 1, ann: float = ANN) -> DataFrame:
    """Adds realized (n-row vol, ``horizon`` rows ahead), err, abs_err, loss, vol_jump, vol_of_vol."""
    w = along(keys, order)
    rows = df.withColumn("__rv", F.when(F.count(r).over(roll(w, n)) >= n, F.stddev_samp(r).over(roll(w, n)) * ann**0.5))
    rows = rows.withColumn("realized", F.lead("__rv", horizon).over(w))
    err = F.col(forecast) - F.col("realized")
    vr, vf = F.col("realized") * F.col("realized"), F.col(forecast) * F.col(forecast)
    return rows.withColumns({
        "err": err, "abs_err": F.abs(err), "loss": F.when((F.col(forecast) > 0) & F.col("realized").isNotNull(), qlike(vf, vr)),
        "vol_jump": F.abs(F.col("__rv") - F.lag("__rv").over(w)), "vol_of_vol": F.stddev_samp("__rv").over(roll(w, n)),
    }).drop("__rv")


def by_regime(df: DataFrame, keys: Keys, regime: str) -> DataFrame:
    """keys, regime, n, mean_abs_err, bias, corr, qlike, vol_of_vol of aligned_errors rows."""
    return df.where("realized IS NOT NULL AND err IS NOT NULL").groupBy(*keys, regime).agg(
        F.count("*").alias("n"), F.avg("abs_err").alias("mean_abs_err"), F.avg("err").alias("bias"), F.avg("loss").alias("qlike"), F.avg("vol_of_vol").alias("vol_of_vol"),
        *[F.percentile("abs_err", q).alias(f"abs_err_p{int(100 * q)}") for q in (0.25, 0.5, 0.75)],
    )


def top_by(df: DataFrame, by: Keys, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
