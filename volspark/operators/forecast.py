"""Volatility forecasts per series and date, from rows before the date, annualised."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qlike
from ..functions.frames import along, ffill, mean, roll, std
from ..sources.series import settled

Keys = Sequence[str]
ANN = 252.0


def realized(r: Column, keys: Keys, order: str, n: int = 20, ann: float = ANN, shift: int = 1) -> Column:
    return std(r, roll(along(keys, order), n, shift), n) * ann**0.5


def naive(r: Column, keys: Keys, order: str, n: int = 20, ann: float = ANN) -> Column:
    f = roll(along(keys, order), n, 1)
    return F.when(F.count(r).over(f) >= n, F.sqrt(F.avg(r * r).over(f) * ann))


def ewma_window(r: Column, keys: Keys, order: str, n: int = 252, halflife: float = 20.0, ann: float = ANN, least: int = 2) -> Column:
    """EWMA of squares seeded at the first row of each window: the frame's squares, folded in order."""
    f = roll(along(keys, order), n, 1)
    decay = 0.5 ** (1 / halflife)
    seen = F.collect_list(r * r).over(f)
    v = F.aggregate(seen, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(decay * s + (1 - decay) * x))
    return F.when(F.count(r).over(f) >= least, F.sqrt(v * ann))


def carried(df: DataFrame, keys: Keys, order: str, vol: str, rebalance: Column) -> DataFrame:
    """Adds <vol>_held: the value of the last rebalance row, null where that estimate failed."""
    w = along(keys, order)
    held = ffill(F.when(rebalance, F.struct(F.col(vol).alias("v"))), w)
    return df.withColumn(f"{vol}_held", held["v"])


def ar1(df: DataFrame, keys: Keys, order: str, r: str, n: int = 252, ann: float = ANN) -> DataFrame:
    """Adds ar1: OLS of squares on their lag in the n rows before, fitted at the last of them."""
    w = along(keys, order)
    rows = df.withColumn("__y", F.col(r) * F.col(r)).withColumn("__x", F.lag("__y").over(w))
    f = roll(w, n - 1, 1)
    a, b = F.regr_intercept("__y", "__x").over(f), F.regr_slope("__y", "__x").over(f)
    fit = F.greatest(a + b * F.lag("__y", 2).over(w), F.lit(1e-9))
    return rows.withColumn("ar1", F.when(F.count("__x").over(f) >= n - 1, F.sqrt(fit * ann))).drop("__y", "__x")


def ar2(df: DataFrame, keys: Keys, order: str, r: str, n: int = 252, ann: float = ANN) -> DataFrame:
    """Adds ar2: OLS of squares on two lags, by the 2 x 2 normal equations of frame covariances."""
    w = along(keys, order)
    rows = df.withColumn("__y", F.col(r) * F.col(r))
    rows = rows.withColumns({"__u": F.lag("__y").over(w), "__v": F.lag("__y", 2).over(w)})
    f = roll(w, n - 2, 1)
    c = lambda a, b: F.covar_samp(a, b).over(f)
    rows = rows.withColumns({
        "__uu": c("__u", "__u"), "__vv": c("__v", "__v"), "__uv": c("__u", "__v"), "__uy": c("__u", "__y"), "__vy": c("__v", "__y"),
        "__mu": F.avg("__u").over(f), "__mv": F.avg("__v").over(f), "__my": F.avg("__y").over(f), "__n": F.count("__v").over(f),
        "__l2": F.lag("__y", 2).over(w), "__l3": F.lag("__y", 3).over(w),
    })
    det = F.col("__uu") * F.col("__vv") - F.col("__uv") * F.col("__uv")
    b1 = (F.col("__uy") * F.col("__vv") - F.col("__vy") * F.col("__uv")) / det
    b2 = (F.col("__vy") * F.col("__uu") - F.col("__uy") * F.col("__uv")) / det
    fit = F.col("__my") + b1 * (F.col("__l2") - F.col("__mu")) + b2 * (F.col("__l3") - F.col("__mv"))
    ok = (F.col("__n") >= n - 2) & (det != 0)
    out = rows.withColumn("ar2", F.when(ok, F.sqrt(F.greatest(fit, F.lit(1e-9)) * ann)))
    return out.select(*df.columns, "ar2")


def har(df: DataFrame, keys: Keys, order: str, r: str, n: int = 252, weekly: int = 5, monthly: int = 22, ridge: float = 1e-6, ann: float = ANN, label: str | None = None) -> DataFrame:
    """Adds har: ridge of next-row squares on daily, weekly and monthly means of squares.

    The normal equations are sums over the frame, made by windows; each row then solves its own
    4 x 4 system in Arrow batches. With ``label``, sums run over rows of the same label only."""
    w = along(keys, order)
    rows = df.withColumn("__d", F.col(r) * F.col(r))
    rows = rows.withColumns({"__w": F.avg("__d").over(roll(w, weekly)), "__m": F.avg("__d").over(roll(w, monthly)), "__i": F.row_number().over(w)})
    lag = {f"__p{c}": F.when(F.col("__i") > monthly, F.lag(f"__{c}").over(w)) for c in "dwm"}
    rows = rows.withColumns(lag)
    if label:
        rows = rows.withColumns({f"__p{c}": F.when(F.lag(label).over(w).isNotNull(), F.col(f"__p{c}")) for c in "dwm"})
    part = along([*keys, label] if label else keys, order)
    f = roll(part, n, 1)
    x = [F.when(F.col("__pd").isNotNull(), F.lit(1.0)), F.col("__pd"), F.col("__pw"), F.col("__pm")]
    sums = [F.sum(x[i] * x[j]).over(f) for i in range(4) for j in range(i, 4)] + [F.sum(x[i] * F.col("__d")).over(f) for i in range(4)]
    rows = rows.withColumn("__s", F.array(*sums, F.lag("__d").over(w), F.lag("__w").over(w), F.lag("__m").over(w)))

    @F.pandas_udf("double")
    def solve(s: pd.Series) -> pd.Series:
        a = np.array([np.full(17, np.nan) if v is None else np.array(v, float) for v in s]).reshape(-1, 17)
        m = np.empty((len(a), 4, 4))
        for k, (i, j) in enumerate((i, j) for i in range(4) for j in range(i, 4)):
            m[:, i, j] = m[:, j, i] = a[:, k]
        scale = np.sqrt(np.maximum(np.einsum("nii->ni", m), 1e-300))
        m = m / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(4)
        ok = np.isfinite(m).all((1, 2)) & np.isfinite(a).all(1)
        out = np.full(len(a), np.nan)
        if ok.any():
            b = np.linalg.solve(m[ok], (a[ok, 10:14] / scale[ok])[:, :, None])[:, :, 0] / scale[ok]
            out[ok] = b[:, 0] + (b[:, 1:] * a[ok, 14:17]).sum(1)
        return pd.Series(out)

    enough = F.count("__pd").over(f) >= max(30, n // 2)
    fit = F.greatest(F.nanvl(solve("__s"), F.lit(None).cast("double")), F.lit(1e-12))
    fallback = F.avg("__d").over(roll(w, n, 1))
    out = rows.withColumn("har", F.sqrt(F.coalesce(F.when(enough, fit), fallback) * ann))
    return out.select(*df.columns, "har")


def fold_rows(df: DataFrame, keys: Keys, order: str, step, schema: str) -> DataFrame:
    """Per key, rows in order through ``step(pdf) -> pdf``; the group is one series (x parameters)."""
    return df.groupBy(*keys).applyInPandas(lambda pdf: step(pdf.sort_values(order)), schema)


def garch_filter(df: DataFrame, keys: Keys, order: str, r: str, omega: str, alpha: str, beta: str, gamma: str | None = None, ann: float = ANN) -> DataFrame:
    """Adds garch (vol of each row given the rows before) and loglik (its Gaussian log-likelihood).

    Variance starts at the mean square of the first 20 rows; parameters are columns, constant in a
    key, so a grid of them is just more keys. ``gamma`` adds the leverage term for negative returns."""
    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", garch double, loglik double"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[r].to_numpy(float)
        o, a, b = (float(pdf[c].iloc[0]) for c in (omega, alpha, beta))
        g = float(pdf[gamma].iloc[0]) if gamma else 0.0
        v = np.empty(len(x))
        s = float(np.mean(x[:20] ** 2)) or 1e-12
        for i, xi in enumerate(x):
            v[i] = s
            s = max(o + (a + g * (xi < 0)) * xi * xi + b * s, 1e-18)
        return pdf.assign(garch=np.sqrt(v * ann), loglik=-0.5 * (np.log(2 * np.pi * v) + x * x / v))

    return fold_rows(df, keys, order, step, schema)


def best_by_likelihood(df: DataFrame, keys: Keys, params: Sequence[str]) -> DataFrame:
    """keys and the parameters of the largest summed log-likelihood (ties to the lesser parameters)."""
    total = df.groupBy(*keys, *params).agg(F.round(F.sum("loglik"), 6).alias("loglik"))
    best = F.min_by(F.struct(*params, "loglik"), F.struct(-F.col("loglik"), *params)).alias("b")
    return total.groupBy(*keys).agg(best).select(*keys, "b.*")


def precision_ensemble(df: DataFrame, keys: Keys, order: str, r: str, models: Sequence[str], n: int = 21, floor: float = 1e-8, ann: float = ANN) -> DataFrame:
    """keys, order, ensemble: forecasts weighted by the inverse summed QLIKE loss of the n rows before.

    A non-positive or missing loss counts as ``floor``, a missing forecast as a loss of 1e6."""
    w = along(keys, order)
    long = df.select(*keys, order, r, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in models]), F.array(*models))).alias("model", "f"))
    var = F.col("f") * F.col("f") / ann
    loss = F.coalesce(F.when(var > 0, qlike(var, F.col(r) * F.col(r), 1e-12)), F.lit(1e6))
    m = along([*keys, "model"], order)
    long = long.withColumn("loss", loss).withColumn("sum_loss", F.sum("loss").over(roll(m, n, 1)))
    weight = F.when(F.col("f").isNotNull() & F.col("sum_loss").isNotNull(), 1 / F.greatest(F.col("sum_loss"), F.lit(floor)))
    long = long.withColumn("wt", weight)
    return long.groupBy(*keys, order).agg((F.sum(F.col("wt") * F.col("f")) / F.sum("wt")).alias("ensemble"))


def daily_variance(df: DataFrame, keys: Keys, vol: str, ann: float = ANN) -> DataFrame:
    """Adds <vol>_var: annual vol becomes daily variance where a series' median exceeds 0.01."""
    med = df.groupBy(*keys).agg(F.percentile(vol, 0.5).alias("__m"))
    v = F.col(vol)
    return df.join(med, list(keys)).withColumn(f"{vol}_var", F.when(F.col("__m") > 0.01, v * v / ann).otherwise(v)).drop("__m")


def sequences(df: DataFrame, keys: Keys, order: str, features: Sequence[str], n: int = 21) -> DataFrame:
    """keys, order, seq: the feature rows of the n rows before, as an array of arrays."""
    f = roll(along(keys, order), n, 1)
    seq = F.collect_list(F.array(*[F.coalesce(c, F.lit(0.0)) for c in features])).over(f)
    return df.select(*keys, order, F.when(F.size(seq) == n, seq).alias("seq"))


def intraday(df: DataFrame, keys: Keys, order: str, rv: str, coverage: str, n: int = 5, least_coverage: float = 0.5, ann: float = ANN) -> DataFrame:
    """Adds intraday_vol: mean of the covered days' rv over n rows, lagged one row, filled forward."""
    w = along(keys, order)
    ok = F.when(F.col(coverage) >= least_coverage, F.col(rv))
    rows = df.withColumn("__rv", ok)
    rows = rows.withColumn("__a", F.when(F.count("__rv").over(roll(w, n)) >= 1, F.avg("__rv").over(roll(w, n))) * ann**0.5)
    return rows.withColumn("__l", F.lag("__a").over(w)).withColumn("intraday_vol", ffill(F.col("__l"), w)).drop("__rv", "__a", "__l")


def range_based(df: DataFrame, keys: Keys, order: str, method: str = "parkinson", n: int = 20, least: int = 5, ann: float = ANN) -> DataFrame:
    """Adds range_vol from open, high, low, close; averaged over n rows, lagged one."""
    hl = F.log(F.col("high") / F.col("low"))
    co = F.log(F.col("close") / F.col("open"))
    ln2 = float(np.log(2.0))
    var = hl * hl / (4 * ln2) if method == "parkinson" else 0.5 * hl * hl - (2 * ln2 - 1) * co * co
    w = along(keys, order)
    rows = df.withColumn("__v", F.when((F.col("low") > 0) & (F.col("open") > 0), F.greatest(var, F.lit(0.0))))
    avg = F.when(F.count("__v").over(roll(w, n)) >= least, F.avg("__v").over(roll(w, n)))
    return rows.withColumn("__a", F.sqrt(avg * ann)).withColumn("range_vol", F.lag("__a").over(w)).drop("__v", "__a")


def composite(weights: dict[str, float], floor: float = 0.01, cap: float = 5.0) -> Column:
    """Weighted sum of columns; missing ones add nothing and the rest is not rescaled."""
    total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    some = F.coalesce(*[F.col(c) for c in weights]).isNotNull()
    return F.when(some, F.least(F.greatest(total, F.lit(floor)), F.lit(cap)))


def hybrid(df: DataFrame, keys: Keys, order: str, r: str, fast: float = 5.0, slow: float = 60.0, n: int = 126, weight: float = 0.5, ann: float = ANN) -> DataFrame:
    """Adds hybrid: fast and slow EWMA vols blended by a logistic of the z-score of their log ratio."""
    from .windows import ewma

    rows = df.withColumn("__sq", F.col(r) * F.col(r))
    rows = ewma(rows, keys, order, "__sq", halflife=fast).withColumnRenamed("ewma", "__f")
    rows = ewma(rows, keys, order, "__sq", halflife=slow).withColumnRenamed("ewma", "__s")
    w = along(keys, order)
    rows = rows.withColumn("__g", F.abs(F.log((F.col("__f") + 1e-18) / (F.col("__s") + 1e-18))))
    m, sd = F.avg("__g").over(roll(w, n)), F.stddev_samp("__g").over(roll(w, n))
    z = F.when(sd > 1e-12, (F.col("__g") - m) / sd).otherwise(0.0)
    p = 1 / (1 + F.exp(-weight * z))
    return rows.withColumn("hybrid", F.sqrt((p * F.col("__f") + (1 - p) * F.col("__s")) * ann)).drop("__sq", "__f", "__s", "__g")


def hybrid_stress(df: DataFrame, keys: Keys, order: str, r: str, p_stress: str, fast: float = 5.0, slow: float = 40.0, n: int = 126, k: float = 1.0, z0: float = 1.5, gamma: float = 1.0, p_bar: float = 0.5, ann: float = ANN) -> DataFrame:
    """Adds beta and hybrid_stress: fast and slow EWMA vols (rows before the date) blended by a logistic of the
    z-score of their log distance, whose middle ``z0`` comes nearer the likelier stress is against its long-run
    share ``p_bar``. Null with fewer than max(20, n / 5) distances, or no spread, or no probability."""
    from .windows import ewma

    w = along(keys, order)
    rows = df.withColumn("__sq", F.col(r) * F.col(r))
    for name, halflife in (("__f", fast), ("__s", slow)):
        rows = ewma(rows, keys, order, "__sq", halflife=halflife).withColumnRenamed("ewma", name)
    rows = rows.withColumns({c: F.sqrt(F.lag(c).over(w) * ann) for c in ("__f", "__s")})
    floor = F.lit(1e-12)
    rows = rows.withColumn("__g", F.when(F.col("__f").isNotNull(), F.abs(F.log(F.greatest("__f", floor)) - F.log(F.greatest("__s", floor)))))
    f = roll(w, n)
    z = (F.col("__g") - F.avg("__g").over(f)) / F.greatest(F.stddev_samp("__g").over(f), floor)
    z = F.when(F.count("__g").over(f) >= max(20, n // 5), z)
    rows = rows.withColumn("beta", 1 / (1 + F.exp(-k * (z - (z0 - gamma * (F.col(p_stress) - p_bar))))))
    return rows.withColumn("hybrid_stress", F.col("beta") * F.col("__f") + (1 - F.col("beta")) * F.col("__s")).drop("__sq", "__f", "__s", "__g")


def feature_table(df: DataFrame, keys: Keys, order: str, r: str, lags: int = 5) -> DataFrame:
    """Columns that learned forecasts train on, and target: the rv21 of the next row."""
    w = along(keys, order)
    c = F.col(r)
    out = {f"r_{k}": F.lag(c, k).over(w) for k in range(lags)} | {f"sq_{k}": F.pow(F.lag(c, k).over(w), 2) for k in range(lags)}
    out |= {f"abs_{k}": F.abs(F.lag(c, k).over(w)) for k in range(lags)}
    out |= {f"rv_{n}": std(c, roll(w, n), n) for n in (5, 21, 63)}
    rows = df.withColumns(out)
    return rows.withColumn("target", F.lead("rv_21").over(w)).na.drop(subset=list(out))


def curve_features(df: DataFrame, keys: Keys, order: str, r: str, vix: str = "vix", long: str = "s2y10y", short: str = "s3m10y", ann: float = ANN) -> DataFrame:
    """keys, order and 20 features: squares and their means, sign, vol of vol, jumps, the vol index as a daily
    variance with its change and premium, two slopes with changes, inversions and interactions."""
    w = along(keys, order)
    c, lag = F.col(r), lambda x: F.lag(x).over(w)
    rows = df.withColumns({"rv_d": c * c, "vix": F.pow(F.col(vix) / 100, 2) / ann, "slope_2y10y": F.col(long), "slope_3m10y": F.col(short)})
    sd20, sd22 = std(c, roll(w, 20), 20), std(c, roll(w, 22), 22)
    rows = rows.withColumns(
        {f"rv_{k}": mean(F.col("rv_d"), roll(w, n), n) for k, n in (("w", 5), ("m", 22), ("q", 63))}
        | {"rv20": sd20 * sd20, "vol_of_vol": std(F.col("rv_d"), roll(w, 22), 22), "vix_diff": F.col("vix") - lag("vix"), "jump_flag": F.coalesce((F.abs(c) > 3.0 * sd22).cast("int"), F.lit(0))}
        | {"ret_sign": (c < 0).cast("int"), "d_slope_2y10y": F.col("slope_2y10y") - lag("slope_2y10y"), "d_slope_3m10y": F.col("slope_3m10y") - lag("slope_3m10y")}
        | {f"inv_{k}": F.coalesce((F.col(f"slope_{k}") < 0).cast("double"), F.lit(0.0)) for k in ("2y10y", "3m10y")}
    )
    rows = rows.withColumns({"rv20": F.coalesce("rv20", "rv_m"), "vrp": F.col("vix") / (F.col("rv_w") + 1e-8), "accel_slope": F.col("d_slope_2y10y") - lag("d_slope_2y10y")})
    rows = rows.withColumns({"vrp_x_inv": F.col("vrp") * F.col("inv_2y10y"), "slope_x_vov": F.col("slope_2y10y") * F.col("vol_of_vol")})
    return rows.select(*keys, order, *CURVE)


CURVE = [
    "rv_d", "rv_w", "rv_m", "rv_q", "rv20", "ret_sign", "vol_of_vol", "jump_flag", "vix", "vix_diff", "vrp", "slope_2y10y", "slope_3m10y", "d_slope_2y10y",
    "d_slope_3m10y", "accel_slope", "inv_2y10y", "inv_3m10y", "vrp_x_inv", "slope_x_vov",
]
RATES = ["rv_d", "rv_w", "rv_m", "rv_q", "slope_2y10y", "slope_3m10y", "d_slope_2y10y", "d_slope_3m10y", "inv_2y10y", "vix"]


def rate_har(features: DataFrame, keys: Keys, order: str, n: int = 252, warm: int = 64, least: int = 60, ridge: float = 1e-3, ann: float = ANN) -> DataFrame:
    """keys, order, har_rates: log-variance ridge on the features of the row before (``curve_features``).

    A row's window is itself and the n - 1 rows before; its first ``warm`` rows only warm the features up.
    The fit sees all but the row itself, of which only the features of the row before are used. Rows with
    any null feature take no part; below ``least`` of them it is the root of the mean of 22 squares before.
    One fold per series: prefix sums of outer products give each window's normal equations."""
    kinds = dict(features.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", har_rates double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        sq = pdf["rv_d"].to_numpy(float)
        x = np.vstack([np.full(len(RATES), np.nan), pdf[RATES].to_numpy(float)[:-1]]) if len(pdf) else np.empty((0, len(RATES)))
        x, y = np.column_stack([np.ones(len(x)), x]), np.log(sq + 1e-8)
        ok = np.isfinite(x).all(1) & np.isfinite(y)
        z = np.where(ok[:, None], np.column_stack([x, y]), 0.0)
        pad = lambda a: np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, 0)])
        gram, count = pad(z[:, :, None] * z[:, None, :]), pad(ok.astype(float))
        i = np.arange(len(x))
        first = np.maximum(i - n + 1 + warm, 0)
        k = np.where(first < i, count[i] - count[np.minimum(first, i)], 0)
        g = gram[i] - gram[np.minimum(first, i)]
        a = g[:, :-1, :-1] + ridge * np.diag([0.0] + [1.0] * len(RATES))
        fit = np.full(len(x), np.nan)
        use = ok & (k >= least) & (i >= n - 1)
        if use.any():
            b = np.linalg.solve(a[use], g[use, :-1, -1:])[:, :, 0]
            fit[use] = np.exp((b * x[use]).sum(1))
        past = pd.Series(sq).shift(1).rolling(22, min_periods=22).mean().to_numpy()
        out = np.where(use, fit, np.where(i >= n - 1, past, np.nan))
        return pdf[[*keys, order]].assign(har_rates=np.sqrt(np.maximum(out, 1e-18) * ann))

    return features.groupBy(*keys).applyInPandas(run, schema)


def learned(df: DataFrame, keys: Keys, order: str, features: Sequence[str], target: str, cuts: Sequence[str], kind: str = "gbt", decay: float | None = None, seed: int = 7) -> DataFrame:
    """keys, order, forecast: for each refit date, a Spark ML model on rows before it predicts the rows
    up to the next one. Series are pooled; ``decay`` weights a row by its age in days. A fit reads its rows many
    times, so the rows are written once before the first."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    rows = settled(df.select(*dict.fromkeys([*keys, order, *features, target])), "learned")
    rows = VectorAssembler(inputCols=list(features), outputCol="__x").transform(rows)
    common = {"featuresCol": "__x", "labelCol": target, "predictionCol": "forecast"}
    out = None
    for i, cut in enumerate(cuts):
        train = rows.where((F.col(order) < F.lit(cut).cast("date")) & F.col(target).isNotNull())
        if decay:
            train = train.withColumn("__w", F.pow(F.lit(decay), F.datediff(F.lit(cut).cast("date"), F.col(order))))
            common["weightCol"] = "__w"
        if kind == "lasso":
            model = LinearRegression(elasticNetParam=1.0, regParam=1e-5, **common)
        elif kind == "forest":
            model = RandomForestRegressor(numTrees=10, maxDepth=5, seed=seed, **common)
        else:
            model = GBTRegressor(maxIter=10, maxDepth=3, seed=seed, **common)
        test = rows.where(F.col(order) >= F.lit(cut).cast("date"))
        if i + 1 < len(cuts):
            test = test.where(F.col(order) < F.lit(cuts[i + 1]).cast("date"))
        part = model.fit(train).transform(test).select(*keys, order, target, "forecast")
        out = part if out is None else out.unionByName(part)
    return out
