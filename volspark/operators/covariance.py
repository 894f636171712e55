"""Covariances per date in the long form (keys, d, i, j, cov) with i <= j, from rows before the date.

``keys`` tell portfolios (and parameters) apart: every window and join is within them, so many portfolios
are rows of one table."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll

ANN = 252.0
PAIR = ["i", "j"]
Keys = Sequence[str]


def pair_panel(returns: DataFrame, asset: str, order: str, r: str, keys: Keys = ()) -> DataFrame:
    """keys, d, i, j, x, y: returns of every ordered pair on their common dates (an equi-join on the date)."""
    a = returns.select(*keys, order, F.col(asset).alias("i"), F.col(r).alias("x"))
    b = returns.select(*keys, order, F.col(asset).alias("j"), F.col(r).alias("y"))
    return a.join(b, [*keys, order]).where("i <= j")


def sample(panel: DataFrame, order: str, n: int = 126, ann: float = ANN, keys: Keys = ()) -> DataFrame:
    f = roll(along([*keys, *PAIR], order), n, 1)
    return panel.withColumn("cov", F.when(F.count("*").over(f) >= n, F.covar_samp("x", "y").over(f) * ann))


def expanding(panel: DataFrame, order: str, least: int = 63, n: int = 126, ann: float = ANN, keys: Keys = ()) -> DataFrame:
    w = along([*keys, *PAIR], order)
    f, g = cum(w, 1), roll(w, n, 1)
    wide = F.covar_samp("x", "y").over(f)
    return panel.withColumn("cov", F.when(F.count("*").over(f) >= least, wide).otherwise(F.covar_samp("x", "y").over(g)) * ann)


def _weighted(rows: Column, decay: float | Column) -> Column:
    """Covariance of (x, y) structs with weights decay^age over their sum, about the weighted means."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("w", "x", "y", "xy")])
    step = lambda s, v: F.struct(
        (s["w"] * decay + 1).alias("w"), (s["x"] * decay + v["x"]).alias("x"), (s["y"] * decay + v["y"]).alias("y"), (s["xy"] * decay + v["x"] * v["y"]).alias("xy")
    )
    return F.aggregate(rows, zero, step, lambda s: s["xy"] / s["w"] - s["x"] / s["w"] * s["y"] / s["w"])


def ewma(panel: DataFrame, order: str, halflife: float | str = 21.0, n: int = 126, ann: float = ANN, keys: Keys = ()) -> DataFrame:
    """``halflife`` is a number, or the name of a column that is among the keys."""
    f = roll(along([*keys, *PAIR], order), n, 1)
    seen = F.collect_list(F.struct("x", "y")).over(f)
    decay = F.pow(F.lit(0.5), 1 / F.col(halflife)) if isinstance(halflife, str) else 0.5 ** (1 / halflife)
    return panel.withColumn("cov", F.when(F.count("*").over(f) >= n, _weighted(seen, decay) * ann))


def diagonal(cov: DataFrame) -> DataFrame:
    return cov.withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(F.when(F.col("cov").isNotNull(), 0.0)))


def correlation_scaled(panel: DataFrame, cov: DataFrame, order: str, n: int = 126, keys: Keys = ()) -> DataFrame:
    """Frame correlation times the vols on the diagonal of ``cov``."""
    f, on = roll(along([*keys, *PAIR], order), n, 1), [*keys, order]
    rho = panel.withColumn("rho", F.when(F.count("*").over(f) >= n, F.corr("x", "y").over(f)))
    v = cov.where("i = j").select(*on, F.col("i").alias("k"), F.sqrt("cov").alias("v"))
    out = rho.join(v.withColumnsRenamed({"k": "i", "v": "vi"}), [*on, "i"]).join(v.withColumnsRenamed({"k": "j", "v": "vj"}), [*on, "j"])
    return out.select(*on, "i", "j", (F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("rho")) * F.col("vi") * F.col("vj")).alias("cov"))


def shrunk(cov: DataFrame, by: float = 0.25) -> DataFrame:
    return cov.withColumn("cov", F.when(F.col("i") == F.col("j"), F.col("cov")).otherwise(F.col("cov") * (1 - by)))


def ledoit_wolf(panel: DataFrame, order: str, n: int = 126, ann: float = ANN, keys: Keys = ()) -> DataFrame:
    """Shrinkage to a scaled identity by the published closed form; its intensity per date is a sum over
    the pairs of second and fourth moments of the frame."""
    f = roll(along([*keys, *PAIR], order), n, 1)
    c = panel.withColumns({
        "s": F.when(F.count("*").over(f) >= n, F.covar_pop("x", "y").over(f)), "__mx": F.avg("x").over(f), "__my": F.avg("y").over(f),
        "__all": F.collect_list(F.struct("x", "y")).over(f),
    })
    prod = F.transform("__all", lambda v: F.pow((v["x"] - F.col("__mx")) * (v["y"] - F.col("__my")), 2))
    c = c.withColumn("q", F.aggregate(prod, F.lit(0.0), lambda a, x: a + x) / F.size("__all"))
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    diag = F.when(F.col("i") == F.col("j"), F.col("s"))
    per = c.where("s IS NOT NULL").groupBy(*keys, order).agg(
        F.avg(diag).alias("mu"), F.count(diag).alias("k"), F.sum(twice * F.col("s") * F.col("s")).alias("ss"), F.sum(twice * (F.col("q") - F.col("s") * F.col("s"))).alias("b2")
    )
    d2 = F.col("ss") - F.col("k") * F.col("mu") * F.col("mu")
    per = per.withColumn("rho", F.when(d2 > 0, F.least(F.greatest(F.col("b2") / n, F.lit(0.0)), d2) / d2).otherwise(0.0))
    out = c.join(per.select(*keys, order, "mu", "rho"), [*keys, order])
    target = F.when(F.col("i") == F.col("j"), F.col("mu")).otherwise(0.0)
    return out.select(*keys, order, "i", "j", (((1 - F.col("rho")) * F.col("s") + F.col("rho") * target) * ann).alias("cov"), "rho")


def downside(panel: DataFrame, order: str, n: int = 126, blend: float = 0.35, ann: float = ANN, keys: Keys = ()) -> DataFrame:
    """Covariance of deviations with the positive ones set to 0, blended with the sample's."""
    f = roll(along([*keys, *PAIR], order), n, 1)
    rows = panel.withColumns({"__mx": F.avg("x").over(f), "__my": F.avg("y").over(f), "__all": F.collect_list(F.struct("x", "y")).over(f), "__s": F.covar_samp("x", "y").over(f)})
    low = F.transform("__all", lambda v: F.struct(F.least(v["x"] - F.col("__mx"), F.lit(0.0)).alias("x"), F.least(v["y"] - F.col("__my"), F.lit(0.0)).alias("y")))
    plain = F.aggregate(
        low, F.struct(*[F.lit(0.0).alias(k) for k in ("x", "y", "xy")]),
        lambda s, v: F.struct((s["x"] + v["x"]).alias("x"), (s["y"] + v["y"]).alias("y"), (s["xy"] + v["x"] * v["y"]).alias("xy")),
        lambda s: (s["xy"] - s["x"] * s["y"] / n) / (n - 1),
    )
    return rows.withColumn("cov", F.when(F.size("__all") >= n, ((1 - blend) * plain + blend * F.col("__s")) * ann)).drop("__mx", "__my", "__all", "__s")


def robust(returns: DataFrame, asset: str, order: str, r: str, n: int = 126, width: float = 4.0, keys: Keys = ()) -> DataFrame:
    """Adds <r>_rob: clipped to the trailing median +- width * 1.4826 MAD (null spread: not clipped)."""
    f = roll(along([*keys, asset], order), n)
    rows = returns.withColumns({"__m": F.percentile(r, 0.5).over(f), "__all": F.collect_list(r).over(f)})
    dev = F.array_sort(F.transform("__all", lambda x: F.abs(x - F.col("__m"))))
    k = F.size(dev)
    mad = (F.get(dev, ((k - 1) / 2).cast("int")) + F.get(dev, (k / 2).cast("int"))) / 2
    b = width * 1.4826 * mad
    return rows.withColumn(f"{r}_rob", F.when(b > 0, F.least(F.greatest(F.col(r), F.col("__m") - b), F.col("__m") + b)).otherwise(F.col(r))).drop("__m", "__all")


def regime_blend(fast: DataFrame, slow: DataFrame, stress: DataFrame, order: str, keys: Keys = ()) -> DataFrame:
    """p * fast + (1 - p) * slow, with p per date in ``stress`` (keys, order, p)."""
    on = [*keys, order, "i", "j"]
    both = fast.select(*on, F.col("cov").alias("__f")).join(slow.select(*on, F.col("cov").alias("__s")), on)
    return both.join(stress, [*keys, order]).select(*keys, order, "i", "j", (F.col("p") * F.col("__f") + (1 - F.col("p")) * F.col("__s")).alias("cov"))


def dynamic_blend(ewma_: DataFrame, shrunk_: DataFrame, downside_: DataFrame, stress: DataFrame, order: str, keys: Keys = ()) -> DataFrame:
    """(0.45 - 0.2 k) EWMA + 0.35 shrunk + (0.2 + 0.2 k) downside, k = clip((stress - 0.08) / 0.2, 0, 1) of
    the annual vol s per date in ``stress``."""
    k = F.least(F.greatest((F.col("s") - 0.08) / 0.20, F.lit(0.0)), F.lit(1.0))
    on = [*keys, order, "i", "j"]
    rows = [x.where("cov IS NOT NULL").select(*on, F.col("cov").alias(n)) for n, x in (("__e", ewma_), ("__l", shrunk_), ("__w", downside_))]
    both = rows[0].join(rows[1], on).join(rows[2], on).join(stress.where("s IS NOT NULL").select(*keys, order, k.alias("__k")), [*keys, order])
    return both.select(*on, ((0.45 - 0.20 * F.col("__k")) * F.col("__e") + 0.35 * F.col("__l") + (0.20 + 0.20 * F.col("__k")) * F.col("__w")).alias("cov"))


def vix_scaled(cov: DataFrame, vix: DataFrame, order: str, n: int = 252, low: float = 0.35, high: float = 4.0, keys: Keys = ()) -> DataFrame:
    """Times clip((vix / its trailing median)^2); ``vix`` has one row per date of ``cov``."""
    f = roll(along(keys, order), n)
    k = F.pow(F.col("vix") / F.percentile("vix", 0.5).over(f), 2)
    scale = vix.select(*keys, order, F.coalesce(F.least(F.greatest(k, F.lit(low)), F.lit(high)), F.lit(1.0)).alias("__k"))
    return cov.join(scale, [*keys, order]).withColumn("cov", F.col("cov") * F.col("__k")).drop("__k")


def packed(cov: DataFrame, order: str, keys: Keys = ()) -> DataFrame:
    """keys, order, assets, m: one row per date, the full matrix flat and by asset name."""
    by = [*keys, order]
    full = cov.where("cov IS NOT NULL").select(*by, "i", "j", "cov")
    full = full.unionByName(full.where("i < j").select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "cov"))
    cells = F.array_sort(F.collect_list(F.struct("i", "j", "cov")))
    out = full.groupBy(*by).agg(cells.alias("c"), F.array_sort(F.collect_set("i")).alias("assets"))
    return out.where(F.size("c") == F.size("assets") * F.size("assets")).select(*by, "assets", F.transform("c", lambda v: v["cov"]).alias("m"))


def matrix_map(df: DataFrame, order: str, fn, n_out: str = "m", keys: Keys = ()) -> DataFrame:
    """keys, order, assets, m: ``fn(matrix) -> matrix or vector`` on each packed row, in Arrow batches."""
    kinds, by = dict(df.dtypes), [*keys, order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.asarray(fn(np.array(m, float).reshape(len(a), len(a)))).ravel().tolist() for m, a in zip(b["m"], b["assets"])]
            yield b[[*by, "assets"]].assign(**{n_out: out})

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    return df.select(*by, "assets", "m").mapInPandas(run, f"{schema}, assets array<string>, `{n_out}` array<double>")


def psd(m: np.ndarray, floor: float = 1e-8) -> np.ndarray:
    w, v = np.linalg.eigh((m + m.T) / 2)
    return m if w.min() >= floor else (v * np.maximum(w, floor)) @ v.T


def pca(m: np.ndarray, k: int = 3, rest: float = 0.15) -> np.ndarray:
    """The k largest eigenpairs plus a share of the diagonal left."""
    w, v = np.linalg.eigh(m)
    low = (v[:, -k:] * w[-k:]) @ v[:, -k:].T
    return low + rest * np.diag(np.diag(m - low))


def portfolio_vol(cov: DataFrame, weights: DataFrame, order: str, asset: str = "asset", weight: str = "weight", keys: Keys = (), more: Keys = ()) -> DataFrame:
    """keys, more, order, vol = sqrt(w' C w). ``more`` are keys of the weights that their covariance doesn't have."""
    w, on = weights.select(*keys, *more, order, F.col(asset).alias("k"), F.col(weight).alias("w")), [*keys, order]
    rows = cov.join(w.withColumnsRenamed({"k": "i", "w": "wi"}), [*on, "i"]).join(w.withColumnsRenamed({"k": "j", "w": "wj"}), [*on, *more, "j"])
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return rows.groupBy(*keys, *more, order).agg(F.sqrt(F.greatest(F.sum(twice * F.col("wi") * F.col("wj") * F.col("cov")), F.lit(0.0))).alias("vol"))


def mean_correlation(panel: DataFrame, order: str, n: int = 63, keys: Keys = ()) -> DataFrame:
    """keys, order, mean_corr, pairs: the mean |correlation| over i < j of the last n rows."""
    f = roll(along([*keys, *PAIR], order), n)
    rows = panel.where("i < j").withColumn("c", F.when(F.count("*").over(f) >= n, F.corr("x", "y").over(f)))
    return rows.groupBy(*keys, order).agg(F.avg(F.abs("c")).alias("mean_corr"), F.count("c").alias("pairs"))
