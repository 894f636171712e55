"""Portfolio weights per date (keys, d, asset, weight) and their ledgers.

``keys`` tell portfolios (and parameters) apart: every window and join is within them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll
from .covariance import matrix_map, portfolio_vol
from .windows import cross_rank

ANN = 252.0
Keys = Sequence[str]


def normalized(df: DataFrame, order: str, raw: str = "raw", keys: Sequence[str] = ()) -> DataFrame:
    """Adds weight: max(raw, 0) over its sum per date; a zero sum gives equal weights."""
    by = Window.partitionBy(*keys, order)
    x = F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0))
    return df.withColumn("weight", F.when(F.sum(x).over(by) > 1e-12, x / F.sum(x).over(by)).otherwise(1.0 / F.count("*").over(by)))


def capped(df: DataFrame, order: str, cap: float = 0.45, passes: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """No weight above ``cap``: the excess goes to the others in proportion, up to ``passes`` times.
    One array per date (as long as its assets), folded in place."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def one(a: Column, _: Column) -> Column:
        over = total(F.transform(a, lambda x: F.greatest(x - cap, F.lit(0.0))))
        room = total(F.filter(a, lambda x: x < cap))
        return F.transform(a, lambda x: F.when(x >= cap, F.lit(cap)).otherwise(F.when(room > 1e-12, x + over * x / room).otherwise(x)))

    rows = df.groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("asset", "weight"))).alias("__a"))
    w = F.aggregate(F.sequence(F.lit(1), F.lit(passes)), F.transform("__a", lambda v: v["weight"]), one)
    z = F.zip_with(F.col("__a"), w, lambda v, x: F.struct(v["asset"].alias("asset"), x.alias("weight")))
    return rows.select(*keys, order, F.inline(z))


def capped_by_room(df: DataFrame, order: str, cap: float | str = 0.45, keys: Keys = ()) -> DataFrame:
    """Weights that sum to 1 cut at ``cap`` (a number or a key column); what is cut is dealt by the room that
    each has left below it, and where all have too little room together, weights are equal."""
    by = Window.partitionBy(*keys, order)
    c = F.col(cap) if isinstance(cap, str) else F.lit(cap)
    low = F.least(F.col("weight"), c)
    rest, room = 1.0 - F.sum(low).over(by), F.sum(c - low).over(by)
    full = F.when(rest <= 1e-10, low).otherwise(low + (c - low) / room * rest)
    out = df.withColumn("__w", F.when((rest > 1e-10) & (rest >= room), 1.0 / F.count("*").over(by)).otherwise(full))
    return out.withColumn("weight", F.col("__w") / F.sum("__w").over(by)).drop("__w")


def to_target(df: DataFrame, cov: DataFrame, order: str, target: float = 0.10, most: float | str = 1.5, keys: Keys = (), more: Keys = ()) -> DataFrame:
    """Weights scaled to the target vol, gross exposure at most ``most`` (a number or a column); vol is that of
    the scaled weights' parts before scaling. ``more`` are keys that ``cov`` doesn't have."""
    by = [*keys, *more]
    vol = portfolio_vol(cov, df, order, keys=keys, more=more)
    gross = F.sum(F.abs("weight")).over(Window.partitionBy(*by, order))
    k = F.least(target / F.greatest("vol", F.lit(1e-8)), (F.col(most) if isinstance(most, str) else F.lit(most)) / F.greatest(gross, F.lit(1e-12)))
    return df.join(vol, [*by, order]).withColumn("weight", F.col("weight") * k)


def inverse_vol(cov: DataFrame, order: str, keys: Keys = ()) -> DataFrame:
    diag = cov.where("i = j AND cov > 0").select(*keys, order, F.col("i").alias("asset"), (1 / F.sqrt("cov")).alias("raw"))
    return normalized(diag, order, keys=keys)


def momentum_tilt(base: DataFrame, returns: DataFrame, order: str, n: int = 63, strength: float = 0.5, keys: Keys = ()) -> DataFrame:
    """Weights times 1 + strength * (2 rank - 1) of the summed return over the n rows before."""
    by = [*keys, order]
    mom = returns.select(*by, "asset", F.sum("r").over(roll(along([*keys, "asset"], order), n, 1)).alias("__m")).where("__m IS NOT NULL")
    mom = mom.select(*by, "asset", cross_rank(F.col("__m"), by, "__m").alias("__k"))
    rows = base.join(mom, [*by, "asset"]).withColumn("raw", F.col("weight") * (1 + strength * (2 * F.col("__k") - 1)))
    return normalized(rows.drop("weight", "__k"), order, keys=keys)


def min_variance(m: np.ndarray) -> np.ndarray:
    x = np.maximum(np.linalg.pinv(m) @ np.ones(len(m)), 0)
    return x / x.sum() if x.sum() > 0 else np.full(len(m), 1 / len(m))


def vol_capped(m: np.ndarray, cap: float = 0.25) -> np.ndarray:
    x = min_variance(m) * np.minimum(1.0, cap / np.sqrt(np.maximum(np.diag(m), 1e-16)))
    return x / x.sum()


def risk_parity(m: np.ndarray, passes: int = 80) -> np.ndarray:
    """Equal risk contributions by multiplicative steps."""
    x = 1 / np.sqrt(np.maximum(np.diag(m), 1e-16))
    x = x / x.sum()
    for _ in range(passes):
        c = x * (m @ x)
        x = x * np.sqrt(max(c.mean(), 1e-18) / np.maximum(c, 1e-18))
        x = x / x.sum()
    return x


def diversified(m: np.ndarray) -> np.ndarray:
    """Risk parity over each asset's mean |correlation| (0.25 at least)."""
    s = np.sqrt(np.maximum(np.diag(m), 1e-16))
    crowd = np.maximum((np.abs(m / np.outer(s, s)).sum(0) - 1) / max(len(m) - 1, 1), 0.25)
    x = risk_parity(m) / crowd
    return x / x.sum()


def optimised(matrices: DataFrame, order: str, fn=min_variance, keys: Keys = ()) -> DataFrame:
    """keys, order, asset, weight of a function of each date's packed matrix."""
    out = matrix_map(matrices, order, fn, "w", keys)
    return out.select(*keys, order, F.inline(F.arrays_zip(F.col("assets").alias("asset"), F.col("w").alias("weight"))))


def buy_and_hold(df: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each asset of a portfolio (its keys) keeps its first weight."""
    return df.withColumn("weight", F.first("weight").over(along([*keys, "asset"], order)))


def hysteresis(df: DataFrame, order: str, keys: Sequence[str], band: float = 0.05) -> DataFrame:
    """keys, order, asset, weight: a portfolio moves to the wanted weights only on dates where the summed
    change from those held reaches the band. One fold per portfolio over one row a date (its assets as a
    map), so many portfolios are spread over tasks."""
    import pandas as pd

    by_day = df.groupBy(*keys, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("asset", "weight")))).alias("w"))
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", held map<string,double>"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        held: dict[str, float] = {}
        out = []
        for w in pdf["w"]:
            w = dict(w)
            if not held or sum(abs(w.get(k, 0.0) - held.get(k, 0.0)) for k in w.keys() | held.keys()) >= band:
                held = w
            out.append(held)
        return pdf[[*keys, order]].assign(held=out)

    return by_day.groupBy(*keys).applyInPandas(step, schema).select(*keys, order, F.explode("held").alias("asset", "weight"))


def with_means(matrices: DataFrame, returns: DataFrame, order: str, n: int = 126, ann: float = ANN, keys: Keys = ()) -> DataFrame:
    """Packed matrices with mu: each asset's mean annual return of the n rows before, in the assets' order."""
    m = F.avg("r").over(roll(along([*keys, "asset"], order), n, 1)) * ann
    rows = returns.select(*keys, order, "asset", m.alias("__m")).where("__m IS NOT NULL")
    mu = rows.groupBy(*keys, order).agg(F.map_from_entries(F.collect_list(F.struct("asset", "__m"))).alias("__mu"))
    return matrices.join(mu, [*keys, order]).withColumn("mu", F.transform("assets", lambda a: F.coalesce(F.element_at("__mu", a), F.lit(0.0)))).drop("__mu")


def mean_variance(matrices: DataFrame, order: str, aversion: float = 6.0, keys: Keys = ()) -> DataFrame:
    """keys, order, asset, weight: the inverse matrix times mu over the risk aversion, long only and normalised;
    nothing above zero gives equal weights."""
    kinds, by = dict(matrices.dtypes), [*keys, order]

    def run(batches):
        for b in batches:
            out = []
            for m, mu, a in zip(b["m"], b["mu"], b["assets"]):
                x = np.maximum(np.linalg.pinv(np.array(m, float).reshape(len(a), len(a))) @ np.array(mu, float) / aversion, 0.0)
                out.append((x / x.sum() if x.sum() > 0 else np.full(len(a), 1 / len(a))).tolist())
            yield b[[*by, "assets"]].assign(w=out)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    out = matrices.select(*by, "assets", "m", "mu").mapInPandas(run, f"{schema}, assets array<string>, w array<double>")
    return out.select(*by, F.inline(F.arrays_zip(F.col("assets").alias("asset"), F.col("w").alias("weight"))))


def proxy(returns: DataFrame, order: str, n: int = 126, keys: Keys = ()) -> DataFrame:
    """keys, order, proxy_vol, proxy_drawdown of the equal-weight return: annual vol of the 21 rows before and
    the drawdown at the end of the n rows before."""
    t = along(keys, order)
    ew = returns.groupBy(*keys, order).agg(F.avg("r").alias("r"))
    f = roll(t, n, 1)
    level = F.aggregate(
        F.collect_list("r").over(f), F.struct(F.lit(0.0).alias("e"), F.lit(-1e300).alias("p")),
        lambda s, x: F.struct((s["e"] + x).alias("e"), F.greatest(s["p"], s["e"] + x).alias("p")), lambda s: F.exp(s["e"] - s["p"]) - 1,
    )
    return ew.select(*keys, order, (F.stddev_samp("r").over(roll(t, 21, 1)) * ANN**0.5).alias("proxy_vol"), F.when(F.count("r").over(f) > 0, level).alias("proxy_drawdown"))


def risk_budget(weights: DataFrame, proxies: DataFrame, order: str, defensive: Column, high: float = 0.18, boost: float = 1.6, keys: Keys = ()) -> DataFrame:
    """Weights with the defensive assets' (a condition on the weights' rows) raised where the proxy vol is above
    ``high``, normalised."""
    by = [*keys, order]
    rows = weights.withColumn("__d", defensive).join(proxies.select(*by, "proxy_vol"), by)
    rows = rows.withColumn("raw", F.col("weight") * F.when((F.col("proxy_vol") > high) & F.col("__d"), boost).otherwise(1.0))
    return normalized(rows.drop("weight", "__d"), order, keys=keys).select(*by, "asset", "weight")


def braked(weights: DataFrame, proxies: DataFrame, order: str, trigger: float = 0.08, scale: float = 0.55, keys: Keys = ()) -> DataFrame:
    """Weights times ``scale`` where the proxy stands more than ``trigger`` under its peak."""
    k, by = F.when(F.col("proxy_drawdown") < -trigger, scale).otherwise(1.0), [*keys, order]
    return weights.join(proxies.select(*by, "proxy_drawdown"), by).select(*by, "asset", (F.col("weight") * k).alias("weight"))


def portfolio_ledger(weights: DataFrame, returns: DataFrame, order: str, bps: float = 5.0, n: int = 63, keys: Keys = (), rf: str | None = None) -> DataFrame:
    """keys, order, gross, cash, turnover, cost, ret, equity, window_vol: a date's weights earn the next
    date's returns less the cost of their own change. With ``rf`` (a column of the returns, one value a date)
    the rest of the capital earns it."""
    w, by = along([*keys, "asset"], order), [*keys, order]
    rows = returns.select(*by, "asset", "r", *([rf] if rf else [])).join(weights.select(*by, "asset", "weight"), [*by, "asset"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    rows = rows.withColumns({"__dw": F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(w), F.lit(0.0))), "__g": F.coalesce(F.lag("weight").over(w) * F.col("r"), F.lit(0.0))})
    day = rows.groupBy(*by).agg(F.sum(F.abs("weight")).alias("gross"), F.sum("__dw").alias("turnover"), F.sum("__g").alias("__gain"), *([F.max(rf).alias("__f")] if rf else []))
    t = along(keys, order)
    day = day.withColumn("cost", F.col("turnover") * (bps / 1e4))
    cash = F.coalesce((1 - F.lag("gross").over(t)) * F.col("__f"), F.lit(0.0)) if rf else F.lit(0.0)
    day = day.withColumn("ret", F.col("__gain") + cash - F.coalesce(F.lag("cost").over(t), F.lit(0.0)))
    f = roll(t, n)
    return day.select(
        *by, "gross", (1 - F.col("gross")).alias("cash"), "turnover", "cost", "ret", F.exp(F.sum("ret").over(cum(t))).alias("equity"),
        F.when(F.count("ret").over(f) >= n, F.stddev_samp("ret").over(f) * ANN**0.5).alias("window_vol"),
    )


def calibrated(ledger: DataFrame, keys: Sequence[str], order: str, target: float = 0.10, train: int = 252, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """keys, order, multiplier, ret_cal, equity_cal: returns scaled by target over the vol of the first
    ``train`` rows, clipped to [low, high]."""
    w = along(list(keys), order)
    first = ledger.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= train)
    k = F.least(F.greatest(target / F.greatest(F.stddev_samp("ret") * ANN**0.5, F.lit(1e-8)), F.lit(low)), F.lit(high))
    m = first.groupBy(*keys).agg(k.alias("multiplier"))
    rows = ledger.join(m, list(keys)).withColumn("ret_cal", F.col("ret") * F.col("multiplier"))
    return rows.select(*keys, order, "multiplier", "ret_cal", F.exp(F.sum("ret_cal").over(cum(w))).alias("equity_cal"))
