"""Pair scores for every date in one table, and the ordered selections over them."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import contains_any, pair_parts
from ..functions.frames import along, cum, roll

Keys = Sequence[str]


def base_score(sharpe: Column, drawdown: Column, bias: Column, invalid: Column, exceptions: Column, switch: Column, lam: dict[str, float] | None = None) -> Column:
    """perf (Sharpe - dd drawdown) + bias - inv invalid - exc exceptions - cost switch."""
    p = {"perf": 1.0, "dd": 1.0, "inv": 1.0, "exc": 1.0, "cost": 0.05} | (lam or {})
    return p["perf"] * (sharpe - p["dd"] * drawdown) + bias - p["inv"] * invalid - p["exc"] * exceptions - p["cost"] * switch.cast("double")


#: Regime, part of the pair's name, words in it, bias.
NAME_BIAS = (
    ("high", "controller", ("regime", "drawdown", "cvar"), 0.35), ("high", "estimator", ("garch", "har"), 0.25),
    ("low", "controller", ("naive", "constant", "hysteresis"), 0.20), ("low", "estimator", ("ewma", "realized"), 0.15),
    ("middle", "controller", ("voltargetclip", "variance"), 0.10),
)


def regime_bias(df: DataFrame, pair: str, regime: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Adds bias: the sum of the pair's, estimator's and controller's scores in the row's regime, from
    tables of (key, regime, score); where none is set, name heuristics."""
    est, ctrl = pair_parts(F.col(pair))
    rows = df.withColumns({"estimator": est, "controller": ctrl})
    for key, t in tables.items():
        on = pair if key == "pair" else key
        t = t.select(F.col(key).alias(on), F.col("regime").alias(regime), F.col("score").alias(f"__{key}"))
        rows = rows.join(t, [on, regime], "left")
    total = sum((F.coalesce(F.col(f"__{k}"), F.lit(0.0)) for k in tables), F.lit(0.0))
    guess = F.lit(0.0)
    for label, part, words, size in NAME_BIAS:
        guess += F.when((F.col(regime) == label) & contains_any(F.col(part), list(words)), size).otherwise(0.0)
    return rows.withColumn("bias", F.when(total == 0, guess).otherwise(total)).drop("estimator", "controller", *[f"__{k}" for k in tables])


def score_map(df: DataFrame, keys: Keys, order: str, pair: str, score: str) -> DataFrame:
    """keys, order, scores: one map per date, so the selection fold reads one row a date."""
    return df.groupBy(*keys, order).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(pair, score)))).alias("scores"))


def sticky_argmax(df: DataFrame, keys: Keys, order: str, sticky: int = 5, margin: float = 0.0) -> DataFrame:
    """keys, order, selected, switched, score: the best score of each row of maps, kept for ``sticky``
    rows at least and left only for a gain above ``margin``. A fold per key (config x split)."""
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", selected string, switched boolean, score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        active, since, rows = None, 0, []
        for scores in pdf["scores"]:
            scores = {k: v for k, v in dict(scores).items() if v is not None and v == v}
            switched = False
            if scores:
                best = min(scores, key=lambda k: (-scores[k], k))
                if active is None:
                    active, since = best, 0
                else:
                    since += 1
                    gain = scores[best] - scores.get(active, float("-inf"))
                    if best != active and since >= sticky and gain > margin:
                        active, since, switched = best, 0, True
            rows.append((active, switched, scores.get(active) if active else None))
        out = pdf[[*keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["selected", "switched", "score"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


def constrained(df: DataFrame, keys: Keys, order: str, limits: Sequence[tuple[str, Column]]) -> DataFrame:
    """Adds blocked: the name of the first limit that fails (a Column that is true when it holds)."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(limits):
        out = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(out)
    return df.withColumn("blocked", out)


#: Weights of Sharpe, drawdown, turnover, vol error and forecast loss in the constrained router's score.
CONSTRAINED = (1.0, 0.5, 0.5, 0.5, 1.0)


def constrained_score(sharpe: Column, drawdown: Column, turnover: Column, vol_error: Column, loss: Column, bias: Column | None = None, penalty: Column | None = None) -> Column:
    """Performance and the regime's bias, less what the pair costs to control and a diagnostic penalty."""
    a, b, c, e, k = CONSTRAINED
    some = lambda x: F.coalesce(x, F.lit(0.0))
    out = a * some(sharpe) - b * F.greatest(some(drawdown), F.lit(0.0)) - (c * some(turnover) + e * some(vol_error) + k * some(loss))
    out = out if bias is None else out + some(bias)
    return out if penalty is None else out - some(penalty)


def constrained_choice(df: DataFrame, keys: Keys, order: str, default: str, sticky: int = 5, switch: float = 0.05) -> DataFrame:
    """keys, order, selected, switched, n_feasible, held_by: the choice among pairs that no limit blocks.

    Rows hold maps ``scores`` and ``blocked`` (a reason, or null) by pair, and ``default``, the pair to begin with. The
    best feasible score takes over once the active pair has ``sticky`` rows; other pairs pay ``switch``. Where every
    pair is blocked the active one is held. ``held_by`` says why nothing changed: blocked, sticky or best. Ties go to
    the active pair, then to the lesser name. A fold per key.
    """
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", selected string, switched boolean, n_feasible int, held_by string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        active, since, rows = pdf[default].iloc[0], 0, []
        for scores, blocked in zip(pdf["scores"], pdf["blocked"]):
            blocked = dict(blocked)
            free = {k: v - switch * (k != active) for k, v in dict(scores).items() if v is not None and v == v and blocked.get(k) is None}
            best = min(free, key=lambda k: (-round(free[k], 9), k != active, k), default=active)
            since += 1
            switched = best != active and since >= sticky
            held = None if switched else "blocked" if not free else "sticky" if best != active else "best"
            if switched:
                active, since = best, 0
            rows.append((active, switched, len(free), held))
        out = pdf[[*keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["selected", "switched", "n_feasible", "held_by"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


def softmax(df: DataFrame, by: Keys, score: str, temperature: float = 0.25) -> DataFrame:
    """Adds prob, entropy over the rows of each key."""
    w = Window.partitionBy(*by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    rows = df.withColumn("prob", e / F.sum(e).over(w))
    return rows.withColumn("entropy", -F.sum(F.when(F.col("prob") > 0, F.col("prob") * F.log("prob")).otherwise(0.0)).over(w))


def smoothed_experts(df: DataFrame, keys: Keys, order: str, pair: str, alpha: float = 0.3) -> DataFrame:
    """Adds prob_ema: each pair's probability smoothed over dates (the renormalised sum is one, since
    the smoothing is linear)."""
    from .windows import ewma

    halflife = 1.0 / math.log2(1 / (1 - alpha))
    return ewma(df, [*keys, pair], order, "prob", halflife=halflife).withColumnRenamed("ewma", "prob_ema")


def lin_ucb(df: DataFrame, keys: Keys, order: str, context: Sequence[str], rewards: str, arms: Sequence[str], alpha: float = 0.5, ridge: float = 1.0) -> DataFrame:
    """keys, order, arm, ucb, reward: contextual bandit with a ridge model per arm; only the chosen
    arm's reward (from a map column) updates it. A fold per key."""
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", arm string, ucb double, reward double"
    names, cols = sorted(arms), list(context)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        d = len(cols) + 1
        inv, b = {a: np.eye(d) / ridge for a in names}, {a: np.zeros(d) for a in names}
        rows = []
        for x, r in zip(np.nan_to_num(pdf[cols].to_numpy(float)), pdf[rewards]):
            z = np.append(x, 1.0)
            ucb = {a: float((inv[a] @ b[a]) @ z + alpha * np.sqrt(z @ inv[a] @ z)) for a in names}
            arm = min(names, key=lambda a: (-ucb[a], a))
            got = dict(r).get(arm) or 0.0
            u = inv[arm] @ z
            inv[arm] -= np.outer(u, u) / (1 + z @ u)
            b[arm] = b[arm] + got * z
            rows.append((arm, ucb[arm], float(got)))
        out = pdf[[*keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["arm", "ucb", "reward"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


#: Fixed values of the bandit: scales of the context's eight tanh columns (market vol, mean, skew; own Sharpe, drawdown,
#: vol, vol error; observations) and the weights of drawdown, turnover, vol error and forecast loss in the reward.
CONTEXT_SCALES = (0.25, 0.50, 2.00, 2.00, 0.25, 0.25, 0.10, 252.0)
REWARD = (0.5, 0.2, 0.5, 0.25)
REWARD_CLIP = 5.0


def own_metrics(returns: Sequence[float], target: float, ann: float = 252.0) -> tuple[float, float, float, float]:
    """Sharpe, drawdown (loss), vol and vol error of the returns that a strategy has earned; zeros below two."""
    import numpy as np

    if len(returns) < 2:
        return 0.0, 0.0, 0.0, 0.0
    x = np.asarray(returns, float)
    sd = float(x.std(ddof=1))
    level = np.exp(np.cumsum(x))
    vol = sd * ann**0.5
    return (float(x.mean() / sd * ann**0.5) if sd > 0 else 0.0), float(-(level / np.maximum.accumulate(level) - 1).min()), vol, abs(vol - target)


def context_bandit(df: DataFrame, keys: Keys, order: str, arms: Sequence[str], target: float = 0.10, alpha: float = 0.5, ridge: float = 1.0, switch: float = 0.05, n: int = 63) -> DataFrame:
    """keys, order, arm, ucb, reward: the 13-column contextual bandit.

    Rows hold market_vol, market_mean, market_skew, market_obs, regime (low, mid or high, as of the row), and maps
    by pair: ``ret`` of the row, and ``metrics`` (sharpe, drawdown, turnover, vol_error, loss over the pair's last
    rows). The context is made in the fold, since four columns are the metrics of the last ``n`` returns that the
    bandit itself has earned: the arm chosen on a row earns the next row's return. On that row the arm learns its
    reward, Sharpe less REWARD times the pair's other metrics and the cost of a switch, clipped. Each arm is a
    ridge model, updated by rank one; ties go to the lesser name; a fold per key with 13 x 13 numbers an arm.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", arm string, ucb double, reward double"
    names = sorted(arms)

    def reward(m, switched: bool) -> float:
        a, b, c, e = REWARD
        some = lambda k: float(m[k]) if m is not None and m[k] is not None else 0.0
        value = some("sharpe") - a * max(some("drawdown"), 0.0) - b * some("turnover") - c * some("vol_error") - e * some("loss")
        return float(np.clip(value - switch * switched, -REWARD_CLIP, REWARD_CLIP))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        inv, b = {a: np.eye(13) / ridge for a in names}, {a: np.zeros(13) for a in names}
        arm, last, switched, earned, rows = None, None, False, [], []
        for row in pdf.itertuples(index=False):
            got = None
            if arm is not None:
                earned = [*earned, float(dict(row.ret).get(arm) or 0.0)][-n:]
                got = reward(dict(row.metrics).get(arm), switched)
                u = inv[arm] @ last
                inv[arm] = inv[arm] - np.outer(u, u) / (1 + last @ u)
                b[arm] = b[arm] + got * last
            market = [row.market_vol, row.market_mean, row.market_skew]
            values = [*market, *own_metrics(earned, target), row.market_obs]
            x = [np.tanh(0.0 if v is None or v != v else v / s) for v, s in zip(values, CONTEXT_SCALES)]
            last = np.array([*x, *[float(row.regime == k) for k in ("low", "mid", "high")], float(arm is not None), 1.0])
            ucb = {a: float((inv[a] @ b[a]) @ last + alpha * np.sqrt(max(last @ inv[a] @ last, 0.0)) - switch * (arm is not None and a != arm)) for a in names}
            pick = min(names, key=lambda a: (-round(ucb[a], 12), a))
            switched = arm is not None and pick != arm
            arm = pick
            rows.append((arm, ucb[arm], got))
        out = pdf[[*keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["arm", "ucb", "reward"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


#: Weights of Sharpe, drawdown, CVaR and the drawdown's inconsistency by sensitivity.
SENSITIVITY: dict[str, tuple[float, float, float, float]] = {
    "very_low": (0.80, 4.75, 3.25, 2.25), "low": (0.90, 4.25, 2.75, 1.75), "normal": (1.00, 3.50, 2.00, 1.25), "high": (1.15, 2.75, 1.40, 0.80), "very_high": (1.25, 2.25, 1.00, 0.50),
}


def candidate_score(sharpe: Column, drawdown: Column, cvar: Column, blocks: Sequence[tuple[Column, Column, Column]] = (), sensitivity: str = "normal") -> Column:
    """Sharpe less drawdown, CVaR and inconsistency of the drawdown (its distance from 0.06 and excess
    over 0.10). ``blocks`` are the same three metrics over shorter windows: their mean Sharpe counts 45 %,
    drawdown and CVaR are the worse of both, and their drawdowns make the inconsistency."""
    a, b, c, e = SENSITIVITY[sensitivity]
    some = lambda x: F.coalesce(x, F.lit(0.0))
    sharpe, drawdown, cvar = some(sharpe), F.abs(some(drawdown)), F.abs(some(cvar))
    if blocks:
        n = len(blocks)
        mean = lambda xs: sum(xs[1:], xs[0]) / n
        dds = [F.abs(some(x[1])) for x in blocks]
        dd = mean(dds)
        spread = F.sqrt(mean([(x - dd) * (x - dd) for x in dds]))
        uneven = spread + F.abs(dd - 0.06) + F.greatest(*[x - 0.10 for x in dds], F.lit(0.0))
        sharpe = 0.55 * sharpe + 0.45 * mean([some(x[0]) for x in blocks])
        cvar = F.greatest(cvar, mean([F.abs(some(x[2])) for x in blocks]))
        drawdown = F.greatest(drawdown, dd)
    else:
        uneven = F.abs(drawdown - 0.06) + F.greatest(drawdown - 0.10, F.lit(0.0))
    return a * sharpe - b * drawdown - c * cvar - e * uneven


def risk_adjusted(edge: Column, turnover: Column, drawdown: Column, vol_error: Column, fallback: Column | None = None) -> Column:
    """Return edge over a benchmark (and 15 % of another score, if given) less 4 turnover, drawdown / 2 and
    2 vol error."""
    out = edge - 4.0 * turnover - 0.5 * drawdown - 2.0 * vol_error
    return out if fallback is None else out + 0.15 * F.coalesce(fallback, F.lit(0.0))


#: Fixed values by sensitivity: score gap to switch, drawdown of the active pair that lowers it to the
#: next, and the gap after a change of regime (none: any).
SWITCH: dict[str, tuple[float, float, float, float | None]] = {
    "very_low": (0.12, 0.16, 0.08, 0.10), "low": (0.05, 0.12, 0.00, 0.03), "normal": (-0.02, 0.08, -0.10, -0.02), "high": (-0.10, 0.06, -0.20, None), "very_high": (-0.18, 0.04, -0.30, None),
}


def rule_switches(df: DataFrame, keys: Keys, order: str, sensitivity: str = "normal", hold: int = 30, step: int = 1) -> DataFrame:
    """keys, order, active, best, switched: the deterministic switch rule as a fold per key.

    Rows hold maps ``scores`` and ``drawdowns`` of the pairs and ``changed`` (a new regime). The best other
    pair takes over after ``hold`` rows of the active one if it is good enough: by the plain gap, after a
    change of regime, or in a deep drawdown of the active pair. A row counts as ``step`` (rows that are
    checkpoints). Ties go to the lesser name."""
    import pandas as pd

    gap, deep, deep_gap, new_gap = SWITCH[sensitivity]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", active string, best string, switched boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        active, since, rows = None, 0, []
        for scores, drawdowns, changed in zip(pdf["scores"], pdf["drawdowns"], pdf["changed"]):
            scores = {k: v for k, v in dict(scores).items() if v is not None and v == v}
            others = sorted((-v, k) for k, v in scores.items() if k != active)
            best, switched = (others[0][1] if others else None), False
            if active is None:
                active, since = best, 0
            elif best is not None:
                since += step
                lead = scores[best] - scores.get(active, float("-inf"))
                fell = abs(dict(drawdowns).get(active) or 0.0) > deep
                switched = since >= hold and (lead >= gap or fell and lead >= deep_gap or bool(changed) and (new_gap is None or lead >= new_gap))
                if switched:
                    active, since = best, 0
            rows.append((active, best, switched))
        out = pdf[[*keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["active", "best", "switched"]))

    return df.groupBy(*keys).applyInPandas(run, schema)


@dataclass(frozen=True)
class Switching:
    """One configuration of the gated rule. Ablations turn a part of it off: ``regime`` (scores without the regime's
    bias, no change of regime), ``ranks`` (no challengers), ``without`` (a baseline pair that is no candidate),
    ``selects`` (the best score at every review, without any gate)."""

    sensitivity: str = "normal"
    regime: bool = True
    ranks: bool = True
    without: str | None = None
    selects: bool = False


def _beaten(active: str, others: Sequence[str], windows: Sequence[Mapping[str, Mapping]], short: Mapping[str, Mapping]) -> tuple[int, int]:
    """How many of ``others`` beat the active pair in the short window, and in two windows or more."""
    mine = short.get(active) or {}
    sharpe, ann = mine.get("sharpe") or 0.0, mine.get("ann") or 0.0
    quick = many = 0
    for p in others:
        if x := short.get(p):
            quick += x["sharpe"] > sharpe or x["sharpe"] >= sharpe and x["ann"] > ann
        pairs = [(w.get(p), w.get(active)) for w in windows]
        many += sum(1 for x, a in pairs if x and a and x["rank"] < a["rank"] and (x["sharpe"] >= a["sharpe"] or x["drawdown"] <= a["drawdown"])) >= 2
    return quick, many


def gated_switches(df: DataFrame, keys: Keys, order: str, configs: Mapping[str, Switching], windows: Sequence[str], short: str, step: int = 1) -> DataFrame:
    """config, keys, order, active, best, switched, reason: the switch rule with its gates, all configurations in one pass.

    Rows are reviews: maps ``scores``, ``plain`` (without the regime) and ``drawdowns`` of the pairs, ``changed``, and a map of
    (rank, sharpe, ann, drawdown) by pair for each of ``windows``, ``short`` being one of them. The fold counts
    challengers against its own active pair. The best other pair takes over at once where the sensitivity is
    high and a short-term challenger exists; else, once the hold is over or enough pairs beat the active one in
    several windows, by the plain gap, after a change of regime, or in a deep drawdown. Ties go to the lesser
    name; a review counts as ``step`` rows; a fold per configuration and key, over its reviews alone.
    """
    import pandas as pd

    from .reviews import GROUP

    kinds = dict(df.dtypes)
    schema = "config string, " + ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order]) + ", active string, best string, switched boolean, reason string"

    def why(c: Switching, scores: dict, active: str, best: str, since: int, row) -> str | None:
        gap, deep, deep_gap, new_gap = SWITCH[c.sensitivity]
        group, hold = GROUP[c.sensitivity]
        maps = {w: dict(getattr(row, w) or {}) for w in windows} if c.ranks else {w: {} for w in windows}
        quick, many = _beaten(active, [p for p in scores if p != active], list(maps.values()), maps[short])
        if c.sensitivity in ("high", "very_high") and quick >= 1:
            return "short_term"
        if since < hold and many < group:
            return None
        lead = scores[best] - scores.get(active, float("-inf"))
        fell = abs(dict(row.drawdowns).get(active) or 0.0) > deep
        if c.regime and bool(row.changed) and (new_gap is None or lead >= new_gap):
            return "regime"
        if lead >= gap:
            return "score"
        return "drawdown" if fell and lead >= deep_gap else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        c = configs[pdf["config"].iloc[0]]
        active, since, rows = None, 0, []
        for row in pdf.itertuples(index=False):
            scores = {k: v for k, v in dict(row.scores if c.regime else row.plain).items() if v is not None and v == v and k != c.without}
            others = sorted((-v, k) for k, v in scores.items() if c.selects or k != active)
            best, reason = (others[0][1] if others else None), None
            if active is None:
                active, since = best, 0
            elif best is not None:
                since += step
                reason = ("selection" if best != active else None) if c.selects else why(c, scores, active, best, since, row)
                if reason:
                    active, since = best, 0
            rows.append((active, best, reason is not None, reason))
        out = pdf[["config", *keys, order]].reset_index(drop=True)
        return out.join(pd.DataFrame(rows, columns=["active", "best", "switched", "reason"]))

    rows = df.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    return rows.groupBy("config", *keys).applyInPandas(run, schema)


def diversified_picks(df: DataFrame, keys: Keys, order: str, choice: str = "selected", most: int = 3, margin: float = 0.05) -> DataFrame:
    """keys, order, <choice>, picked: after ``most`` equal picks in a row the closest other pair (a score at
    most ``margin`` below, the largest, ties to the lesser name) is picked instead, if there is one."""
    import pandas as pd

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, order, choice]) + ", picked string"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        last, count, out = None, 0, []
        for name, scores in zip(pdf[choice], pdf["scores"]):
            scores, pick = dict(scores), name
            if name is not None and name == last and count >= most:
                close = sorted((-v, k) for k, v in scores.items() if k != name and v is not None and v >= (scores.get(name) or 0.0) - margin)
                pick = close[0][1] if close else name
            count = count + 1 if pick == last else 1
            last = pick
            out.append(pick)
        return pdf[[*keys, order, choice]].assign(picked=out)

    return df.groupBy(*keys).applyInPandas(run, schema)


#: Fixed values of the portfolio router: the vol limit, its penalty and the weights of the score; the gains that a
#: candidate needs, and the switch's own cost in annual return on top.
MOST_VOL, OVER_VOL, CALM_DRAWDOWN, DEFENSIVE_DRAWDOWN = 0.11, 1.4, 0.35, 0.70
TURNOVER, SHARPE, ANNUAL, TRAILING = 0.05, 0.75, 1.75, 0.08
ANNUAL_GAIN, SHARPE_GAIN, SWITCH_PENALTY = 0.02, 0.20, 0.001


def portfolio_score(drawdown: Column, vol: Column, turnover: Column, sharpe: Column, ann: Column, ret: Column, regime: Column | None = None, most_vol: float = MOST_VOL) -> Column:
    """Score of a portfolio candidate, the least is best; a defensive regime doubles the drawdown's weight."""
    weight = F.lit(CALM_DRAWDOWN) if regime is None else F.when(regime.isin("risk_on", "balanced"), CALM_DRAWDOWN).otherwise(DEFENSIVE_DRAWDOWN)
    return weight * drawdown + OVER_VOL * F.greatest(vol - most_vol, F.lit(0.0)) + TURNOVER * turnover - SHARPE * sharpe - ANNUAL * ann - TRAILING * ret


def clears_hurdle(vol: Column, ann_gain: Column, sharpe_gain: Column, most_vol: float = MOST_VOL, ann: float = ANNUAL_GAIN, sharpe: float = SHARPE_GAIN, penalty: float = SWITCH_PENALTY) -> Column:
    """A candidate inside the vol limit whose return (after the switch's cost) or Sharpe is far enough above the
    active pair's."""
    return (vol <= most_vol) & ((ann_gain >= ann + penalty) | (sharpe_gain >= sharpe))


def routed_weights(selected: DataFrame, weights: DataFrame, keys: Keys, order: str, lag: int = 1) -> DataFrame:
    """keys, order, portfolio, asset, weight: what a strategy holds that follows its selection of ``lag`` rows before.

    ``weights`` (portfolio, order, asset, weight) are each portfolio's own. On a switch a strategy trades the
    difference of two weight vectors: assets that both hold are traded by their difference only, so the cost of
    a switch is that of its turnover in ``portfolio_ledger``, not a flat one.
    """
    rows = selected.select(*keys, order, F.lag("selected", lag).over(along(keys, order)).alias("portfolio")).where("portfolio IS NOT NULL")
    return rows.join(weights.select("portfolio", order, "asset", "weight"), ["portfolio", order]).select(*keys, order, "portfolio", "asset", "weight")


def windows_context(df: DataFrame, keys: Keys, order: str, r: str, windows: Sequence[int], ann: float = 252.0) -> DataFrame:
    """keys, win, n, total, ann, vol, drawdown, cvar over each key's last rows; ``k`` numbers rows from the
    last one."""
    from .metrics import with_quantile
    from .windows import equity_curve

    rows = df.withColumn("win", F.explode(F.filter(F.array(*[F.lit(n) for n in windows]), lambda n: F.col("k") <= n)))
    key, c = [*keys, "win"], F.col(r)
    rows = with_quantile(equity_curve(rows, key, order, r), key, r, 0.05, "__q")
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), (F.exp(F.sum(c)) - 1).alias("total"), (F.avg(c) * ann).alias("ann"), (F.stddev_samp(c) * ann**0.5).alias("vol"),
        F.min("drawdown").alias("drawdown"), F.avg(F.when(c <= F.col("__q"), c)).alias("cvar"),
    )


def versus(df: DataFrame, benchmark: DataFrame, on: Keys, metrics: dict[str, bool]) -> DataFrame:
    """Adds <m>_delta and <m>_better against a benchmark's row; the flag says if larger is better."""
    b = benchmark.select(*on, *[F.col(m).alias(f"__{m}") for m in metrics])
    rows = df.join(b, list(on))
    for m, larger in metrics.items():
        delta = F.col(m) - F.col(f"__{m}")
        rows = rows.withColumns({f"{m}_delta": delta, f"{m}_better": (delta > 0) if larger else (delta < 0)}).drop(f"__{m}")
    return rows


def event_reason(tests: Sequence[tuple[str, Column]]) -> Column:
    """The names of the tests that hold, joined by +; empty if none."""
    return F.concat_ws("+", *[F.when(F.coalesce(t, F.lit(False)), n) for n, t in tests])


def spaced_events(df: DataFrame, keys: Keys, order: str, reason: str, gap: int = 10) -> DataFrame:
    """Adds fired: a row with a reason, at least ``gap`` rows after the last that fired."""
    import pandas as pd

    schema = ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", fired boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        last, out = None, []
        for i, x in enumerate(pdf[reason]):
            hit = bool(x) and (last is None or i - last >= gap)
            last = i if hit else last
            out.append(hit)
        return pdf.assign(fired=out)

    return df.groupBy(*keys).applyInPandas(run, schema)


def replay(days: DataFrame, switches: DataFrame, ledger: DataFrame, keys: Keys, order: str, pair: str = "pair") -> DataFrame:
    """keys, order, pair, ret: a switch log held from each date to the next, joined to the ledger."""
    from .joins import asof

    active = asof(days.select(*keys, order).distinct(), switches.select(*keys, order, pair), keys, order, [pair])
    return active.where(F.col(pair).isNotNull()).join(ledger.select(*keys, order, pair, "ret"), [*keys, order, pair])


def routed_ledger(selected: DataFrame, ledger: DataFrame, keys: Keys, order: str, lag: int = 1, switch_cost: float = 0.0005, on: Keys | None = None) -> DataFrame:
    """keys, order, pair, switched, ret, equity: the selection of ``lag`` rows before earns the row's
    return, less a cost on rows where the pair changes. ``on``: the ledger's keys, if it has fewer."""
    w = along(keys, order)
    rows = selected.withColumn("pair", F.lag("selected", lag).over(w)).where("pair IS NOT NULL").select(*keys, order, "pair")
    own = list(keys if on is None else on)
    rows = rows.join(ledger.select(*own, order, "pair", "ret"), [*own, order, "pair"])
    prev = F.lag("pair").over(w)
    rows = rows.withColumn("switched", prev.isNotNull() & (prev != F.col("pair")))
    rows = rows.withColumn("ret", F.col("ret") - F.when(F.col("switched"), switch_cost).otherwise(0.0))
    return rows.withColumn("equity", F.exp(F.sum("ret").over(cum(w)))).select(*keys, order, "pair", "switched", "ret", "equity")


def payload(df: DataFrame, by: Keys, fields: Sequence[str], name: str = "candidates") -> DataFrame:
    """by, <name>: each key's rows as one JSON array in order of the first field, for audit."""
    return df.groupBy(*by).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias(name))
