"""Position rules that feed back on their own weight and equity, as one ordered fold per series."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Keys = Sequence[str]


def no_brake(drawdown: float) -> float:
    return 1.0


@dataclass(frozen=True)
class Rule:
    """How a wanted weight becomes a held one.

    ``brake`` maps the drawdown of the own equity to a factor of the wanted weight; the result is
    clipped to [low, high]; moves below ``band`` (at it too, if ``inclusive``) are not made; larger
    ones are cut to ``step_up`` / ``step_down``, and the weight then to [0, cap] of the ledger. A
    null wanted weight holds.
    """

    brake: Callable[[float], float] = no_brake
    band: float = 0.05
    inclusive: bool = False
    low: float = 0.0
    high: float = np.inf
    step_up: float = np.inf
    step_down: float = np.inf
    gates: int = 0  # so many other gates, summed in a column, are averaged with the brake


def linear_brake(start: float, full: float, k: float = 1.0, least: float = 0.0) -> Callable[[float], float]:
    """1 up to ``start``, falling by k over the way to ``full``, never below ``least``."""

    def brake(dd: float) -> float:
        if dd <= start:
            return 1.0
        return max(least, 1.0 - k * min(1.0, (dd - start) / max(full - start, 1e-8)))

    return brake


def fold_ledger(df: DataFrame, keys: Keys, order: str, r: str, wanted: str, rule: Rule, rf: str | None = None, bps: float = 5.0, capital: float = 1.0, cap: float = 1.5, schedule: str | None = None, gates: str | None = None) -> DataFrame:
    """keys, order, weight, turnover, cost, ret, ret_no_rf, equity, equity_no_rf.

    The weight of a row earns the next row's return, less the cost of its own move; the rest of the
    capital earns ``rf``. The last row holds the weight before it. Windows make ``wanted`` before the
    fold, which keeps two numbers of state beside the weight. ``gates`` names the column of a rule's
    other gates. Rows of one date are taken in no set order, so a key's dates must differ.
    """
    names = [c for c in [*keys, order] if c]
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", weight double, turnover double, cost double, ret double, ret_no_rf double, equity double, equity_no_rf double"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x, base = pdf[r].to_numpy(float), pdf[wanted].to_numpy(float)
        f = pdf[rf].fillna(0.0).to_numpy(float) if rf else np.zeros(len(x))
        moves = pdf[schedule].to_numpy(bool) if schedule else np.ones(len(x), bool)
        other = pdf[gates].to_numpy(float) if gates else np.zeros(len(x))
        n = len(x)
        w, cost, ret, bare = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        held, equity, peak = 0.0, capital, capital
        for i in range(n - 1):
            peak = max(peak, equity)
            if moves[i] and not np.isnan(base[i]):
                factor = rule.brake(1.0 - equity / peak)
                if gates:
                    factor = (other[i] + factor) / (rule.gates + 1)
                target = min(max(base[i] * factor, rule.low), rule.high)
                move = target - held
                if abs(move) > rule.band or (abs(move) == rule.band and not rule.inclusive):
                    held = min(max(held + min(max(move, -rule.step_down), rule.step_up), 0.0), cap)
            w[i] = held
            cost[i] = abs(held - (w[i - 1] if i else 0.0)) * bps / 1e4
            bare[i + 1] = held * x[i + 1] - cost[i]
            ret[i + 1] = bare[i + 1] + (1.0 - held) * f[i + 1]
            equity *= np.exp(ret[i + 1])
        if n:
            w[-1] = held
        out = pdf[names].copy()
        out["weight"], out["turnover"], out["cost"] = w, np.abs(np.diff(w, prepend=0.0)), cost
        out["ret"], out["ret_no_rf"] = ret, bare
        out["equity"], out["equity_no_rf"] = capital * np.exp(np.cumsum(ret)), capital * np.exp(np.cumsum(bare))
        return out

    return df.groupBy(*keys).applyInPandas(step, schema)


def fold_choice(df: DataFrame, keys: Keys, order: str, scores: str, step: Callable, schema: str) -> DataFrame:
    """Ordered selection per key: ``step(state, row) -> (state, output tuple)`` over rows in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state, rows = None, []
        for row in pdf.itertuples(index=False):
            state, out = step(state, row)
            rows.append(out)
        names = [c.split()[0].strip("`") for c in schema.split(", ")]
        return pd.DataFrame(rows, columns=names)

    return df.groupBy(*keys).applyInPandas(run, schema)
