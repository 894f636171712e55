"""Forecasts and position rules that users add by name, run as one table of pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import Rule, fold_ledger

Keys = Sequence[str]
#: Name -> function of (return column, keys, order) to a vol, a window expression or a pandas UDF's column.
FORECASTS: dict[str, Callable[[Column, Keys, str], Column]] = {}
#: Name -> (function of the vol column to a wanted weight, how it becomes a held one).
POSITIONS: dict[str, tuple[Callable[[Column], Column], Rule]] = {}


def register_forecast(name: str, fn: Callable[[Column, Keys, str], Column]) -> None:
    FORECASTS[name] = fn


def register_position(name: str, wanted: Callable[[Column], Column], rule: Rule | None = None) -> None:
    POSITIONS[name] = (wanted, rule or Rule())


def run_registered(df: DataFrame, keys: Keys, order: str, r: str, forecasts: Sequence[str] | None = None, positions: Sequence[str] | None = None) -> DataFrame:
    """keys, pair, order and the ledger's columns, for every forecast with every position rule.

    Forecasts are made once and turned into rows; a rule is one fold over all series and forecasts."""
    names = list(FORECASTS if forecasts is None else forecasts)
    vols = df.select(*keys, order, r, *[FORECASTS[n](F.col(r), keys, order).alias(f"__v{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("__e"), F.col(f"__v{i}").alias("__vol")) for i, n in enumerate(names)])
    long = vols.select(*keys, order, r, F.inline(rows))
    out = None
    for name in POSITIONS if positions is None else positions:
        wanted, rule = POSITIONS[name]
        part = long.select(*keys, order, r, F.concat("__e", F.lit(f"__{name}")).alias("pair"), wanted(F.col("__vol")).alias("__wanted"))
        part = fold_ledger(part, [*keys, "pair"], order, r, "__wanted", rule)
        out = part if out is None else out.unionByName(part)
    return out
