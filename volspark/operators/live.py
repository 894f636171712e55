"""Live walk-forward: forecasts and positions of registered pairs are made inside every split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip
from ..functions.frames import along, roll, std
from ..sources.series import settled
from . import metrics as M
from .fold import fold_ledger
from .protocol import champion_score, splits, train_metrics
from .registered import FORECASTS, POSITIONS
from .windows import equity_curve

Keys = Sequence[str]


def live_ledgers(df: DataFrame, keys: Keys, order: str, r: str, forecasts: Sequence[str], positions: Sequence[str], train: int = 504, test: int = 126, step: int = 126, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """keys, split, role, pair, order, r, vol, bias, weight, ret, equity of every pair in every (overlapping) split.

    A forecast reads the rows before its date, of the split or before it. Its ``bias`` is fitted on the split's
    train rows: realised over forecast vol, in [low, high]; train and test both run on vol = bias * forecast.
    Positions start from nothing at the split's first train row and again at its first test row, so no state of
    one window reaches another. Rows where a forecast is missing are in no split.
    """
    vols = df.select(*keys, order, r, *[FORECASTS[n](F.col(r), keys, order).alias(f"__v{i}") for i, n in enumerate(forecasts)])
    vols = vols.where(F.expr(" AND ".join(f"__v{i} > 0" for i in range(len(forecasts)))))
    rows = splits(vols, keys, order, train, test, step)
    made = F.array(*[F.struct(F.lit(n).alias("__e"), F.col(f"__v{i}").alias("vol")) for i, n in enumerate(forecasts)])
    rows = rows.select(*keys, "split", "role", order, r, F.inline(made))
    own = Window.partitionBy(*keys, "split", "__e")
    old = lambda c: F.avg(F.when(F.col("role") == "train", c * c)).over(own)
    rows = rows.withColumn("bias", clip(F.sqrt(252.0 * old(F.col(r)) / old(F.col("vol"))), low, high))
    rows = rows.withColumn("vol", F.col("vol") * F.col("bias"))
    by, out = [*keys, "split", "role", "pair"], None
    for name in positions:
        wanted, rule = POSITIONS[name]
        part = rows.withColumns({"pair": F.concat("__e", F.lit(f"__{name}")), "__wanted": wanted(F.col("vol"))})
        part = fold_ledger(part, by, order, r, "__wanted", rule).select(*by, order, "weight", "ret", "equity").join(part.select(*by, order, r, "vol", "bias"), [*by, order])
        out = part if out is None else out.unionByName(part)
    return out


def live_champions(ledgers: DataFrame, keys: Keys, order: str, r: str, target: float) -> DataFrame:
    """keys, split, pair, value, champion: every pair's score on its train rows, and which is best (ties to the name)."""
    table = train_metrics(ledgers.where("role = 'train'"), [*keys, "split", "pair"], order, "ret", "vol", "weight", r, target)
    scored = table.select(*keys, "split", "pair", F.round(champion_score(), 9).alias("value"))
    first = F.row_number().over(Window.partitionBy(*keys, "split").orderBy(F.col("value").desc(), "pair"))
    return scored.withColumn("champion", first == 1)


def live_walk_forward(df: DataFrame, keys: Keys, order: str, r: str, forecasts: Sequence[str], positions: Sequence[str], target: float = 0.10, train: int = 504, test: int = 126, step: int = 126) -> tuple[DataFrame, DataFrame]:
    """(scores of all pairs per split, the champion's rows in each split's test): what ``live_ledgers`` makes, and
    ``live_champions`` chooses, before the test begins."""
    ledgers = settled(live_ledgers(df, keys, order, r, forecasts, positions, train, test, step), "live-ledgers")
    scored = live_champions(ledgers, keys, order, r, target)
    on = [*keys, "split", "pair"]
    return scored, ledgers.where("role = 'test'").join(scored.where("champion").select(*on), on)


def oos_detail(rows: DataFrame, keys: Keys, order: str, ret: str = "ret", hold: str = "r", switched: str | None = None, n: int = 21, ann: float = 252.0) -> DataFrame:
    """Per key: n, sharpe, calmar, cvar_95, drawdown of the routed returns, the same (bh_) of buy and hold, the excess
    Sharpe, Sharpe on rows whose trailing vol of ``hold`` is at or above the key's median and on all others,
    the mean size of returns more than 5 % under the peak and, given ``switched``, switches and their rate.

    CVaR is 0 with fewer than 10 rows, Calmar where nothing is lost, as in the protocol's own tables. Both return
    series are rows of one table: equity, quantile and sums are made in one pass for both.
    """
    vol = std(F.col(hold), roll(along(keys, order), n), n)
    base = rows.select(*keys, order, F.col(ret).alias("__r"), F.col(hold).alias("__h"), vol.alias("__v"), (F.col(switched).cast("int") if switched else F.lit(0)).alias("__s"))
    mid = F.percentile("__v", 0.5).over(Window.partitionBy(*keys))
    base = base.withColumn("__high", F.coalesce(F.col("__v") >= mid, F.lit(False)))
    both = F.array(F.struct(F.lit("").alias("__of"), F.col("__r").alias("__x")), F.struct(F.lit("bh_").alias("__of"), F.col("__h").alias("__x")))
    long = equity_curve(base.select(*keys, order, "__high", "__s", F.inline(both)), [*keys, "__of"], order, "__x")
    cut = long.groupBy(*keys, "__of").agg(F.percentile("__x", 0.05).alias("__q"))
    x = F.col("__x")
    per = long.join(cut, [*keys, "__of"]).groupBy(*keys, "__of").agg(
        F.count("*").alias("n"), M.sharpe(x, ann).alias("sharpe"), (F.avg(x) * ann).alias("__mean"), (-F.min("drawdown")).alias("drawdown"),
        F.when(F.count("*") >= 10, -F.avg(F.when(x <= F.col("__q"), x))).otherwise(0.0).alias("cvar_95"), M.sharpe(F.when(F.col("__high"), x), ann).alias("sharpe_high_vol"),
        M.sharpe(F.when(~F.col("__high"), x), ann).alias("sharpe_low_vol"), F.avg(F.when(F.col("drawdown") < -0.05, F.abs(x))).alias("size_in_drawdown"), F.sum("__s").alias("switches"),
    )
    per = per.withColumn("calmar", F.when(F.col("drawdown") > 0, F.col("__mean") / F.col("drawdown")).otherwise(0.0))
    of = lambda c, bh=False: F.max(F.when(F.col("__of") == ("bh_" if bh else ""), F.col(c)))
    cols = [of("n").alias("n")] + [of(c, bh).alias(f"bh_{c}" if bh else c) for bh in (False, True) for c in ("sharpe", "calmar", "cvar_95", "drawdown")]
    cols += [of(c).alias(c) for c in ("sharpe_high_vol", "sharpe_low_vol", "size_in_drawdown")]
    cols += [of("switches").alias("switches"), (of("switches") / of("n")).alias("switch_rate")] if switched else []
    return per.groupBy(*keys).agg(*cols).withColumn("excess_sharpe", F.col("sharpe") - F.col("bh_sharpe"))
