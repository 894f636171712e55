"""Queries that write files to the shared folder and scan them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources import series as S
from ..sources import views as V
from .core import MARKET
from .registry import LEDGER, PX, query, rounded, rsql
from .routes import labels
from .streams import _shared


@query("s3_csv_import", rsql(PX + ", q AS (SELECT asset AS symbol, d AS date, close, volume FROM px WHERE DAY(d) <> 1)", "close", "volume", digits=6, keys="symbol, date"))
def s3(s, d):
    """Prices as CSV under other column names, the first of a month without a readable date."""
    path = f"{_shared(s)}/prices"
    when = F.when(F.dayofmonth("d") == 1, F.lit("n/a")).otherwise(F.col("d").cast("string"))
    S.write_table(V.px(s, d).select(when.alias("ts_event"), F.col("asset").alias("Ticker"), F.col("close").alias("adj_close"), F.col("volume").alias("Volume")), path, "csv")
    return rounded(S.read_csv_series(s, path).select("symbol", "date", "close", F.col("volume").cast("double").alias("volume")), 6)


@query("s7_s13_ledger_folder", rsql(LEDGER + ", q AS (SELECT asset, d, split_part(pair, '__', 1) AS estimator, split_part(pair, '__', 2) AS controller, ret, weight FROM ledger WHERE pair IN ('rv20__clip', 'rv60__clip'))", "ret", "weight", keys="asset, d, estimator, controller"))
def s7(s, d):
    """The ledger sink, a folder a pair, and a scan of two pairs that prunes the rest."""
    path = f"{_shared(s)}/ledger"
    S.write_ledger(V.ledger(s, d), path)
    return rounded(S.read_ledgers(s, path, ["rv20__clip", "rv60__clip"]).select("asset", "d", "estimator", "controller", "ret", "weight"))


@query("s9_ledger_aliases", rsql(LEDGER + ", q AS (SELECT asset, pair, d, CASE WHEN DAY(d) % 2 = 0 THEN ret ELSE ret + cost END AS returns, equity FROM ledger)", "returns", "equity", keys="asset, pair, d"))
def s9(s, d):
    """Ledgers whose returns lie in either of two columns, and whose equity has its long name."""
    even = F.dayofmonth("d") % 2 == 0
    raw = V.ledger(s, d).select("asset", "pair", "d", F.when(even, F.col("ret")).alias("returns_with_rf"), (F.col("ret") + F.col("cost")).alias("returns_no_rf"), F.col("equity").alias("equity_curve_with_rf"))
    return rounded(S.normalize_ledger(raw).select("asset", "pair", "d", "returns", "equity"))


@query("s10_suitability", f"""WITH {LEDGER}{MARKET}, g AS (SELECT l.pair, m.market_regime AS regime, ROUND(AVG(ret) / STDDEV_SAMP(ret) * SQRT(252), 6) AS x FROM ledger l JOIN market m ON m.asset = l.asset AND m.d = l.d WHERE m.market_regime IS NOT NULL GROUP BY 1, 2)
SELECT pair, regime, ROUND(x * 0.5, 6) + 0.0 AS score FROM g WHERE NOT (pair = 'naive20__clip' AND regime = 'low') AND NOT (pair = 'rv60__clip' AND regime = 'high')""")  # fmt: skip
def s10(s, d):
    """Suitability as CSV with several spellings of the regimes, an unknown one and an unreadable score."""
    t = V.ledger(s, d).join(labels(s, d), ["asset", "d"]).groupBy("pair", "regime").agg(F.round(M.sharpe(F.col("ret")), 6).cast("string").alias("x"))
    said = F.when((F.col("pair") == "naive20__clip") & (F.col("regime") == "low"), "flat").when(F.col("regime") == "low", " Calm").when(F.col("regime") == "middle", "mid").otherwise("STRESS ")
    bad = (F.col("pair") == "rv60__clip") & (F.col("regime") == "high")
    path = f"{_shared(s)}/suitability"
    S.write_table(t.select(F.concat(F.lit(" "), "pair").alias("pair"), said.alias("regime"), F.when(bad, "none").otherwise(F.col("x")).alias("suitability_score")), path, "csv")
    return rounded(S.suitability(s.read.csv(path, header=True), "pair", 0.5), 6)


@query("s11_regime_series", """WITH x AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'low' WHEN 'O' THEN 'high' WHEN 'P' THEN 'middle' END AS regime, o_orderpriority FROM orders)
SELECT date, arg_max(regime, o_orderkey) AS regime FROM x WHERE o_orderpriority <> '5-LOW' AND regime IS NOT NULL GROUP BY 1""")
def s11(s, d):
    """Recorded labels in uneven spelling, some of them invalid; the last record of a date counts."""
    o = V.table(s, d, "orders")
    said = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").when(F.col("o_orderstatus") == "F", " Low").when(F.col("o_orderstatus") == "O", "HIGH ").when(F.col("o_orderstatus") == "P", "Middle")
    rows = o.select(F.col("o_orderdate").alias("date"), said.alias("ai_vol_regime"), F.col("o_orderkey").alias("prediction_date"))
    return S.regime_series(rows, "ai_vol_regime", ["low", "middle", "high"])
