"""Queries of the window and metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import along, roll, std
from ..operators import metrics as M
from ..operators import windows as W
from ..sources import views as V
from .registry import LEDGER, PX, R, RET, query, rounded, rsql

K = ["asset"]
P = ["asset", "pair"]


@query("w1_returns", rsql(PX + """, q AS (SELECT asset, d, close / LAG(close) OVER w - 1 AS simple_return, LN(close / LAG(close) OVER w) AS log_return
FROM px WINDOW w AS (PARTITION BY asset ORDER BY d))""", "simple_return", "log_return", keys="asset, d"))  # fmt: skip
def w1(s, d):
    return rounded(W.with_returns(V.px(s, d), K, "d", "close").select("asset", "d", "simple_return", "log_return"))


@query("w2_rolling_stats", rsql(R + """, q AS (SELECT asset, d, CASE WHEN n >= 15 THEN AVG(r) OVER w END AS mean_21, CASE WHEN n >= 15 THEN SUM(r) OVER w END AS sum_21,
CASE WHEN n >= 15 THEN STDDEV_SAMP(r) OVER w END AS std_21, CASE WHEN n >= 15 THEN MIN(r) OVER w END AS min_21, CASE WHEN n >= 15 THEN MAX(r) OVER w END AS max_21
FROM (SELECT *, COUNT(r) OVER (PARTITION BY asset ORDER BY d ROWS 20 PRECEDING) AS n FROM rr) WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 20 PRECEDING))""",
    "mean_21", "sum_21", "std_21", "min_21", "max_21", keys="asset, d"))
def w2(s, d):
    out = W.rolling(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 21, 15)
    return rounded(out.select("asset", "d", "mean_21", "sum_21", "std_21", "min_21", "max_21"))


@query("w3_lag_features", rsql(R + """, q AS (SELECT asset, d, LAG(r) OVER w AS lag_1, LAG(r, 5) OVER w AS lag_5, r - LAG(r) OVER w AS diff_1,
r - 2 * LAG(r) OVER w + LAG(r, 2) OVER w AS diff_2, LEAD(r) OVER w AS lead_1 FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d))""",
    "lag_1", "lag_5", "diff_1", "diff_2", "lead_1", keys="asset, d"))
def w3(s, d):
    out = W.lag_features(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", (1, 5))
    return rounded(out.select("asset", "d", "lag_1", "lag_5", "diff_1", "diff_2", "lead_1"))


@query("w4_expanding_mean", rsql(R + """, q AS (SELECT asset, d, AVG(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expanding_mean FROM rr)""",
    "expanding_mean", keys="asset, d"))
def w4(s, d):
    return rounded(W.expanding_mean(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r").select("asset", "d", "expanding_mean"))


EQ = """, e AS (SELECT asset, d, EXP(SUM(r) OVER w) AS equity FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING)),
q AS (SELECT asset, d, equity, MAX(equity) OVER w AS peak, equity / MAX(equity) OVER w - 1 AS drawdown FROM e WINDOW w AS (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING))"""


@query("w5_equity_drawdown", rsql(R + EQ, "equity", "peak", "drawdown", keys="asset, d"))
def w5(s, d):
    return rounded(W.equity_curve(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r").select("asset", "d", "equity", "peak", "drawdown"))


@query("w6_ewma", f"""WITH RECURSIVE {R}, f AS (SELECT asset, d, rn, r AS ewma FROM rr WHERE rn = 1 UNION ALL
SELECT b.asset, b.d, b.rn, (1 - POWER(0.5, 1 / 20.0)) * b.r + POWER(0.5, 1 / 20.0) * f.ewma FROM f JOIN rr b ON b.asset = f.asset AND b.rn = f.rn + 1)
SELECT asset, d, ROUND(ewma, 8) + 0.0 AS ewma FROM f""")
def w6(s, d):
    return rounded(W.ewma(V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r"), K, "d", "r", halflife=20).select("asset", "d", "ewma"))


@query("w7_rolling_rank", rsql(R + """, l AS (SELECT asset, d, r, LIST(r) OVER (PARTITION BY asset ORDER BY d ROWS 62 PRECEDING) AS a FROM rr),
q AS (SELECT asset, d, CASE WHEN LEN(a) >= 63 THEN (LEN(LIST_FILTER(a, lambda x: x < r)) + (LEN(LIST_FILTER(a, lambda x: x = r)) + 1) / 2) / 63 END AS pct_rank FROM l)""",
    "pct_rank", keys="asset, d"))
def w7(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL")
    return rounded(rows.select("asset", "d", W.rolling_rank(F.col("r"), K, "d", 63).alias("pct_rank")))


@query("w8_cross_rank", rsql(R + """, m AS (SELECT asset, d, SUM(r) OVER (PARTITION BY asset ORDER BY d ROWS 20 PRECEDING) AS mom FROM rr),
q AS (SELECT asset, d, (RANK() OVER (PARTITION BY d ORDER BY mom) + (COUNT(*) OVER (PARTITION BY d, mom) - 1) / 2) / COUNT(*) OVER (PARTITION BY d) AS pct_rank FROM m)""",
    "pct_rank", keys="asset, d"))
def w8(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL")
    rows = rows.select("asset", "d", F.sum("r").over(roll(along(K, "d"), 21)).alias("mom"))
    return rounded(rows.select("asset", "d", W.cross_rank(F.col("mom"), ["d"], "mom").alias("pct_rank")))


MARKET = """, mk AS (SELECT asset, d, rn, COUNT(r) OVER f AS n, STDDEV_SAMP(r) OVER f AS sd, AVG(r) OVER f AS m, SKEWNESS(r) OVER f AS sk,
ABS(QUANTILE_CONT(r, 0.8) OVER f) AS hi, ABS(QUANTILE_CONT(r, 0.2) OVER f) AS lo, ABS(LAG(r) OVER (PARTITION BY asset ORDER BY d)) AS lst FROM rr
WINDOW f AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
market AS (SELECT asset, d, CASE WHEN n >= 63 THEN sd END AS market_vol, CASE WHEN n >= 63 THEN m END AS market_mean, CASE WHEN n >= 63 THEN sk END AS market_skew,
CASE WHEN n < 63 THEN NULL WHEN lst >= hi THEN 'high' WHEN lst <= lo THEN 'low' ELSE 'middle' END AS market_regime FROM mk)"""


@query("w9_market_label", rsql(R + MARKET + ", q AS (SELECT * FROM market)", "market_vol", "market_mean", "market_skew", digits=6, keys="asset, d, market_regime"))
def w9(s, d):
    out = W.market_label(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 63)
    return rounded(out.select("asset", "d", "market_regime", "market_vol", "market_mean", "market_skew"), 6)


@query("w10_next_vol_proxy", rsql(R + """, n AS (SELECT asset, d, POWER(LEAD(r) OVER (PARTITION BY asset ORDER BY d), 2) AS s FROM rr),
q AS (SELECT asset, d, CASE WHEN COUNT(s) OVER w >= 21 THEN SQRT(SUM(s) OVER w * 252 / 21) END AS rv_next FROM n WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 20 PRECEDING))""",
    "rv_next", keys="asset, d"))
def w10(s, d):
    return rounded(W.next_vol_proxy(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r").select("asset", "d", "rv_next"))


@query("w11_back_adjust", rsql(PX + """, c AS (SELECT *, YEAR(d) || '-' || QUARTER(d) AS contract FROM px),
g AS (SELECT *, LEAD(contract) OVER w AS nc, LEAD(close) OVER w - close AS gap FROM c WINDOW w AS (PARTITION BY asset ORDER BY d)),
h AS (SELECT *, nc IS NULL OR nc <> contract AS is_roll_day, CASE WHEN nc IS NULL OR nc <> contract THEN COALESCE(gap, 0) ELSE 0 END AS g FROM g),
q AS (SELECT asset, d, is_roll_day, close + COALESCE(SUM(g) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS close_adj FROM h)""",
    "close_adj", digits=6, keys="asset, d, is_roll_day"))
def w11(s, d):
    rows = V.px(s, d).withColumn("contract", F.concat(F.year("d"), F.lit("-"), F.quarter("d")))
    return rounded(W.back_adjust(rows, K, "d", "close", "contract").select("asset", "d", "is_roll_day", "close_adj"), 6)


@query("w12_series_summary", rsql(RET + """, b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d DESC) AS n FROM px),
q AS (SELECT asset, MAX(close) FILTER (n = 1) AS latest, AVG(close) FILTER (n <= 20) AS mean_20, MAX(close) FILTER (n = 1) - arg_max(close, n) FILTER (n <= 20) AS change_20,
MIN(close) FILTER (n <= 20) AS min_20, MAX(close) FILTER (n <= 20) AS max_20, AVG(close) FILTER (n <= 126) AS mean_126,
MAX(close) FILTER (n = 1) - arg_max(close, n) FILTER (n <= 126) AS change_126 FROM b GROUP BY 1)""",
    "latest", "mean_20", "change_20", "min_20", "max_20", "mean_126", "change_126", digits=6, keys="asset"))
def w12(s, d):
    out = W.series_summary(V.px(s, d), K, "d", "close")
    return rounded(out.select("asset", "latest", "mean_20", "change_20", "min_20", "max_20", "mean_126", "change_126"), 6)


@query("w13_equity_snapshot", rsql(R + EQ.replace("q AS", "e2 AS") + """, i AS (SELECT *, row_number() OVER w - 1 AS i, COUNT(*) OVER (PARTITION BY asset) AS n, FIRST(equity) OVER w AS e0 FROM e2
WINDOW w AS (PARTITION BY asset ORDER BY d)), q AS (SELECT asset, d, equity, equity / e0 - 1 AS return_from_start FROM i
WHERE list_contains(list_transform(range(LEAST(12, n)), lambda j: CAST(ROUND_EVEN(j * (n - 1) / GREATEST(LEAST(12, n) - 1, 1), 0) AS INT)), i))""",
    "equity", "return_from_start", keys="asset, d"))
def w13(s, d):
    rows = W.equity_curve(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r")
    return rounded(W.equity_snapshot(rows, K, "d", "equity"))


HOLD = """, lab AS (SELECT asset, d, rn, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS pick FROM rr)"""


@query("w14_hold_days", f"""WITH {R}{HOLD}, s AS (SELECT *, COALESCE(LAG(pick) OVER w <> pick, FALSE) AS switched FROM lab WINDOW w AS (PARTITION BY asset ORDER BY d)),
t AS (SELECT *, MAX(CASE WHEN switched OR rn = 1 THEN rn END) OVER w AS i, MAX(CASE WHEN switched OR rn = 1 THEN d END) OVER w AS sd FROM s WINDOW w AS (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING))
SELECT asset, d, switched, CAST(rn - i AS INT) AS hold_rows, CAST(d - sd AS INT) AS days_since_switch FROM t""")
def w14(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", F.when(F.col("r") > 0, "up").otherwise("down").alias("pick"))
    return W.hold_days(rows, K, "d", "pick").select("asset", "d", "switched", F.col("hold_rows").cast("int"), "days_since_switch")


@query("w15_rank_history", rsql(LEDGER + """, m AS (SELECT pair, asset, CAST(DATE_TRUNC('month', d) AS DATE) AS mth, SUM(ret) AS ret FROM ledger GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY asset, mth ORDER BY ROUND(ret, 12) DESC, pair) AS rk FROM m),
q AS (SELECT asset, pair, mth, AVG(CASE WHEN rk <= 3 THEN 1.0 ELSE 0.0 END) OVER w AS top_hits, AVG(rk) OVER w AS mean_rank FROM k
WINDOW w AS (PARTITION BY asset, pair ORDER BY mth ROWS 5 PRECEDING))""", "top_hits", "mean_rank", keys="asset, pair, mth"))  # fmt: skip
def w15(s, d):
    from pyspark.sql import Window

    m = V.ledger(s, d).groupBy("pair", "asset", F.to_date(F.date_trunc("month", "d")).alias("mth")).agg(F.sum("ret").alias("ret"))
    # Returns are rounded before they rank, so that sums made in another order tie alike.
    rk = F.row_number().over(Window.partitionBy("asset", "mth").orderBy(F.desc(F.round("ret", 12)), "pair"))
    return rounded(W.rank_history(m.withColumn("rk", rk), P, "mth", "rk").select("asset", "pair", "mth", "top_hits", "mean_rank"))


PERF_COLS = ("total_return", "ann_return", "ann_vol", "sharpe", "sortino", "max_drawdown", "ulcer", "var_95", "cvar_95", "win_rate", "win_loss", "turnover", "calmar")
PERF = """, eq AS (SELECT *, equity / MAX(equity) OVER w - 1 AS dd, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw,
QUANTILE_CONT(ret, 0.05) OVER (PARTITION BY asset, pair) AS q05 FROM ledger WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING)),
pf AS (SELECT asset, pair, COUNT(*) AS n, EXP(SUM(ret)) - 1 AS total_return, AVG(ret) * 252 AS ann_return, STDDEV_SAMP(ret) * SQRT(252) AS ann_vol,
CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS sharpe,
AVG(ret) / STDDEV_POP(CASE WHEN ret < 0 THEN ret END) * SQRT(252) AS sortino, -MIN(dd) AS max_drawdown, SQRT(AVG(dd * dd)) AS ulcer, -FIRST(q05) AS var_95,
-AVG(CASE WHEN ret <= q05 THEN ret END) AS cvar_95, AVG(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win_rate,
AVG(CASE WHEN ret > 0 THEN ret END) / -AVG(CASE WHEN ret < 0 THEN ret END) AS win_loss, COUNT(*) FILTER (dd < -0.05) AS stress_days, AVG(dw) AS turnover FROM eq GROUP BY 1, 2),
perf AS (SELECT *, CASE WHEN max_drawdown > 1e-12 THEN ann_return / max_drawdown END AS calmar FROM pf)"""


@query("a2_a11_strategy_features", rsql(LEDGER + PERF + ", q AS (SELECT * FROM perf)", *PERF_COLS, digits=6, keys="asset, pair, n, stress_days"))
def a11(s, d):
    return rounded(M.performance(V.ledger(s, d), P, "d", "ret", "weight").select("asset", "pair", "n", "stress_days", *PERF_COLS), 6)


@query("a1_resample_last", f"WITH {PX} SELECT asset, CAST(DATE_TRUNC('month', d) AS DATE) AS mth, ROUND(arg_max(close, d), 6) AS close, ROUND(arg_max(volume, d), 6) AS volume FROM px GROUP BY 1, 2")
def a1(s, d):
    from ..operators.clean import resample_last

    return rounded(resample_last(V.px(s, d), K, "d", "month", ["close", "volume"]).withColumnRenamed("bucket", "mth"), 6)


@query("a4_annual_returns", rsql(LEDGER + ", q AS (SELECT asset, pair, AVG(ret) * 252 AS arithmetic, EXP(SUM(LN(1 + ret)) * 252 / COUNT(ret)) - 1 AS geometric FROM ledger GROUP BY 1, 2)",
    "arithmetic", "geometric", keys="asset, pair"))
def a4(s, d):
    r = F.col("ret")
    return rounded(V.ledger(s, d).groupBy(*P).agg(M.ann_return(r).alias("arithmetic"), M.ann_return(r, kind="geometric").alias("geometric")))


@query("a5_drawdown_variants", rsql(LEDGER + """, e AS (SELECT asset, pair, d, EXP(SUM(ret) OVER w) AS le, EXP(SUM(LN(1 + ret)) OVER w) AS se FROM ledger WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING)),
x AS (SELECT asset, pair, le / MAX(le) OVER w - 1 AS a, se / MAX(se) OVER w - 1 AS b FROM e WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING)),
q AS (SELECT asset, pair, -MIN(a) AS log_drawdown, -MIN(b) AS simple_drawdown FROM x GROUP BY 1, 2)""", "log_drawdown", "simple_drawdown", keys="asset, pair"))  # fmt: skip
def a5(s, d):
    led = V.ledger(s, d)
    a = M.max_drawdown(led, P, "d", "ret").withColumnRenamed("max_drawdown", "log_drawdown")
    return rounded(a.join(M.max_drawdown(led, P, "d", "ret", log=False).withColumnRenamed("max_drawdown", "simple_drawdown"), P))


@query("a6_cvar", rsql(LEDGER + """, c AS (SELECT *, QUANTILE_CONT(ret, 0.05) OVER (PARTITION BY asset, pair) AS c FROM ledger),
q AS (SELECT asset, pair, -FIRST(c) AS var, -AVG(CASE WHEN ret <= c THEN ret END) AS cvar FROM c GROUP BY 1, 2)""", "var", "cvar", keys="asset, pair"))  # fmt: skip
def a6(s, d):
    return rounded(M.cvar(V.ledger(s, d), P, "ret", least=10))


@query("a9_vol_control", rsql(LEDGER + """, v AS (SELECT asset, pair, CASE WHEN COUNT(ret) OVER w >= 21 THEN STDDEV_SAMP(ret) OVER w * SQRT(252) END AS v FROM ledger WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS 20 PRECEDING)),
q AS (SELECT asset, pair, AVG(v) AS mean_vol, STDDEV_POP(v) / AVG(v) AS vol_cv, ABS(AVG(v) - 0.1) AS vol_deviation FROM v GROUP BY 1, 2)""", "mean_vol", "vol_cv", "vol_deviation", digits=6, keys="asset, pair"))  # fmt: skip
def a9(s, d):
    return rounded(M.vol_control(V.ledger(s, d), P, "d", "ret", 0.1), 6)


@query("a12_active_metrics", rsql(LEDGER + """, a AS (SELECT *, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM ledger),
z AS (SELECT asset, pair, d, ret, dw, EXP(SUM(ret) OVER w) AS e FROM a WHERE ret <> 0 WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM z),
q AS (SELECT asset, pair, STDDEV_SAMP(ret) * SQRT(252) AS vol, EXP(SUM(ret)) - 1 AS total_return, EXP(SUM(ret) * 252 / COUNT(ret)) - 1 AS cagr,
AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) AS sharpe, -MIN(dd) AS max_drawdown, SQRT(AVG(dd * dd)) AS ulcer, AVG(dw) AS turnover, ABS(STDDEV_SAMP(ret) * SQRT(252) - 0.1) AS vol_gap FROM y GROUP BY 1, 2)""",
    "vol", "total_return", "cagr", "sharpe", "max_drawdown", "ulcer", "turnover", "vol_gap", digits=6, keys="asset, pair"))
def a12(s, d):
    return rounded(M.active_metrics(V.ledger(s, d), P, "d", "ret", "weight", 0.1), 6)


@query("a13_comparison_long", f"""WITH {LEDGER}{PERF}, u AS (UNPIVOT (SELECT asset, pair, ann_return, ann_vol, sharpe FROM perf) ON ann_return, ann_vol, sharpe INTO NAME metric VALUE value)
SELECT asset, pair, metric, ROUND(value, 6) + 0.0 AS value FROM u""")
def a13(s, d):
    table = M.performance(V.ledger(s, d), P, "d", "ret").select("asset", "pair", "ann_return", "ann_vol", "sharpe")
    return rounded(M.long_metrics(table, P), 6)


WM = """, wd AS (SELECT *, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM ledger),
wl AS (SELECT asset, pair, d, COUNT(ret) OVER f AS obs, EXP(SUM(ret) OVER f20) - 1 AS ret_20, EXP(SUM(ret) OVER f40) - 1 AS ret_40, AVG(ret) OVER f AS m, STDDEV_SAMP(ret) OVER f AS sd,
QUANTILE_CONT(ret, 0.05) OVER f AS q05, LIST(ret) OVER f AS a, AVG(dw) OVER f AS turnover_n FROM wd WINDOW f AS (PARTITION BY asset, pair ORDER BY d ROWS 62 PRECEDING),
f20 AS (PARTITION BY asset, pair ORDER BY d ROWS 19 PRECEDING), f40 AS (PARTITION BY asset, pair ORDER BY d ROWS 39 PRECEDING)),
wm AS (SELECT asset, pair, d, obs, ret_20, ret_40, CASE WHEN obs >= 2 AND sd > 0 THEN m / sd * SQRT(252) ELSE 0 END AS sharpe, turnover_n, ABS(sd * SQRT(252) - 0.1) AS vol_error,
-list_avg(list_filter(a, lambda x: x <= q05)) AS cvar_n FROM wl)"""


@query("a14_window_metrics", rsql(LEDGER + WM + ", q AS (SELECT * FROM wm)", "ret_20", "ret_40", "sharpe", "turnover_n", "vol_error", "cvar_n", digits=6, keys="asset, pair, d, obs"))
def a14(s, d):
    out = M.window_metrics(V.ledger(s, d), P, "d", "ret", "weight", 0.1, 63)
    return rounded(out.select("asset", "pair", "d", "obs", "ret_20", "ret_40", "sharpe", "turnover_n", "vol_error", "cvar_n"), 6)


@query("a19_regime_blocks", rsql(LEDGER + MARKET + """, lm AS (SELECT l.asset, l.pair, l.d, l.ret, m.market_regime AS regime FROM ledger l JOIN market m ON l.asset = m.asset AND l.d = m.d WHERE m.market_regime IS NOT NULL),
b AS (SELECT *, CASE WHEN LAG(regime) OVER w IS NULL OR LAG(regime) OVER w <> regime THEN 1 ELSE 0 END AS nw FROM lm WINDOW w AS (PARTITION BY asset, pair ORDER BY d)),
c AS (SELECT *, SUM(nw) OVER (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING) AS block FROM b),
e AS (SELECT *, EXP(SUM(ret) OVER (PARTITION BY asset, pair, block ORDER BY d ROWS UNBOUNDED PRECEDING)) AS e FROM c),
f AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair, block ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
g AS (SELECT asset, pair, regime, block, MIN(dd) AS dd, COUNT(*) AS k FROM f GROUP BY 1, 2, 3, 4),
h AS (SELECT asset, pair, regime, MIN(dd) AS worst_drawdown FROM g WHERE k >= 3 GROUP BY 1, 2, 3),
q AS (SELECT asset, pair, regime, n, ann_return, sharpe, worst_drawdown FROM (SELECT asset, pair, regime, COUNT(*) AS n, AVG(ret) * 252 AS ann_return,
CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS sharpe FROM lm GROUP BY 1, 2, 3) LEFT JOIN h USING (asset, pair, regime))""",
    "ann_return", "sharpe", "worst_drawdown", digits=6, keys="asset, pair, regime, n"))
def a19(s, d):
    m = W.market_label(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 63).select("asset", "d", F.col("market_regime").alias("regime")).where("regime IS NOT NULL")
    out = M.worst_block_drawdown(V.ledger(s, d).join(m, ["asset", "d"]), P, "d", "regime", "ret", 3)
    return rounded(out.select("asset", "pair", "regime", "n", "ann_return", "sharpe", "worst_drawdown"), 6)


@query("a20_a21_regime_stats", rsql(R + MARKET + """, lm AS (SELECT rr.asset, rr.d, rr.r, m.market_regime AS regime FROM rr JOIN market m ON rr.asset = m.asset AND rr.d = m.d WHERE m.market_regime IS NOT NULL),
b AS (SELECT *, CASE WHEN LAG(regime) OVER w IS NULL OR LAG(regime) OVER w <> regime THEN 1 ELSE 0 END AS nw FROM lm WINDOW w AS (PARTITION BY asset ORDER BY d)),
q AS (SELECT asset, regime, COUNT(*) AS days, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY asset) AS share, AVG(r) * 252 AS ann_return, STDDEV_SAMP(r) * SQRT(252) AS ann_vol,
AVG(r) / STDDEV_SAMP(r) * SQRT(252) AS sharpe, CAST(SUM(nw) AS BIGINT) AS blocks, COUNT(*) / SUM(nw) AS mean_block FROM b GROUP BY 1, 2)""",
    "share", "ann_return", "ann_vol", "sharpe", "mean_block", digits=6, keys="asset, regime, days, blocks"))
def a20(s, d):
    m = W.market_label(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 63).withColumnRenamed("market_regime", "regime")
    return rounded(M.regime_stats(m, K, "d", "regime", "r"), 6)


@query("a23_dispersion", rsql(LEDGER + WM + """, q AS (SELECT asset, d, QUANTILE_CONT(sharpe, 0.25) AS sharpe_p25, QUANTILE_CONT(sharpe, 0.5) AS sharpe_median, QUANTILE_CONT(sharpe, 0.75) AS sharpe_p75 FROM wm GROUP BY 1, 2)""",
    "sharpe_p25", "sharpe_median", "sharpe_p75", digits=6, keys="asset, d"))
def a23(s, d):
    out = M.window_metrics(V.ledger(s, d), P, "d", "ret", "weight", 0.1, 63)
    return rounded(M.dispersion(out, ["asset", "d"], ["sharpe"]), 6)


@query("a27_calibration", rsql(LEDGER + """, x AS (SELECT asset, pair, vol AS f, ABS(r) * SQRT(252) AS y FROM ledger WHERE vol IS NOT NULL AND pair LIKE '%clip'),
e AS (SELECT asset, pair, QUANTILE_CONT(f, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM x GROUP BY 1, 2),
q AS (SELECT asset, pair, bin, COUNT(*) AS n, AVG(f) AS mean_forecast, AVG(y) AS mean_realized FROM (SELECT asset, pair, f, y, CAST(LEN(list_filter(e.e, lambda v: v < f)) + 1 AS INT) AS bin FROM x JOIN e USING (asset, pair)) GROUP BY 1, 2, 3)""",
    "mean_forecast", "mean_realized", keys="asset, pair, bin, n"))
def a27(s, d):
    rows = V.ledger(s, d).where("vol IS NOT NULL AND pair LIKE '%clip'").withColumn("y", F.abs("r") * F.sqrt(F.lit(252)))
    return rounded(M.calibration(rows, P, "vol", "y"))


@query("a29_equal_weight_proxy", rsql(R + ", q AS (SELECT d, AVG(r) AS r, COUNT(*) AS n FROM rr GROUP BY 1)", "r", keys="d, n"))
def a29(s, d):
    return rounded(V.returns(s, d).where("r IS NOT NULL").groupBy("d").agg(F.avg("r").alias("r"), F.count("*").alias("n")))
