"""Queries of regime-block rankings, macro regimes, portfolio candidate scores and small merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.frames import along, roll, std
from ..operators import diagnostics as G
from ..operators import forecast as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import ranking as O
from ..operators import regimes as R_
from ..operators import routing as Q
from ..sources import views as V
from .core import MARKET, PERF, WM
from .models import EVAL, MODELS, models
from .more import FRAME_DD, metric_regimes
from .registry import LEDGER, R, VIX, query, rounded, rsql
from .routes import labels

K = ["asset"]
P = ["asset", "pair"]


@query("o4_regime_block_ranks", f"""WITH {LEDGER}{MARKET}, lr AS (SELECT l.*, ABS(weight - LAG(weight) OVER (PARTITION BY l.asset, l.pair ORDER BY l.d)) AS dw, m.market_regime AS regime FROM ledger l JOIN market m ON m.asset = l.asset AND m.d = l.d WHERE m.market_regime IS NOT NULL),
t AS (SELECT asset, d AS as_of FROM market WHERE market_regime IS NOT NULL AND DAY(d) = 1 AND MONTH(d) % 6 = 0),
x AS (SELECT t.as_of, lr.* FROM t JOIN lr ON lr.asset = t.asset AND lr.d >= t.as_of - INTERVAL 36 MONTH AND lr.d < t.as_of),
e AS (SELECT *, EXP(SUM(ret) OVER w) AS e, QUANTILE_CONT(ret, 0.05) OVER (PARTITION BY asset, as_of, regime, pair) AS c5 FROM x WINDOW w AS (PARTITION BY asset, as_of, regime, pair ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
dd AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, as_of, regime, pair ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e),
m AS (SELECT asset, as_of, regime, pair, COUNT(*) AS n, ROUND(CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END, 8) AS sharpe, ROUND(-MIN(dd), 8) AS drawdown, ROUND(AVG(dw), 8) AS turnover, ROUND(-AVG(CASE WHEN ret <= c5 THEN ret END), 8) AS cvar, ROUND(AVG(ret) * 252, 8) AS ret FROM dd GROUP BY 1, 2, 3, 4 HAVING COUNT(*) >= 20)
SELECT asset, as_of, regime, pair, n, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY asset, as_of, regime ORDER BY -FLOOR(sharpe / 0.05), drawdown, turnover, cvar, -ret, pair) AS k FROM m) WHERE k <= 4""")  # fmt: skip
def o4(s, d):
    led = V.ledger(s, d).withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(along(P, "d"))))
    lab = labels(s, d)
    # The change of weight is that of rows with a label, as the ranking sees no others.
    rows = led.drop("dw").join(lab, ["asset", "d"])
    rows = rows.withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(along(P, "d"))))
    when = lab.where("day(d) = 1 AND month(d) % 6 = 0").select("asset", F.col("d").alias("as_of"))
    past = J.trailing_rows(when, rows, K, "d", 36)
    return O.regime_block_ranks(past, ["asset", "as_of"], "d").where("rank <= 4").select("asset", "as_of", "regime", "pair", "n", "rank")


@query("o5_borrowed_regime_ranks", f"""WITH {LEDGER}{WM}, x AS (SELECT asset, pair, d, ROUND(m * 252, 8) AS ann, ROUND(sd * SQRT(252), 8) AS vol, ROUND(ABS(sd * SQRT(252) - 0.1), 8) AS ve, ROUND(CASE WHEN sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sh, ROUND({FRAME_DD}, 8) AS dd,
ROUND(turnover_n, 8) AS turnover, ROUND(-list_avg(list_filter(a, lambda x: x <= q05)), 8) AS cvar FROM wl WHERE obs >= 63 AND DAY(d) = 1),
g AS (SELECT *, CASE WHEN sh >= 0.85 AND ann >= 0.08 AND vol >= 0.075 AND vol <= 0.115 THEN 'risk_on' WHEN dd <= -0.07 OR ve >= 0.035 OR ann < 0.02 THEN 'defensive' WHEN sh >= 0.65 AND ann >= 0.05 AND ve <= 0.03 THEN 'risk_on' ELSE 'balanced' END AS regime FROM x),
a AS (SELECT asset, d, pair, regime, FALSE AS borrowed, sh, dd, turnover, cvar, ann FROM g UNION ALL SELECT g.asset, g.d, g.pair, r.regime, TRUE, sh, dd, turnover, cvar, ann FROM g, (VALUES ('risk_on'), ('balanced'), ('defensive')) AS r(regime)
WHERE NOT EXISTS (SELECT 1 FROM g AS h WHERE h.asset = g.asset AND h.d = g.d AND h.regime = r.regime))
SELECT asset, d, regime, pair, borrowed, CAST(row_number() OVER (PARTITION BY asset, d, regime ORDER BY -FLOOR(sh / 0.05), ABS(dd), turnover, cvar, -ann, pair) AS INT) AS rank FROM a""")  # fmt: skip
def o5(s, d):
    r8 = lambda c: F.round(c, 8)
    rows = metric_regimes(s, d).where("day(d) = 1").select(*P, "d", "regime", r8("sharpe").alias("sharpe"), F.abs(r8("drawdown_n")).alias("drawdown"), r8("turnover_n").alias("turnover"), r8("cvar_n").alias("cvar"), r8("ann").alias("ret"))
    rows = O.borrowed_regimes(rows, ["asset", "d"], "regime", ["risk_on", "balanced", "defensive"])
    return O.ranked(rows, ["asset", "d", "regime"], O.tie_band_order()).select("asset", "d", "regime", "pair", "borrowed", "rank")


@query("g12_profit_precision", rsql(LEDGER + PERF + ", " + MODELS + ", " + EVAL + ", q AS (SELECT p.asset, p.pair, p.sharpe, e.qlike FROM perf p JOIN eval e ON e.asset = p.asset AND e.model = split_part(p.pair, '__', 1))", "sharpe", "qlike", digits=6, keys="asset, pair"))
def g12(s, d):
    profit = M.performance(V.ledger(s, d), P, "d", "ret", "weight").select("asset", "pair", "sharpe", C.pair_parts(F.col("pair"))[0].alias("model"))
    precision = G.evaluate(models(s, d), ["asset", "model"], "f", "r").select("asset", "model", "qlike")
    return rounded(profit.join(precision, ["asset", "model"]).select("asset", "pair", "sharpe", "qlike"), 6)


@query("j12_first_available", rsql(LEDGER + ", q AS (SELECT asset, d, COALESCE(rv60, rv20, 0.1) AS vol, CASE WHEN rv60 IS NOT NULL THEN 'rv60' WHEN rv20 IS NOT NULL THEN 'rv20' ELSE 'target' END AS source FROM vols)", "vol", keys="asset, d, source"))
def j12(s, d):
    r = F.col("r")
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", E.realized(r, K, "d", 60).alias("rv60"), E.realized(r, K, "d", 20).alias("rv20"), F.lit(0.1).alias("target"))
    source = F.when(F.col("rv60").isNotNull(), "rv60").when(F.col("rv20").isNotNull(), "rv20").otherwise("target")
    return rounded(rows.select("asset", "d", J.first_available("rv60", "rv20", "target").alias("vol"), source.alias("source")))


@query("f5_sensitivity_names", """SELECT o_orderkey, CASE lower(trim(o_orderpriority[3:])) WHEN 'urgent' THEN 'very_high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'normal' WHEN 'low' THEN 'low' ELSE 'normal' END AS sensitivity FROM orders""")
def f5(s, d):
    said = F.substring("o_orderpriority", 3, 100)
    return V.table(s, d, "orders").select("o_orderkey", C.sensitivity(F.when(F.lower(F.trim(said)) == "urgent", "very high").otherwise(said)).alias("sensitivity"))


@query("r16_macro_regime", f"""WITH {VIX}, v AS (SELECT d, CASE WHEN COUNT(r) OVER w >= 63 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS vol FROM ew WINDOW w AS (ORDER BY d ROWS 62 PRECEDING))
SELECT v.d, CASE WHEN COALESCE(ROUND(vol, 8), 0) >= 0.14 OR ROUND(vix, 8) >= 24 THEN 'defensive' WHEN COALESCE(ROUND(vol, 8), 0) <= 0.09 AND ROUND(vix, 8) <= 18 THEN 'risk_on' ELSE 'balanced' END AS regime FROM v JOIN vix ON vix.d = v.d""")  # fmt: skip
def r16(s, d):
    ew = V.returns(s, d).where("r IS NOT NULL").groupBy("d").agg(F.avg("r").alias("r"))
    rows = ew.select("d", F.round(std(F.col("r"), roll(along([], "d"), 63), 63) * 252**0.5, 8).alias("vol")).join(V.vix(s, d), "d")
    return rows.select("d", R_.macro_regime(F.col("vol"), F.round("vix", 8)).alias("regime"))


@query("r17_past_quantile_regime", f"""WITH {R}, a AS (SELECT asset, d, rn, ABS(r) AS x, COUNT(r) OVER w AS n, QUANTILE_CONT(ABS(r), 1.0 / 3) OVER w AS lo, QUANTILE_CONT(ABS(r), 2.0 / 3) OVER w AS hi FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 755 PRECEDING))
SELECT asset, d, CASE WHEN ROUND(x, 10) <= ROUND(lo, 10) THEN 'low' WHEN ROUND(x, 10) >= ROUND(hi, 10) THEN 'high' ELSE 'middle' END AS regime FROM a WHERE n >= 252 AND rn % 5 = 0""")  # fmt: skip
def r17(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", F.abs("r").alias("x"), F.row_number().over(along(K, "d")).alias("n"))
    return R_.past_quantile_regime(rows, K, "d", "x", 756, 252).where("n % 5 = 0 AND regime IS NOT NULL").select("asset", "d", "regime")


#: Metrics of the first of each month: dates are chosen before any frame is gathered, drawdowns come from the frames alone.
MONTHLY = """, fx AS (SELECT w.asset, w.pair, w.d, w.ret, w.dw, row_number() OVER (PARTITION BY w.asset, w.pair ORDER BY w.d) AS k FROM wd w),
fd AS (SELECT x.asset, x.pair, x.d, y.ret, y.dw, y.k, SUM(y.ret) OVER (PARTITION BY x.asset, x.pair, x.d ORDER BY y.k) AS e FROM fx x JOIN fx y ON y.asset = x.asset AND y.pair = x.pair AND y.k BETWEEN x.k - 62 AND x.k WHERE DAY(x.d) = 1 AND x.k >= 63),
fe AS (SELECT *, EXP(e - MAX(e) OVER (PARTITION BY asset, pair, d ORDER BY k)) - 1 AS dd FROM fd),
mx AS (SELECT asset, pair, d, AVG(ret) * 252 AS ann, STDDEV_SAMP(ret) * SQRT(252) AS vol, CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS sh, -MIN(dd) AS dd, AVG(dw) AS turnover, SUM(ret) AS ret FROM fe GROUP BY 1, 2, 3)"""


@query("q20_portfolio_scores", f"""WITH {LEDGER}, wd AS (SELECT *, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM ledger){MONTHLY},
b AS (SELECT asset, d, ann AS b_ann, sh AS b_sh, CASE WHEN vol >= 0.14 OR dd >= 0.10 THEN 'defensive' WHEN vol <= 0.09 THEN 'risk_on' ELSE 'balanced' END AS regime FROM mx WHERE pair = 'rv20__constant')
SELECT asset, pair, d, regime, ROUND(CASE WHEN regime = 'defensive' THEN 0.70 ELSE 0.35 END * dd + 1.4 * GREATEST(vol - 0.11, 0) + 0.05 * turnover - 0.75 * sh - 1.75 * ann - 0.08 * ret, 6) + 0.0 AS score, ROUND(vol, 8) <= 0.11 AND (ROUND(ann - b_ann, 8) >= 0.021 OR ROUND(sh - b_sh, 8) >= 0.20) AS clears FROM mx JOIN b USING (asset, d)""")  # fmt: skip
def q20(s, d):
    """Scores of all pairs on the first of a month against the held benchmark, whose own metrics name the regime."""
    rows = M.checkpoint_metrics(V.ledger(s, d), P, "d", "ret", "weight", 63, F.dayofmonth("d") == 1)
    regime = F.when((F.col("vol") >= 0.14) | (F.col("drawdown") >= 0.10), "defensive").when(F.col("vol") <= 0.09, "risk_on").otherwise("balanced")
    mark = rows.where("pair = 'rv20__constant'").select("asset", "d", F.col("ann").alias("b_ann"), F.col("sharpe").alias("b_sharpe"), regime.alias("regime"))
    rows = rows.join(mark, ["asset", "d"])
    score = Q.portfolio_score(F.col("drawdown"), F.col("vol"), F.col("turnover"), F.col("sharpe"), F.col("ann"), F.col("total"), F.col("regime"))
    clears = Q.clears_hurdle(F.round("vol", 8), F.round(F.col("ann") - F.col("b_ann"), 8), F.round(F.col("sharpe") - F.col("b_sharpe"), 8))
    return rounded(rows.select(*P, "d", "regime", score.alias("score"), clears.alias("clears")), 6)


@query("q24_routed_context", rsql(LEDGER + """, x AS (SELECT asset, pair, d, ret, row_number() OVER (PARTITION BY asset, pair ORDER BY d DESC) AS k FROM ledger), w(win) AS (VALUES (20), (60), (100)),
y AS (SELECT x.*, win, EXP(SUM(ret) OVER o) AS e, QUANTILE_CONT(ret, 0.05) OVER (PARTITION BY asset, pair, win) AS c5 FROM x, w WHERE k <= win WINDOW o AS (PARTITION BY asset, pair, win ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
z AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair, win ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM y),
q AS (SELECT asset, pair, win, COUNT(*) AS n, EXP(SUM(ret)) - 1 AS total, AVG(ret) * 252 AS ann, STDDEV_SAMP(ret) * SQRT(252) AS vol, MIN(dd) AS drawdown, AVG(CASE WHEN ret <= c5 THEN ret END) AS cvar FROM z GROUP BY 1, 2, 3)""", "total", "ann", "vol", "drawdown", "cvar", digits=6, keys="asset, pair, win, n"))  # fmt: skip
def q24(s, d):
    led = V.ledger(s, d).select(*P, "d", "ret").withColumn("k", F.row_number().over(Window.partitionBy(*P).orderBy(F.desc("d"))))
    return rounded(Q.windows_context(led, P, "d", "ret", (20, 60, 100)), 6)
