"""Queries of the remaining grouped metrics, regime flags and candidate filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll, std
from ..operators import forecast as E
from ..operators import metrics as M
from ..operators import regimes as R_
from ..operators import routing as Q
from ..operators import windows as W
from ..operators.joins import labelled_past
from ..sources import views as V
from .core import MARKET, PERF, WM
from .registry import LEDGER, R, VIX, query, rounded, rsql
from .routes import labels

K = ["asset"]
P = ["asset", "pair"]


def rets(s, d):
    return V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")


@query("a10_average_turnover", rsql(LEDGER + ", w AS (SELECT asset, pair, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM ledger), q AS (SELECT asset, pair, AVG(dw) AS turnover FROM w GROUP BY 1, 2)", "turnover", keys="asset, pair"))
def a10(s, d):
    rows = V.ledger(s, d).withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(along(P, "d"))))
    return rounded(rows.groupBy(*P).agg(F.avg("dw").alias("turnover")))


@query("a18_regime_history", rsql(LEDGER + MARKET + """, lr AS (SELECT l.asset, l.pair, l.d, l.ret, m.market_regime AS regime FROM ledger l JOIN market m ON m.asset = l.asset AND m.d = l.d WHERE m.market_regime IS NOT NULL),
t AS (SELECT asset, d AS as_of, market_regime AS regime FROM market WHERE market_regime IS NOT NULL AND DAY(d) = 1 AND MONTH(d) % 3 = 0),
q AS (SELECT t.asset, t.as_of, t.regime, lr.pair, COUNT(*) AS n, CASE WHEN COUNT(*) >= 2 AND STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS sharpe FROM t JOIN lr ON lr.asset = t.asset AND lr.regime = t.regime AND lr.d >= t.as_of - INTERVAL 24 MONTH AND lr.d < t.as_of GROUP BY 1, 2, 3, 4)""",
    "sharpe", digits=6, keys="asset, as_of, regime, pair, n"))
def a18(s, d):
    lab = labels(s, d)
    when = lab.where("day(d) = 1 AND month(d) % 3 = 0").withColumnRenamed("d", "as_of")
    past = labelled_past(when, V.ledger(s, d), lab, K, "d", "regime", 24)
    return rounded(past.groupBy("asset", "as_of", "regime", "pair").agg(F.count("*").alias("n"), M.sharpe(F.col("ret")).alias("sharpe")), 6)


@query("a22_oos_r2_by_regime", rsql(LEDGER + MARKET + """, x AS (SELECT v.asset, v.d, ABS(v.r) * SQRT(252) AS y, rv20 AS f FROM vols v), b AS (SELECT *, AVG(y) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM x),
q AS (SELECT b.asset, m.market_regime AS regime, 1 - SUM(POWER(y - f, 2)) / SUM(POWER(y - b, 2)) AS oos_r2, COUNT(*) AS n FROM b JOIN market m ON m.asset = b.asset AND m.d = b.d WHERE m.market_regime IS NOT NULL AND f IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2)""",
    "oos_r2", digits=6, keys="asset, regime, n"))
def a22(s, d):
    rows = rets(s, d).withColumns({"y": F.abs("r") * F.sqrt(F.lit(252.0)), "f": E.realized(F.col("r"), K, "d", 20)})
    rows = rows.join(labels(s, d), ["asset", "d"], "left")
    return rounded(M.oos_r2_by(rows, K, "d", "regime", "y", "f").where("regime IS NOT NULL"), 6)


@query("a24_drawdown_consistency", rsql(LEDGER + """, g AS (SELECT *, YEAR(d) AS y FROM ledger), e AS (SELECT asset, pair, y, d, EXP(SUM(ret) OVER (PARTITION BY asset, pair, y ORDER BY d)) AS e FROM g),
w AS (SELECT asset, pair, y, MIN(dd) AS dd FROM (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair, y ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e) GROUP BY 1, 2, 3),
q AS (SELECT asset, pair, AVG(ABS(dd)) AS dd_mean, STDDEV_POP(ABS(dd)) AS dd_std, MAX(ABS(dd)) AS dd_max, AVG(ABS(ABS(dd) - 0.07)) AS dd_gap, -(AVG(ABS(ABS(dd) - 0.07)) + STDDEV_POP(ABS(dd))) AS dd_score FROM w GROUP BY 1, 2)""",
    "dd_mean", "dd_std", "dd_max", "dd_gap", "dd_score", digits=6, keys="asset, pair"))
def a24(s, d):
    led = V.ledger(s, d).withColumn("y", F.year("d"))
    per = M.max_drawdown(led, [*P, "y"], "d", "ret")
    return rounded(M.drawdown_consistency(per, P, "max_drawdown").select(*P, "dd_mean", "dd_std", "dd_max", "dd_gap", "dd_score"), 6)


@query("a28_regime_pivot", f"""WITH {LEDGER}{MARKET}, lr AS (SELECT l.pair, l.ret, m.market_regime AS regime FROM ledger l JOIN market m ON m.asset = l.asset AND m.d = l.d)
SELECT pair, ROUND(AVG(CASE WHEN regime = 'low' THEN ret END), 8) + 0.0 AS low, ROUND(AVG(CASE WHEN regime = 'middle' THEN ret END), 8) + 0.0 AS middle, ROUND(AVG(CASE WHEN regime = 'high' THEN ret END), 8) + 0.0 AS high FROM lr GROUP BY 1""")  # fmt: skip
def a28(s, d):
    led = V.ledger(s, d).join(labels(s, d), ["asset", "d"])
    return rounded(led.groupBy("pair").pivot("regime", ["low", "middle", "high"]).agg(F.avg("ret")))


@query("r3_spread_buckets", rsql(VIX + """, v AS (SELECT d, CASE WHEN COUNT(r) OVER w >= 20 THEN STDDEV_SAMP(r) OVER w * SQRT(252) * 100 END AS rv FROM ew WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)),
q AS (SELECT v.d, vix.vix - v.rv AS spread, CASE WHEN vix.vix - v.rv <= -2 THEN 'inverted' WHEN vix.vix - v.rv >= 2 THEN 'wide' ELSE 'normal' END AS bucket FROM v JOIN vix ON vix.d = v.d)""", "spread", digits=6, keys="d, bucket"))  # fmt: skip
def r3(s, d):
    ew = rets(s, d).groupBy("d").agg(F.avg("r").alias("r"))
    rows = ew.select("d", (std(F.col("r"), roll(along([], "d"), 20), 20) * 252**0.5 * 100).alias("rv")).join(V.vix(s, d), "d")
    rows = rows.select("d", (F.col("vix") - F.col("rv")).alias("spread"))
    return rounded(rows.withColumn("bucket", R_.spread_bucket(F.col("spread"), 2.0)), 6)


#: Drawdown of a window's summed returns ``a``.
FRAME_DD = """EXP(list_reduce(list_transform(a, lambda x: {'e': x, 'p': GREATEST(x, 0), 'd': x - GREATEST(x, 0)}),
lambda s, x: {'e': s.e + x.e, 'p': GREATEST(s.p, s.e + x.e), 'd': LEAST(s.d, s.e + x.e - GREATEST(s.p, s.e + x.e))}).d) - 1"""


@query("r15_metric_regime", f"""WITH {LEDGER}{WM}, x AS (SELECT asset, pair, d, ROUND(m * 252, 8) AS ann, ROUND(sd * SQRT(252), 8) AS vol, ROUND(ABS(sd * SQRT(252) - 0.1), 8) AS ve, ROUND(CASE WHEN sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sh, ROUND({FRAME_DD}, 8) AS dd FROM wl WHERE obs >= 63)
SELECT asset, pair, d, CASE WHEN sh >= 0.85 AND ann >= 0.08 AND vol >= 0.075 AND vol <= 0.115 THEN 'risk_on' WHEN dd <= -0.07 OR ve >= 0.035 OR ann < 0.02 THEN 'defensive' WHEN sh >= 0.65 AND ann >= 0.05 AND ve <= 0.03 THEN 'risk_on' ELSE 'balanced' END AS regime FROM x""")
def r15(s, d):
    return metric_regimes(s, d).select("asset", "pair", "d", "regime")


def metric_regimes(s, d):
    """Window metrics of 63 rows with the regime that they tell."""
    w = roll(along(P, "d"), 63)
    wm = M.window_metrics(V.ledger(s, d), P, "d", "ret", "weight", 0.1, 63)
    wm = wm.withColumns({"ann": F.avg("ret").over(w) * 252, "vol": F.stddev_samp("ret").over(w) * 252**0.5}).where("obs >= 63")
    r8 = lambda c: F.round(c, 8)
    return wm.withColumn("regime", R_.metric_regime(r8("sharpe"), r8("drawdown_n"), r8("vol_error"), r8("vol"), r8("ann")))


@query("r4_stress_flags", f"""WITH {R}, e AS (SELECT asset, d, volume, EXP(SUM(r) OVER (PARTITION BY asset ORDER BY d)) AS e FROM rr), f AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd, QUANTILE_CONT(volume, 0.1) OVER (PARTITION BY asset) AS q FROM e)
SELECT asset, d, volume <= q AS thin, ROUND(dd, 8) <= -0.02 AS drawn FROM f""")  # fmt: skip
def r4(s, d):
    rows = W.equity_curve(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r")
    rows = R_.bucket(rows, K, "volume", 0.1, 0.9, out="liquidity")
    return rows.select("asset", "d", (F.col("liquidity") == "low").alias("thin"), (F.round("drawdown", 8) <= -0.02).alias("drawn"))


@query("j13_router_baseline", rsql(LEDGER + """, a AS (SELECT asset, d, ret AS x FROM ledger WHERE pair = 'rv20__clip'), b AS (SELECT asset, d, ret AS y FROM ledger WHERE pair = 'rv20__constant'),
q AS (SELECT asset, COUNT(*) AS n, AVG(x - y) * 252 AS excess, STDDEV_SAMP(x - y) * SQRT(252) AS tracking, CORR(x, y) AS corr FROM a JOIN b USING (asset, d) GROUP BY 1)""", "excess", "tracking", "corr", digits=6, keys="asset, n"))  # fmt: skip
def j13(s, d):
    led = V.ledger(s, d).select("asset", "d", "pair", "ret")
    a = led.where("pair = 'rv20__clip'").select("asset", "d", F.col("ret").alias("x"))
    b = led.where("pair = 'rv20__constant'").select("asset", "d", F.col("ret").alias("y"))
    gap = F.col("x") - F.col("y")
    out = a.join(b, ["asset", "d"]).groupBy("asset").agg(F.count("*").alias("n"), (F.avg(gap) * 252).alias("excess"), (F.stddev_samp(gap) * 252**0.5).alias("tracking"), F.corr("x", "y").alias("corr"))
    return rounded(out, 6)


LOOKS = (10, 63, 126)


def _edge_sql(n: int) -> str:
    w = f"(PARTITION BY asset, pair ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"SUM(ret) OVER {w} AS ret_{n}, COALESCE(STDDEV_SAMP(ret) OVER {w} * SQRT(252), 0.1) AS vol_{n}, AVG(dw) OVER {w} AS to_{n}, LIST(ret) OVER {w} AS a_{n}"


@query("q17_risk_filter", f"""WITH {LEDGER}, wd AS (SELECT *, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM ledger), lw AS (SELECT asset, pair, d, {', '.join(_edge_sql(n) for n in LOOKS)} FROM wd),
lv AS (SELECT * FROM lw QUALIFY row_number() OVER (PARTITION BY asset, pair ORDER BY d DESC) = 1), ld AS (SELECT *, {', '.join(f"-({FRAME_DD.replace('list_transform(a,', f'list_transform(a_{n},')}) AS dd_{n}" for n in LOOKS)} FROM lv),
bm AS (SELECT asset, {', '.join(f'ret_{n} AS b_{n}' for n in LOOKS)} FROM ld WHERE pair = 'rv20__constant'),
x AS (SELECT ld.asset, pair, (ret_10 - b_10 + ret_63 - b_63 + ret_126 - b_126) / 3 AS edge, GREATEST(to_10, to_63, to_126) AS turnover, GREATEST(dd_10, dd_63, dd_126) AS drawdown, GREATEST(vol_10, vol_63, vol_126) AS vol, GREATEST(ABS(vol_10 - 0.1), ABS(vol_63 - 0.1), ABS(vol_126 - 0.1)) AS vol_error FROM ld JOIN bm USING (asset))
SELECT asset, pair, CASE WHEN ROUND(vol, 8) > 0.16 THEN 'vol' WHEN ROUND(drawdown, 8) > 0.12 THEN 'drawdown' END AS blocked, ROUND(edge - 4 * turnover - 0.5 * drawdown - 2 * vol_error, 6) + 0.0 AS score FROM x""")  # fmt: skip
def q17(s, d):
    """As of each pair's last row: return edge over the benchmark pair's, less turnover, drawdown and
    distance from the target vol, over three windows; hard limits of vol and drawdown."""
    w = along(P, "d")
    led = V.ledger(s, d).withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(w)))
    wide = {}
    for n in LOOKS:
        f = roll(w, n)
        wide |= {f"ret_{n}": F.sum("ret").over(f), f"vol_{n}": F.coalesce(F.stddev_samp("ret").over(f) * 252**0.5, F.lit(0.1)), f"to_{n}": F.avg("dw").over(f), f"dd_{n}": -M.frame_drawdown(F.collect_list("ret").over(f))}
    last = led.withColumns(wide).withColumn("k", F.row_number().over(Window.partitionBy(*P).orderBy(F.desc("d")))).where("k = 1")
    mark = last.where("pair = 'rv20__constant'").select("asset", *[F.col(f"ret_{n}").alias(f"b_{n}") for n in LOOKS])
    cols = lambda c: [F.col(f"{c}_{n}") for n in LOOKS]
    edge = sum((a - b for a, b in zip(cols("ret"), cols("b"))), F.lit(0.0)) / 3
    rows = last.join(mark, "asset").select("asset", "pair", edge.alias("edge"), F.greatest(*cols("to")).alias("turnover"), F.greatest(*cols("dd")).alias("drawdown"), F.greatest(*cols("vol")).alias("vol"), F.greatest(*[F.abs(v - 0.1) for v in cols("vol")]).alias("vol_error"))
    out = Q.constrained(rows, K, "pair", [("vol", F.round("vol", 8) <= 0.16), ("drawdown", F.round("drawdown", 8) <= 0.12)])
    return rounded(out.select("asset", "pair", "blocked", Q.risk_adjusted(F.col("edge"), F.col("turnover"), F.col("drawdown"), F.col("vol_error")).alias("score")), 6)


@query("j4_label_alignment", f"""WITH {LEDGER}{MARKET} SELECT l.asset, COALESCE(m.market_regime, 'none') AS regime, COUNT(*) AS n FROM ledger l LEFT JOIN market m ON m.asset = l.asset AND m.d = l.d GROUP BY 1, 2""")
def j4(s, d):
    rows = V.ledger(s, d).join(labels(s, d), ["asset", "d"], "left")
    return rows.groupBy("asset", F.coalesce("regime", F.lit("none")).alias("regime")).agg(F.count("*").alias("n"))
