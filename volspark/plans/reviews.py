"""Queries of reviews, candidate sources, routing inside splits, rate features and registered pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.frames import along, roll, std
from ..operators import forecast as E
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import positions as P_
from ..operators import protocol as K_
from ..operators import ranking as O
from ..operators import regimes as R_
from ..operators import registered as U
from ..operators import reviews as V_
from ..operators import routing as Q
from ..sources import views as V
from .core import MARKET, WM
from .more import FRAME_DD, metric_regimes
from .positions import fold_sql
from .registry import LEDGER, VIX, query, rounded, rsql
from .routes import BEST, BOOKED, NEXT, REVIEWS, SCORE, SPLIT, STICKY, WINDOWS, _wm_sql, labels, recent, reviews, score_rows, scores, selected

K = ["asset"]
P = ["asset", "pair"]


def _challenger_sql(n: int) -> str:
    w = f"(PARTITION BY asset, pair ORDER BY d ROWS {n - 1} PRECEDING)"
    return f"SELECT asset, pair, d, {n} AS win, COUNT(ret) OVER {w} AS n, AVG(ret) OVER {w} AS m, STDDEV_SAMP(ret) OVER {w} AS sd, AVG(dw) OVER {w} AS turnover, LIST(ret) OVER {w} AS a FROM wd"


def review_ranks(s, d):
    """Ranks and metrics of every pair over three windows, on the first of a month."""
    w = along(P, "d")
    led = V.ledger(s, d).withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(w)))
    found = []
    for n in WINDOWS:
        f = roll(w, n)
        m, sd = F.avg("ret").over(f), F.stddev_samp("ret").over(f)
        sharpe = F.when((F.count("ret").over(f) >= 2) & (sd > 0), m / sd * 252**0.5).otherwise(0.0)
        metrics = {"sharpe": sharpe, "ann": m * 252, "drawdown": F.abs(M.frame_drawdown(F.collect_list("ret").over(f))), "turnover": F.avg("dw").over(f)}
        found.append(F.struct(F.lit(n).alias("win"), *[F.round(v, 8).alias(k) for k, v in metrics.items()]))
    rows = led.withColumn("__w", F.array(*found)).where("day(d) = 1").select(*P, "d", F.inline("__w"))
    return O.ranked(rows, ["asset", "d", "win"], [-F.col("sharpe"), F.col("turnover"), F.col("pair")])


@query("q10_challengers", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{STICKY}, rl AS ({' UNION ALL '.join(map(_challenger_sql, WINDOWS))}),
r1 AS (SELECT asset, pair, d, win, ROUND(CASE WHEN n >= 2 AND sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sharpe, ROUND(m * 252, 8) AS ann, ROUND(ABS({FRAME_DD}), 8) AS drawdown, ROUND(turnover, 8) AS turnover FROM rl WHERE DAY(d) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY asset, d, win ORDER BY -sharpe, turnover NULLS FIRST, pair) AS k FROM r1),
j AS (SELECT f.asset, f.d, f.selected, f.since, r.pair, r.win = 20 AND (r.sharpe > COALESCE(a.sharpe, 0) OR r.sharpe >= COALESCE(a.sharpe, 0) AND r.ann > COALESCE(a.ann, 0)) AS quick, r.k < a.k AND (r.sharpe >= a.sharpe OR r.drawdown <= a.drawdown) AS beats
FROM f JOIN rk r ON r.asset = f.asset AND r.d = f.d AND r.pair <> f.selected LEFT JOIN rk a ON a.asset = f.asset AND a.d = f.d AND a.pair = f.selected AND a.win = r.win),
p AS (SELECT asset, d, selected, since, pair, BOOL_OR(quick) AS quick, COUNT(*) FILTER (beats) AS beats FROM j GROUP BY ALL)
SELECT asset, d, selected AS active, since AS hold, COUNT(*) FILTER (quick) AS short_n, COUNT(*) FILTER (beats >= 2) AS multi_n, since >= 30 AS held, COUNT(*) FILTER (beats >= 2) >= 2 AS exception FROM p GROUP BY ALL""")  # fmt: skip
def q10(s, d):
    active = V_.run_length(selected(s, d).select("asset", "d", F.col("selected").alias("active")), K, "d", "active")
    return V_.challengers(review_ranks(s, d), active, K, "d")


def _metrics_sql(key: str, source: str, name: str) -> str:
    return f"""{name}e AS (SELECT *, EXP(SUM(ret) OVER w) AS e FROM {source} WINDOW w AS (PARTITION BY {key} ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name}d AS (SELECT *, e / MAX(e) OVER (PARTITION BY {key} ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {name}e),
{name} AS (SELECT {key}, COUNT(*) AS n, ROUND(CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END, 8) AS sharpe, ROUND(-MIN(dd), 8) AS drawdown, ROUND(AVG(dw), 8) AS turnover FROM {name}d GROUP BY {key} HAVING COUNT(*) >= 20)"""


@query("q12_regime_pair_pool", f"""WITH {LEDGER}{WM}{MARKET}, lr AS (SELECT l.asset, l.pair, l.d, l.ret, l.weight, m.market_regime AS regime FROM ledger l JOIN market m ON m.asset = l.asset AND m.d = l.d WHERE m.market_regime IS NOT NULL),
lw AS (SELECT *, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM lr),
t AS (SELECT asset, d AS as_of FROM market WHERE market_regime IS NOT NULL AND DAY(d) = 1 AND MONTH(d) % 6 = 0),
hx AS (SELECT t.as_of, lw.* FROM t JOIN lw ON lw.asset = t.asset AND lw.d >= t.as_of - INTERVAL 3 MONTH AND lw.d < t.as_of), {_metrics_sql('asset, as_of, regime, pair', 'hx', 'h')},
sx AS (SELECT t.as_of, lw.* FROM t JOIN lw ON lw.asset = t.asset AND lw.d >= t.as_of - INTERVAL 12 MONTH AND lw.d < t.as_of), {_metrics_sql('asset, as_of, regime, pair', 'sx', 'st')},
rx AS (SELECT w.asset, w.d AS as_of, w.pair, w.obs AS n, ROUND(CASE WHEN w.obs >= 2 AND sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sharpe, ROUND(ABS({FRAME_DD}), 8) AS drawdown, ROUND(turnover_n, 8) AS turnover FROM wl w JOIN t ON t.asset = w.asset AND t.as_of = w.d),
u AS (SELECT asset, as_of, regime, pair, sharpe, drawdown, turnover, 0 AS source FROM h UNION ALL SELECT asset, as_of, regime, pair, sharpe, drawdown, turnover, 1 FROM st UNION ALL SELECT asset, as_of, g.regime, pair, sharpe, drawdown, turnover, 2 FROM rx, (VALUES ('low'), ('middle'), ('high')) AS g(regime)),
v AS (SELECT * FROM u QUALIFY source = MIN(source) OVER (PARTITION BY asset, as_of, regime)), g AS (SELECT *, turnover - LAG(turnover) OVER (PARTITION BY asset, as_of, regime ORDER BY turnover NULLS FIRST, pair) AS g FROM v),
hh AS (SELECT *, GREATEST(COALESCE(AVG(CASE WHEN g > 0 THEN g END) OVER (PARTITION BY asset, as_of, regime), 0), 0.0025) AS wd FROM g),
b AS (SELECT *, SUM(CASE WHEN g > wd THEN 1 ELSE 0 END) OVER (PARTITION BY asset, as_of, regime ORDER BY turnover NULLS FIRST, pair ROWS UNBOUNDED PRECEDING) AS bucket FROM hh)
SELECT asset, as_of, regime, pair, CAST(source AS INT) AS source, CAST(row_number() OVER (PARTITION BY asset, as_of, regime ORDER BY bucket, drawdown, -sharpe, pair) AS INT) AS rank FROM b""")  # fmt: skip
def q12(s, d):
    """Pairs of each regime as of a date: by three months of its rows, else by a year, else by recent rows."""
    lab = labels(s, d)
    rows = V.ledger(s, d).join(lab, ["asset", "d"])
    rows = rows.withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(along(P, "d"))))
    when = lab.where("day(d) = 1 AND month(d) % 6 = 0").select("asset", F.col("d").alias("as_of"))
    cols = ["asset", "as_of", "regime", "pair", "sharpe", "drawdown", "turnover"]
    past = [O.regime_block_ranks(J.trailing_rows(when, rows, K, "d", n), ["asset", "as_of"], "d").select(*cols) for n in (3, 12)]
    wm = M.window_metrics(V.ledger(s, d), P, "d", "ret", "weight", 0.1, 63).withColumnRenamed("d", "as_of").join(when, ["asset", "as_of"], "left_semi")
    r8 = lambda c: F.round(c, 8)
    now = wm.select("asset", "as_of", F.explode(F.array(*map(F.lit, ("low", "middle", "high")))).alias("regime"), "pair", r8("sharpe").alias("sharpe"), F.abs(r8("drawdown_n")).alias("drawdown"), r8("turnover_n").alias("turnover"))
    by = ["asset", "as_of", "regime"]
    return O.turnover_buckets(V_.first_source([*past, now], by), by).select(*by, "pair", "source", "rank")


@query("q15_vol_target_scores", f"""WITH {LEDGER}{WM}, x AS (SELECT asset, pair, d, sd * SQRT(252) AS vol, ROUND(ABS(sd * SQRT(252) - 0.1), 10) AS ve, ROUND(CASE WHEN sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sh, ROUND(ABS({FRAME_DD}), 8) AS dd, ROUND(turnover_n, 8) AS turnover, -list_avg(list_filter(a, lambda x: x <= q05)) AS cvar FROM wl WHERE obs >= 63 AND DAY(d) = 1),
b AS (SELECT asset, d, sh AS b_sh FROM x WHERE pair = 'rv20__constant')
SELECT asset, pair, d, ROUND(1.35 * sh + 0.45 * (sh - b_sh) - 4 * ve - 2 * GREATEST(0.07 - vol, 0) - 2.5 * GREATEST(vol - 0.13, 0) - 1.75 * dd - 0.75 * ABS(cvar) - 0.1 * turnover, 6) + 0.0 AS score,
CAST(row_number() OVER (PARTITION BY asset, d ORDER BY FLOOR(ROUND(ve * 1e6, 2)), -sh, dd, turnover, pair) AS INT) AS rank FROM x JOIN b USING (asset, d)""")  # fmt: skip
def q15(s, d):
    r8 = lambda c: F.round(c, 8)
    rows = metric_regimes(s, d).where("day(d) = 1").select(*P, "d", "vol", F.round("vol_error", 10).alias("vol_error"), r8("sharpe").alias("sharpe"), F.abs(r8("drawdown_n")).alias("drawdown"), r8("turnover_n").alias("turnover"), F.col("cvar_n").alias("cvar"))
    mark = rows.where("pair = 'rv20__constant'").select("asset", "d", F.col("sharpe").alias("b_sharpe"))
    rows = rows.join(mark, ["asset", "d"])
    score = V_.vol_target_score(F.col("sharpe"), F.col("sharpe") - F.col("b_sharpe"), F.col("vol"), F.col("vol_error"), F.col("drawdown"), F.col("cvar"), F.col("turnover"), 0.10)
    return rounded(O.ranked(rows.withColumn("score", score), ["asset", "d"], V_.vol_target_order()).select(*P, "d", "score", "rank"), 6)


@query("q14_checkpointed_router", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}{REVIEWS.replace('rv AS (SELECT *,', "cp AS (SELECT * REPLACE ((i - 1) // 21 + 1 AS i) FROM mp WHERE (i - 1) % 21 = 0), rv AS (SELECT *,").replace('AS changed FROM mp', 'AS changed FROM cp')},
f AS (SELECT asset, d, i, {BEST.replace('x.s', 's')} AS active, 0 AS since FROM rv WHERE i = 1 UNION ALL
SELECT asset, d, i, CASE WHEN sw THEN best ELSE active END, CASE WHEN sw THEN 0 ELSE since + 21 END FROM (SELECT *, since + 21 >= 30 AND (lead >= -0.02 OR fell AND lead >= -0.10 OR COALESCE(changed, FALSE) AND lead >= -0.02) AS sw FROM (
SELECT asset, d, i, active, since, changed, best, s[best] - COALESCE(s[active], -1e300) AS lead, ABS(COALESCE(dd[active], 0)) > 0.08 AS fell FROM (SELECT x.asset, x.d, x.i, x.s, x.dd, x.changed, f.active, f.since, {NEXT} AS best FROM f JOIN rv x ON x.asset = f.asset AND x.i = f.i + 1))))
SELECT mp.asset, mp.d, f.active FROM mp ASOF JOIN f ON f.asset = mp.asset AND mp.d >= f.d""")  # fmt: skip
def q14(s, d):
    """Switches are weighed every 21 rows only; the pair holds between."""
    rows = reviews(s, d).withColumn("i", F.row_number().over(along(K, "d")))
    points = rows.where("(i - 1) % 21 = 0")
    points = points.withColumn("changed", F.col("regime") != F.lag("regime").over(along(K, "d")))
    picks = Q.rule_switches(points, K, "d", "normal", 30, 21)
    return J.asof(rows.select("asset", "d"), picks.select("asset", "d", "active"), K, "d", ["active"])


MAPS = ", ".join(f"MAP(list(pair ORDER BY pair) FILTER (win = {n}), list(k ORDER BY pair) FILTER (win = {n})) AS r{n}" for n in WINDOWS)
BEATS = " + ".join(f"CASE WHEN x.r{n}[p] < x.r{n}[f.active] THEN 1 ELSE 0 END" for n in WINDOWS)


@query("q21_review_gates", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}, rc AS ({' UNION ALL '.join(map(_wm_sql, WINDOWS))}),
rk AS (SELECT *, row_number() OVER (PARTITION BY asset, d, win ORDER BY -sharpe, turnover NULLS FIRST, pair) AS k FROM rc), rm AS (SELECT asset, d, {MAPS} FROM rk GROUP BY 1, 2),
mp AS (SELECT sc.asset, sc.d, MAP(list(pair ORDER BY pair), list(score ORDER BY pair)) AS s, row_number() OVER (PARTITION BY sc.asset ORDER BY sc.d) AS i FROM sc GROUP BY 1, 2), x AS (SELECT mp.*, rm.* EXCLUDE (asset, d), {BEST.replace('x.s', 's')} AS best FROM mp JOIN rm USING (asset, d)),
f AS (SELECT asset, d, i, best AS active, 0 AS since, i AS last, 'initial' AS reason FROM x WHERE i = 1 UNION ALL
SELECT asset, d, i, CASE WHEN why = 'switch' THEN best ELSE active END, CASE WHEN why = 'switch' THEN 0 ELSE since END, CASE WHEN why = 'interval' THEN last ELSE i END, why FROM (
SELECT *, CASE WHEN i - last < 5 THEN 'interval' WHEN since < 20 AND NOT poor THEN 'cooldown' WHEN since < 30 AND better < 2 THEN 'group' WHEN best <> active AND lead > 0 THEN 'switch' ELSE 'keep' END AS why FROM (
SELECT x.asset, x.d, x.i, x.best, f.active, f.since + 1 AS since, f.last, x.s[x.best] - COALESCE(x.s[f.active], -1e300) AS lead, {' AND '.join(f'x.r{n}[f.active] > 3' for n in WINDOWS)} AS poor,
len(list_filter(map_keys(x.s), lambda p: p <> f.active AND {BEATS} >= 2)) AS better FROM f JOIN x ON x.asset = f.asset AND x.i = f.i + 1)))
SELECT asset, d, active, reason FROM f""")  # fmt: skip
def q21(s, d):
    rk = O.ranked(recent(s, d), ["asset", "d", "win"], [-F.col("sharpe"), F.col("turnover"), F.col("pair")])
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("win") == n, F.struct("pair", "rank"))))).alias(f"rank_{n}") for n in WINDOWS]
    rows = Q.score_map(scores(s, d), K, "d", "pair", "score").join(rk.groupBy("asset", "d").agg(*maps), ["asset", "d"])
    return V_.reviewed_switches(rows, K, "d", WINDOWS)


@query("q22_recorded_routing", rsql(LEDGER + """, sw AS (SELECT asset, CAST(DATE_TRUNC('quarter', d) AS DATE) AS d, CASE WHEN QUARTER(d) % 2 = 0 THEN 'rv20__clip' ELSE 'rv60__constant' END AS pair FROM ledger GROUP BY ALL),
dd AS (SELECT DISTINCT asset, d FROM ledger), f AS (SELECT dd.asset, dd.d, sw.pair AS selected FROM dd ASOF LEFT JOIN sw ON sw.asset = dd.asset AND dd.d >= sw.d)""" + BOOKED, "ret", "equity", digits=6, keys="asset, d, pair, switched"))  # fmt: skip
def q22(s, d):
    """Recorded decisions, held until the next one, booked with a lag and the cost of switches."""
    led = V.ledger(s, d)
    sw = led.select("asset", F.to_date(F.date_trunc("quarter", "d")).alias("d")).distinct().withColumn("selected", F.when(F.quarter("d") % 2 == 0, "rv20__clip").otherwise("rv60__constant"))
    held = J.asof(led.select("asset", "d").distinct(), sw, K, "d", ["selected"])
    return rounded(Q.routed_ledger(held, led, K, "d"), 6)


@query("q23_carried_regime", f"""WITH {VIX}, v AS (SELECT d, CASE WHEN COUNT(r) OVER w >= 63 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS vol FROM ew WINDOW w AS (ORDER BY d ROWS 62 PRECEDING)),
g AS (SELECT v.d, row_number() OVER (ORDER BY v.d) AS i, CASE WHEN COALESCE(ROUND(vol, 8), 0) >= 0.14 OR ROUND(vix, 8) >= 24 THEN 'defensive' WHEN COALESCE(ROUND(vol, 8), 0) <= 0.09 AND ROUND(vix, 8) <= 18 THEN 'risk_on' ELSE 'balanced' END AS regime FROM v JOIN vix ON vix.d = v.d),
a AS (SELECT d, regime FROM g WHERE (i - 1) % 21 = 0)
SELECT v.d, a.regime, a.d AS signal_date FROM v ASOF LEFT JOIN a ON v.d >= a.d""")  # fmt: skip
def q23(s, d):
    """The macro regime at every 21st date that has all inputs, carried to all dates with its own."""
    ew = V.returns(s, d).where("r IS NOT NULL").groupBy("d").agg(F.avg("r").alias("r"))
    days = ew.select("d", F.round(std(F.col("r"), roll(along([], "d"), 63), 63) * 252**0.5, 8).alias("vol"))
    rows = days.join(V.vix(s, d), "d").select("d", R_.macro_regime(F.col("vol"), F.round("vix", 8)).alias("regime"), F.row_number().over(Window.orderBy("d")).alias("i"))
    points = rows.where("(i - 1) % 21 = 0").select("d", "regime", F.col("d").alias("signal_date"))
    return J.asof(days.select("d"), points, [], "d", ["regime", "signal_date"])


@query("r10_confident_persistence", f"""WITH RECURSIVE {LEDGER}, z AS (SELECT asset, d, ROUND(ABS(r) / rv20 * SQRT(252), 6) AS x, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM vols WHERE rv20 > 0),
lab AS (SELECT *, CASE WHEN x < 0.5 THEN 'low' WHEN x < 1.2 THEN 'middle' ELSE 'high' END AS label, ROUND(LEAST(ABS(x - 0.5), ABS(x - 1.2)), 6) AS sure FROM z),
f AS (SELECT asset, d, i, label AS held, 0 AS run FROM lab WHERE i = 1 UNION ALL
SELECT asset, d, i, CASE WHEN run >= 2 THEN label ELSE held END, CASE WHEN run >= 2 THEN 0 ELSE run END FROM (SELECT n.asset, n.d, n.i, n.label, f.held, CASE WHEN n.label <> f.held AND n.sure >= 0.2 THEN f.run + 1 ELSE 0 END AS run FROM f JOIN lab n ON n.asset = f.asset AND n.i = f.i + 1))
SELECT asset, d, held AS label_held FROM f""")  # fmt: skip
def r10(s, d):
    """The return's size against its vol as a label, held until two sure rows in a row say otherwise."""
    r = F.col("r")
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r", E.realized(r, K, "d", 20).alias("vol")).where("vol > 0")
    rows = rows.withColumn("x", F.round(F.abs(r) / F.col("vol") * 252**0.5, 6))
    rows = rows.withColumns({"label": F.when(F.col("x") < 0.5, "low").when(F.col("x") < 1.2, "middle").otherwise("high"), "sure": F.round(F.least(F.abs(F.col("x") - 0.5), F.abs(F.col("x") - 1.2)), 6)})
    return R_.persistent(rows, K, "d", "label", 2, "sure", 0.2).select("asset", "d", "label_held")


#: config -> (score column, frozen as of the last train row).
CONFIGS = {"full": ("score", False), "no_regime": ("plain", False), "frozen": ("score", True)}
ROUTED = SPLIT.replace("FROM ledger)", "FROM sc2)") + f""", fz AS (SELECT asset, pair, split, arg_max(score, d) AS fs FROM sp WHERE role = 'train' GROUP BY 1, 2, 3),
tt AS (SELECT c.config, sp.asset, sp.split, sp.d, sp.pair, CASE c.config WHEN 'full' THEN sp.score WHEN 'no_regime' THEN sp.plain ELSE fz.fs END AS score FROM sp JOIN fz USING (asset, pair, split), (VALUES ('full'), ('no_regime'), ('frozen')) AS c(config) WHERE role = 'test'),
mp AS (SELECT config, asset, split, d, MAP(list(pair ORDER BY pair), list(score ORDER BY pair)) AS s, row_number() OVER (PARTITION BY config, asset, split ORDER BY d) AS i FROM tt GROUP BY 1, 2, 3, 4), x AS (SELECT mp.*, {BEST.replace('x.s', 's')} AS best FROM mp),
f AS (SELECT config, asset, split, d, i, best AS selected, 0 AS since FROM x WHERE i = 1 UNION ALL
SELECT config, asset, split, d, i, CASE WHEN sw THEN best ELSE selected END, CASE WHEN sw THEN 0 ELSE since + 1 END FROM (SELECT x.config, x.asset, x.split, x.d, x.i, x.best, f.selected, f.since, x.best <> f.selected AND f.since + 1 >= 5 AND x.s[x.best] - COALESCE(x.s[f.selected], -1e300) > 0 AS sw FROM f JOIN x ON x.config = f.config AND x.asset = f.asset AND x.split = f.split AND x.i = f.i + 1))"""


@query("k3_k6_k7_routed_splits", rsql("RECURSIVE " + LEDGER + WM + MARKET + SCORE + ", sc2 AS (SELECT sc.*, ROUND(wq.ls - wq.lv, 6) AS plain FROM sc JOIN wq USING (asset, pair, d))" + ROUTED + """, lg AS (SELECT config, asset, split, d, LAG(selected) OVER (PARTITION BY config, asset, split ORDER BY d) AS pair FROM f), bk AS (SELECT lg.config, lg.asset, lg.split, lg.d, l.ret, CASE WHEN LAG(lg.pair) OVER (PARTITION BY lg.config, lg.asset, lg.split ORDER BY lg.d) <> lg.pair THEN 1 ELSE 0 END AS sw FROM lg JOIN ledger l ON l.asset = lg.asset AND l.d = lg.d AND l.pair = lg.pair),
q AS (SELECT config, asset, split, COUNT(*) AS n, CAST(SUM(sw) AS BIGINT) AS switches, CASE WHEN STDDEV_SAMP(ret - 0.0005 * sw) > 0 THEN AVG(ret - 0.0005 * sw) / STDDEV_SAMP(ret - 0.0005 * sw) * SQRT(252) ELSE 0 END AS sharpe FROM bk GROUP BY 1, 2, 3)""", "sharpe", digits=6, keys="config, asset, split, n, switches"))  # fmt: skip
def k3(s, d):
    """Routing inside each split's test rows: with the regime's bias, without it, and with scores frozen at its start."""
    picks = K_.routed_splits(score_rows(s, d), K, "d", CONFIGS)
    led = Q.routed_ledger(picks, V.ledger(s, d), ["config", "asset", "split"], "d", on=K)
    return rounded(led.groupBy("config", "asset", "split").agg(F.count("*").alias("n"), F.count_if("switched").alias("switches"), M.sharpe(F.col("ret")).alias("sharpe")), 6)


MACRO = VIX + """, ts AS (SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS d, ROUND(AVG(l_discount) * 100 - 5, 8) AS s2, ROUND(AVG(l_tax) * 50 - 2, 8) AS s3 FROM lineitem GROUP BY 1),
macro AS (SELECT a.d, a.vix, ts.s2, ts.s3 FROM (SELECT ew.d, vix.vix FROM ew ASOF LEFT JOIN vix ON ew.d >= vix.d) a ASOF LEFT JOIN ts ON a.d >= ts.d)"""


def macro(s, d):
    """asset, d, r with the vol index and two slopes as of the date."""
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    lines = V.table(s, d, "lineitem")
    slopes = lines.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg(F.round(F.avg("l_discount") * 100 - 5, 8).alias("s2y10y"), F.round(F.avg("l_tax") * 50 - 2, 8).alias("s3m10y"))
    days = J.asof(J.asof(rows.select("d").distinct(), V.vix(s, d), [], "d", ["vix"]), slopes, [], "d", ["s2y10y", "s3m10y"])
    return rows.join(days, "d")


@query("e17_curve_features", rsql(MACRO + """, x0 AS (SELECT rr.asset, rr.d, r, r * r AS rv_d, POWER(vix / 100, 2) / 252 AS vix, s2, s3 FROM rr JOIN macro USING (d)),
x1 AS (SELECT *, CASE WHEN COUNT(r) OVER f5 >= 5 THEN AVG(rv_d) OVER f5 END AS rv_w, CASE WHEN COUNT(r) OVER f22 >= 22 THEN AVG(rv_d) OVER f22 END AS rv_m, CASE WHEN COUNT(r) OVER f63 >= 63 THEN AVG(rv_d) OVER f63 END AS rv_q,
CASE WHEN COUNT(r) OVER f20 >= 20 THEN POWER(STDDEV_SAMP(r) OVER f20, 2) END AS v20, CASE WHEN COUNT(r) OVER f22 >= 22 THEN STDDEV_SAMP(rv_d) OVER f22 END AS vol_of_vol, CASE WHEN COUNT(r) OVER f22 >= 22 AND ABS(r) > 3 * STDDEV_SAMP(r) OVER f22 THEN 1 ELSE 0 END AS jump_flag,
vix - LAG(vix) OVER w AS vix_diff, s2 - LAG(s2) OVER w AS d2, s3 - LAG(s3) OVER w AS d3 FROM x0 WINDOW w AS (PARTITION BY asset ORDER BY d), f5 AS (PARTITION BY asset ORDER BY d ROWS 4 PRECEDING), f20 AS (PARTITION BY asset ORDER BY d ROWS 19 PRECEDING), f22 AS (PARTITION BY asset ORDER BY d ROWS 21 PRECEDING), f63 AS (PARTITION BY asset ORDER BY d ROWS 62 PRECEDING)),
x2 AS (SELECT *, vix / (rv_w + 1e-8) AS vrp, d2 - LAG(d2) OVER (PARTITION BY asset ORDER BY d) AS accel_slope, CASE WHEN s2 < 0 THEN 1.0 ELSE 0.0 END AS inv_2y10y, CASE WHEN s3 < 0 THEN 1.0 ELSE 0.0 END AS inv_3m10y FROM x1),
q AS (SELECT asset, d, rv_d, rv_w, rv_m, rv_q, COALESCE(v20, rv_m) AS rv20, CASE WHEN r < 0 THEN 1 ELSE 0 END AS ret_sign, vol_of_vol, jump_flag, vix, vix_diff, vrp, s2 AS slope_2y10y, s3 AS slope_3m10y, d2 AS d_slope_2y10y, d3 AS d_slope_3m10y, accel_slope, inv_2y10y, inv_3m10y, vrp * inv_2y10y AS vrp_x_inv, s2 * vol_of_vol AS slope_x_vov FROM x2)""",
    *[c for c in E.CURVE if c not in ("ret_sign", "jump_flag")], digits=6, keys="asset, d, ret_sign, jump_flag"))
def e17(s, d):
    return rounded(E.curve_features(macro(s, d), K, "d", "r"), 6)


@query("e7_rate_har")
def e7(s, d):
    return rounded(E.rate_har(E.curve_features(macro(s, d), K, "d", "r"), K, "d"), 6)


@query("s219_registered_pairs", fold_sql("0.5 * scaled", high="1.5").replace("SELECT asset, d, ROUND(w", "SELECT asset, d, 'rv20__half' AS pair, ROUND(w"))
def registered(s, d):
    """A forecast and a position rule added by name and run as a table of pairs."""
    U.register_forecast("rv20", lambda r, keys, order: E.realized(r, keys, order, 20))
    U.register_position("half", lambda vol: F.when(vol > 0, 0.5 * (0.10 / F.greatest(vol, F.lit(1e-8)))), P_.RULES["clip"])
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    return rounded(U.run_registered(rows, K, "d", "r", ["rv20"], ["half"]).select("asset", "d", "pair", "weight", "ret", "equity"), 6, ret=8)
