"""Queries of the ranking, routing and walk-forward operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.frames import along, cum, roll
from ..operators import metrics as M
from ..operators import protocol as K_
from ..operators import ranking as O
from ..operators import routing as Q
from ..operators import windows as W
from ..sources import views as V
from .core import MARKET, PERF, WM
from .registry import LEDGER, R, query, rounded, rsql

K = ["asset"]
P = ["asset", "pair"]

TM = """, half AS (SELECT *, row_number() OVER (PARTITION BY asset, pair ORDER BY d) AS i FROM ledger), tr AS (SELECT * FROM half WHERE i <= 504),
te AS (SELECT *, EXP(SUM(ret) OVER w) AS e, ABS(weight - LAG(weight) OVER w) AS dw, QUANTILE_CONT(ret, 0.05) OVER (PARTITION BY asset, pair) AS c5 FROM tr WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
td AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM te),
tm AS (SELECT asset, pair, COUNT(*) AS n, CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS sharpe, -MIN(dd) AS drawdown, ABS(STDDEV_SAMP(ret) * SQRT(252) - 0.1) AS vol_error,
-AVG(CASE WHEN ret <= c5 THEN ret END) AS tail_loss, COALESCE(AVG(dw), 0) AS turnover, AVG(CASE WHEN vol > 0 THEN LN(GREATEST(vol * vol / 252, 1e-12)) + r * r / GREATEST(vol * vol / 252, 1e-12) END) AS qlike FROM td GROUP BY 1, 2),
tr9 AS (SELECT asset, pair, n, ROUND(sharpe, 9) AS sharpe, ROUND(drawdown, 9) AS drawdown, ROUND(vol_error, 9) AS vol_error, ROUND(tail_loss, 9) AS tail_loss, ROUND(turnover, 9) AS turnover, ROUND(qlike, 9) AS qlike FROM tm)"""
TMC = ("sharpe", "drawdown", "vol_error", "tail_loss", "turnover", "qlike")


def train(s, d):
    led = V.ledger(s, d).withColumn("i", F.row_number().over(along(P, "d"))).where("i <= 504")
    t = K_.train_metrics(led, P, "d", "ret", "vol", "weight", "r", 0.10)
    return t.withColumns({c: F.round(c, 9) for c in TMC})


@query("a16_train_metrics", rsql(LEDGER + TM + ", q AS (SELECT * FROM tm)", *TMC, digits=6, keys="asset, pair, n"))
def a16(s, d):
    return rounded(train(s, d), 6)


@query("o1_train_ranking", f"WITH {LEDGER}{TM} SELECT asset, pair, CAST(row_number() OVER (PARTITION BY asset ORDER BY turnover, drawdown, -sharpe, vol_error, qlike NULLS FIRST, pair) AS INT) AS rank FROM tr9")
def o1(s, d):
    return O.ranked(train(s, d), K, O.train_order()).select("asset", "pair", "rank")


WINDOWS = (100, 60, 20)


def _wm_sql(n: int) -> str:
    return f"""SELECT asset, pair, d, {n} AS win, ROUND(CASE WHEN COUNT(ret) OVER w >= 2 AND STDDEV_SAMP(ret) OVER w > 0 THEN AVG(ret) OVER w / STDDEV_SAMP(ret) OVER w * SQRT(252) ELSE 0 END, 9) AS sharpe,
    ROUND(AVG(dw) OVER w, 9) AS turnover, ROUND(EXP(SUM(ret) OVER w) - 1, 9) AS ret FROM wd WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS {n - 1} PRECEDING)"""


def recent(s, d):
    w = along(P, "d")
    led = V.ledger(s, d).withColumn("dw", F.abs(F.col("weight") - F.lag("weight").over(w)))
    parts = []
    for n in WINDOWS:
        f = roll(w, n)
        sd = F.stddev_samp("ret").over(f)
        sh = F.when((F.count("ret").over(f) >= 2) & (sd > 0), F.avg("ret").over(f) / sd * 252**0.5).otherwise(0.0)
        parts.append(led.select("asset", "pair", "d", F.lit(n).alias("win"), F.round(sh, 9).alias("sharpe"), F.round(F.avg("dw").over(f), 9).alias("turnover"), F.round(F.exp(F.sum("ret").over(f)) - 1, 9).alias("ret")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RECENT = ", wd AS (SELECT *, ABS(weight - LAG(weight) OVER (PARTITION BY asset, pair ORDER BY d)) AS dw FROM ledger), rc AS (" + " UNION ALL ".join(_wm_sql(n) for n in WINDOWS) + ")"


@query("o2_recent_rankings", f"WITH {LEDGER}{RECENT} SELECT asset, pair, d, win, CAST(row_number() OVER (PARTITION BY asset, d, win ORDER BY -sharpe, turnover NULLS FIRST, pair) AS INT) AS rank FROM rc")
def o2(s, d):
    return O.ranked(recent(s, d), ["asset", "d", "win"], [-F.col("sharpe"), F.col("turnover"), F.col("pair")]).select("asset", "pair", "d", "win", "rank")


@query("o3_tie_band_ranking", f"WITH {LEDGER}{TM} SELECT asset, pair, CAST(row_number() OVER (PARTITION BY asset ORDER BY -FLOOR(sharpe / 0.05), drawdown, turnover, tail_loss, qlike NULLS FIRST, pair) AS INT) AS rank FROM tr9")
def o3(s, d):
    t = train(s, d).withColumns({"cvar": F.col("tail_loss"), "ret": -F.col("qlike")})
    return O.ranked(t, K, O.tie_band_order()).select("asset", "pair", "rank")


@query("o6_turnover_buckets", f"""WITH {LEDGER}{TM}, g AS (SELECT *, turnover - LAG(turnover) OVER w AS g FROM tr9 WINDOW w AS (PARTITION BY asset ORDER BY turnover, pair)),
h AS (SELECT *, GREATEST(COALESCE(AVG(CASE WHEN g > 0 THEN g END) OVER (PARTITION BY asset), 0), 0.0025) AS wd FROM g),
b AS (SELECT *, CAST(SUM(CASE WHEN g > wd THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY turnover, pair ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turnover_bucket FROM h)
SELECT asset, pair, turnover_bucket, CAST(row_number() OVER (PARTITION BY asset ORDER BY turnover_bucket, drawdown, -sharpe, pair) AS INT) AS rank FROM b""")  # fmt: skip
def o6(s, d):
    return O.turnover_buckets(train(s, d), K).select("asset", "pair", "turnover_bucket", "rank")


REG = MARKET + """, lr AS (SELECT l.*, m.market_regime AS regime FROM ledger l JOIN market m ON m.asset = l.asset AND m.d = l.d WHERE m.market_regime IS NOT NULL)"""


def labels(s, d):
    m = W.market_label(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 63)
    return m.where("market_regime IS NOT NULL").select("asset", "d", F.col("market_regime").alias("regime"))


@query("o7_best_by_regime", f"WITH {LEDGER}{REG}, v AS (SELECT asset, regime, pair, ROUND(AVG(ret) / STDDEV_SAMP(ret) * SQRT(252), 8) AS value FROM lr GROUP BY 1, 2, 3) SELECT asset, regime, pair, value FROM v QUALIFY row_number() OVER (PARTITION BY asset, regime ORDER BY value DESC, pair) = 1")
def o7(s, d):
    led = V.ledger(s, d).join(labels(s, d), ["asset", "d"])
    t = led.groupBy("asset", "regime", "pair").agg(F.round(M.sharpe(F.col("ret")), 8).alias("v"))
    return O.best_of(t, ["asset", "regime"], F.col("v"))


@query("o8_tolerance_cascade", f"""WITH {LEDGER}{TM}, a AS (SELECT * FROM tr9 QUALIFY turnover <= MIN(turnover) OVER (PARTITION BY asset) + 0.01), b AS (SELECT * FROM a QUALIFY drawdown <= MIN(drawdown) OVER (PARTITION BY asset) + 0.01)
SELECT asset, pair FROM b QUALIFY row_number() OVER (PARTITION BY asset ORDER BY -sharpe, pair) = 1""")
def o8(s, d):
    return O.tolerance_cascade(train(s, d), K, [("turnover", 0.01, True), ("drawdown", 0.01, True), ("sharpe", 0.0, False)]).select("asset", "pair")


@query("o9_o10_candidate_pool", f"""WITH {LEDGER}{TM}, a AS (SELECT asset, pair, row_number() OVER (PARTITION BY asset ORDER BY -sharpe, pair) AS s, row_number() OVER (PARTITION BY asset ORDER BY turnover, pair) AS t, row_number() OVER (PARTITION BY asset ORDER BY drawdown, pair) AS dd FROM tr9),
u AS (SELECT asset, pair, 'sharpe' AS k FROM a WHERE s <= 2 UNION ALL SELECT asset, pair, 'turnover' FROM a WHERE t <= 1 OR pair = 'rv60__clip' UNION ALL SELECT asset, pair, 'drawdown' FROM a WHERE dd <= 2)
SELECT asset, pair, string_agg(k, ',' ORDER BY k) AS sources FROM u GROUP BY 1, 2""")  # fmt: skip
def o9(s, d):
    t = train(s, d)
    top = lambda c, k, f=F.lit(False): O.top_with_forced(O.ranked(t, K, [c, F.col("pair")]), k, f)
    parts = {"sharpe": top(-F.col("sharpe"), 2), "turnover": top(F.col("turnover"), 1, F.col("pair") == "rv60__clip"), "drawdown": top(F.col("drawdown"), 2)}
    return O.pool(parts, K)


@query("o11_o13_pretest_top", f"""WITH {LEDGER}{TM}, x AS (SELECT asset, pair, ROUND(sharpe - 0.75 * drawdown - 0.05 * turnover - 0.15 * vol_error / 0.1, 7) AS score FROM tr9)
SELECT asset, pair, score, CAST(k AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY score DESC, pair) AS k FROM x) WHERE k <= 3""")
def o11(s, d):
    t = train(s, d)
    score = F.round(F.col("sharpe") - 0.75 * F.col("drawdown") - 0.05 * F.col("turnover") - 0.15 * F.col("vol_error") / 0.1, 7)
    return O.ranked(t.withColumn("score", score), K, [-F.col("score"), F.col("pair")]).where("rank <= 3").select("asset", "pair", "score", "rank")


SCORE = """, wq AS (SELECT asset, pair, d, obs, sharpe, turnover_n, vol_error, LAG(sharpe) OVER p AS ls, LAG(vol_error) OVER p AS lv FROM wm WINDOW p AS (PARTITION BY asset, pair ORDER BY d)),
sc AS (SELECT w.asset, w.pair, w.d, m.market_regime AS regime, ROUND(ls - lv + CASE WHEN m.market_regime = 'low' AND contains(w.pair, 'constant') THEN 0.2 ELSE 0 END, 6) AS score
FROM wq w JOIN market m ON m.asset = w.asset AND m.d = w.d WHERE m.market_regime IS NOT NULL AND ls IS NOT NULL AND lv IS NOT NULL)"""


def scores(s, d):
    return score_rows(s, d).drop("plain")


def score_rows(s, d):
    """Scores by pair and date, and plain: those without the regime's bias."""
    wm = M.window_metrics(V.ledger(s, d), P, "d", "ret", "weight", 0.1, 63)
    w = along(P, "d")
    wm = wm.withColumns({"ls": F.lag("sharpe").over(w), "lv": F.lag("vol_error").over(w)})
    rows = wm.join(labels(s, d), ["asset", "d"]).where("ls IS NOT NULL AND lv IS NOT NULL")
    none = s.createDataFrame([], "pair string, regime string, score double")
    rows = Q.regime_bias(rows, "pair", "regime", {"pair": none})
    zero = F.lit(0.0)
    score = lambda bias: F.round(Q.base_score(F.col("ls"), F.col("lv"), bias, zero, zero, F.lit(False)), 6)
    return rows.select("asset", "pair", "d", "regime", score(F.col("bias")).alias("score"), score(zero).alias("plain"))


@query("q1_q2_scores", f"WITH {LEDGER}{WM}{MARKET}{SCORE} SELECT asset, pair, d, regime, score + 0.0 AS score FROM sc")
def q1(s, d):
    return rounded(scores(s, d), 6)


PICK = """SELECT asset, d, i, s FROM (SELECT asset, d, MAP(list(pair ORDER BY pair), list(score ORDER BY pair)) AS s, row_number() OVER (PARTITION BY asset ORDER BY d) AS i FROM sc GROUP BY 1, 2)"""
BEST = "(list_sort(list_transform(map_entries(x.s), lambda e: {'v': -e.value, 'k': e.key})))[1].k"


@query("q3_sticky_selection", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}, mp AS ({PICK}), x AS (SELECT mp.*, {BEST.replace('x.s', 's')} AS best FROM mp),
f AS (SELECT asset, d, i, best AS selected, 0 AS since, FALSE AS switched FROM x WHERE i = 1 UNION ALL
SELECT x.asset, x.d, x.i, CASE WHEN sw THEN best ELSE selected END, CASE WHEN sw THEN 0 ELSE since + 1 END, sw FROM (SELECT x.asset, x.d, x.i, x.best, f.selected, f.since, x.best <> f.selected AND f.since + 1 >= 5 AND x.s[x.best] - COALESCE(x.s[f.selected], -1e300) > 0 AS sw FROM f JOIN x ON x.asset = f.asset AND x.i = f.i + 1) x)
SELECT asset, d, selected, switched FROM f""")  # fmt: skip
def q3(s, d):
    return selected(s, d).select("asset", "d", "selected", "switched")


def selected(s, d):
    return Q.sticky_argmax(Q.score_map(scores(s, d), K, "d", "pair", "score"), K, "d", 5)


@query("q4_q5_constraints", f"""WITH {LEDGER}{TM}, l AS (SELECT asset, QUANTILE_CONT(turnover, 0.8) AS qt, QUANTILE_CONT(drawdown, 0.8) AS qd, QUANTILE_CONT(vol_error, 0.8) AS qv FROM tr9 GROUP BY 1)
SELECT asset, pair, CASE WHEN NOT turnover <= qt THEN 'turnover' WHEN NOT drawdown <= qd THEN 'drawdown' WHEN NOT vol_error <= qv THEN 'vol_error' END AS blocked FROM tr9 JOIN l USING (asset)""")  # fmt: skip
def q4(s, d):
    t = train(s, d)
    cols = ("turnover", "drawdown", "vol_error")
    cut = t.groupBy("asset").agg(*[F.percentile(c, 0.8).alias(f"q_{c}") for c in cols])
    return Q.constrained(t.join(cut, "asset"), K, "pair", [(c, F.col(c) <= F.col(f"q_{c}")) for c in cols]).select("asset", "pair", "blocked")


@query("q6_mixture_of_experts", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}, e AS (SELECT *, EXP((score - MAX(score) OVER (PARTITION BY asset, d)) / 0.25) AS e FROM sc),
pr AS (SELECT asset, pair, d, e / SUM(e) OVER (PARTITION BY asset, d) AS prob, row_number() OVER (PARTITION BY asset, pair ORDER BY d) AS i FROM e),
f AS (SELECT asset, pair, d, i, prob, prob AS ema FROM pr WHERE i = 1 UNION ALL SELECT p.asset, p.pair, p.d, p.i, p.prob, 0.3 * p.prob + 0.7 * f.ema FROM f JOIN pr p ON p.asset = f.asset AND p.pair = f.pair AND p.i = f.i + 1)
SELECT asset, pair, d, ROUND(prob, 6) + 0.0 AS prob, ROUND(ema, 6) + 0.0 AS prob_ema FROM f""")  # fmt: skip
def q6(s, d):
    rows = Q.softmax(scores(s, d), ["asset", "d"], "score")
    return rounded(Q.smoothed_experts(rows.select("asset", "pair", "d", "prob"), K, "d", "pair").select("asset", "pair", "d", "prob", "prob_ema"), 6)


@query("q7_contextual_bandit")
def q7(s, d):
    led = V.ledger(s, d)
    rewards = led.groupBy("asset", "d").agg(F.map_from_entries(F.collect_list(F.struct("pair", "ret"))).alias("rewards"))
    m = W.market_label(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 63).where("market_vol IS NOT NULL")
    rows = m.select("asset", "d", "market_vol", "market_mean", "market_skew").join(rewards, ["asset", "d"])
    arms = [f"{e}__{c}" for e in V.ESTIMATORS for c in V.CONTROLLERS]
    return rounded(Q.lin_ucb(rows, K, "d", ["market_vol", "market_mean", "market_skew"], "rewards", arms).select("asset", "d", "arm", "reward"))


BLOCKS = (10, 63, 126)


def _block_sql(n: int) -> str:
    return f""", te{n} AS (SELECT asset, pair, d, ret, EXP(SUM(ret) OVER w) AS e, QUANTILE_CONT(ret, 0.05) OVER (PARTITION BY asset, pair) AS c5 FROM trk WHERE k <= {n} WINDOW w AS (PARTITION BY asset, pair ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
td{n} AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM te{n}), b{n} AS (SELECT asset, pair, ROUND(CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END, 9) AS s{n}, ROUND(-MIN(dd), 9) AS d{n}, ROUND(-AVG(CASE WHEN ret <= c5 THEN ret END), 9) AS c{n} FROM td{n} GROUP BY 1, 2)"""


CANDIDATES = ", trk AS (SELECT *, row_number() OVER (PARTITION BY asset, pair ORDER BY d DESC) AS k FROM half WHERE i <= 504)" + "".join(map(_block_sql, BLOCKS)) + """,
cb AS (SELECT t.asset, t.pair, 0.55 * sharpe + 0.15 * (s10 + s63 + s126) AS sh, (ABS(d10) + ABS(d63) + ABS(d126)) / 3 AS md, ABS(d10) AS x, ABS(d63) AS y, ABS(d126) AS z, GREATEST(ABS(drawdown), (ABS(d10) + ABS(d63) + ABS(d126)) / 3) AS dd, GREATEST(ABS(tail_loss), (ABS(c10) + ABS(c63) + ABS(c126)) / 3) AS cv FROM tr9 t JOIN b10 USING (asset, pair) JOIN b63 USING (asset, pair) JOIN b126 USING (asset, pair)),
cs AS (SELECT asset, pair, ROUND(1.0 * sh - 3.5 * dd - 2.0 * cv - 1.25 * (SQRT(((x - md) * (x - md) + (y - md) * (y - md) + (z - md) * (z - md)) / 3) + ABS(md - 0.06) + GREATEST(x - 0.10, y - 0.10, z - 0.10, 0)), 6) AS score FROM cb)"""


def candidates(s, d):
    """Scores of the train windows, each with blocks of their last rows."""
    led = V.ledger(s, d).withColumn("i", F.row_number().over(along(P, "d"))).where("i <= 504")
    led = led.withColumn("k", F.row_number().over(Window.partitionBy(*P).orderBy(F.desc("d"))))
    t = train(s, d)
    for n in BLOCKS:
        b = K_.train_metrics(led.where(F.col("k") <= n), P, "d", "ret", "vol", "weight", "r", 0.10)
        t = t.join(b.select(*P, *[F.round(c, 9).alias(f"{c}_{n}") for c in ("sharpe", "drawdown", "tail_loss")]), P)
    blocks = [tuple(F.col(f"{c}_{n}") for c in ("sharpe", "drawdown", "tail_loss")) for n in BLOCKS]
    return t.withColumn("score", F.round(Q.candidate_score(F.col("sharpe"), F.col("drawdown"), F.col("tail_loss"), blocks), 6))


@query("q8_q11_candidate_choice", f"WITH {LEDGER}{TM}{CANDIDATES} SELECT asset, pair, score AS value FROM cs QUALIFY row_number() OVER (PARTITION BY asset ORDER BY score DESC, pair) = 1")
def q8(s, d):
    return O.best_of(candidates(s, d), K, F.col("score"))


NEXT = "(list_sort(list_transform(list_filter(map_entries(x.s), lambda e: e.key <> f.active), lambda e: {'v': -e.value, 'k': e.key})))[1].k"
REVIEWS = """, dl AS (SELECT asset, pair, d, equity / MAX(equity) OVER (PARTITION BY asset, pair ORDER BY d ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ledger),
mp AS (SELECT sc.asset, sc.d, MAP(list(sc.pair ORDER BY sc.pair), list(score ORDER BY sc.pair)) AS s, MAP(list(sc.pair ORDER BY sc.pair), list(ROUND(dd, 8) ORDER BY sc.pair)) AS dd, MIN(regime) AS regime, row_number() OVER (PARTITION BY sc.asset ORDER BY sc.d) AS i FROM sc JOIN dl ON dl.asset = sc.asset AND dl.pair = sc.pair AND dl.d = sc.d GROUP BY 1, 2),
rv AS (SELECT *, regime <> LAG(regime) OVER (PARTITION BY asset ORDER BY d) AS changed FROM mp)"""


def reviews(s, d):
    """asset, d, scores, drawdowns, changed: one row a date."""
    led = V.ledger(s, d)
    dd = led.select(*P, "d", F.round(F.col("equity") / F.max("equity").over(cum(along(P, "d"))) - 1, 8).alias("dd"))
    pairs = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", c))))
    rows = scores(s, d).join(dd, [*P, "d"]).groupBy("asset", "d").agg(pairs("score").alias("scores"), pairs("dd").alias("drawdowns"), F.min("regime").alias("regime"))
    return rows.withColumn("changed", F.col("regime") != F.lag("regime").over(along(K, "d")))


@query("q9_rule_switches", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}{REVIEWS},
f AS (SELECT asset, d, i, {BEST.replace('x.s', 's')} AS active, {BEST.replace('x.s', 's')} AS best, 0 AS since, FALSE AS switched FROM rv WHERE i = 1 UNION ALL
SELECT asset, d, i, CASE WHEN sw THEN best ELSE active END, best, CASE WHEN sw THEN 0 ELSE since + 1 END, sw FROM (SELECT *, since + 1 >= 30 AND (lead >= 0.12 OR fell AND lead >= 0.08 OR COALESCE(changed, FALSE) AND lead >= 0.10) AS sw FROM (
SELECT asset, d, i, active, since, changed, best, s[best] - COALESCE(s[active], -1e300) AS lead, ABS(COALESCE(dd[active], 0)) > 0.16 AS fell FROM (SELECT x.asset, x.d, x.i, x.s, x.dd, x.changed, f.active, f.since, {NEXT} AS best FROM f JOIN rv x ON x.asset = f.asset AND x.i = f.i + 1))))
SELECT asset, d, active, best, switched FROM f""")  # fmt: skip
def q9(s, d):
    return Q.rule_switches(reviews(s, d), K, "d", "very_low", 30)


ALT = "(list_sort(list_transform(list_filter(map_entries(x.s), lambda e: e.key <> x.best AND e.value >= x.s[x.best] - 0.05), lambda e: {'v': -e.value, 'k': e.key})))[1].k"


@query("q18_diversity_guard", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}, mp AS ({PICK}), x AS (SELECT mp.*, {BEST.replace('x.s', 's')} AS best FROM mp),
f AS (SELECT asset, d, i, best AS selected, best AS picked, 1 AS run FROM x WHERE i = 1 UNION ALL
SELECT asset, d, i, best, pick, CASE WHEN pick = last THEN run + 1 ELSE 1 END FROM (SELECT x.asset, x.d, x.i, x.best, f.picked AS last, f.run, CASE WHEN x.best = f.picked AND f.run >= 3 THEN COALESCE({ALT}, x.best) ELSE x.best END AS pick FROM f JOIN x ON x.asset = f.asset AND x.i = f.i + 1))
SELECT asset, d, selected, picked FROM f""")  # fmt: skip
def q18(s, d):
    rows = Q.score_map(scores(s, d), K, "d", "pair", "score")
    best = F.get(F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(0))["k"]
    return Q.diversified_picks(rows.withColumn("selected", best), K, "d")


@query("a30_selected_days", f"""WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}, mp AS ({PICK}), x AS (SELECT mp.*, {BEST.replace('x.s', 's')} AS best FROM mp),
f AS (SELECT asset, d, i, best AS selected, 0 AS since FROM x WHERE i = 1 UNION ALL
SELECT x.asset, x.d, x.i, CASE WHEN sw THEN best ELSE selected END, CASE WHEN sw THEN 0 ELSE since + 1 END FROM (SELECT x.asset, x.d, x.i, x.best, f.selected, f.since, x.best <> f.selected AND f.since + 1 >= 5 AND x.s[x.best] - COALESCE(x.s[f.selected], -1e300) > 0 AS sw FROM f JOIN x ON x.asset = f.asset AND x.i = f.i + 1) x)
SELECT asset, selected AS pair, COUNT(*) AS days FROM f GROUP BY 1, 2""")  # fmt: skip
def a30(s, d):
    return selected(s, d).groupBy("asset", F.col("selected").alias("pair")).agg(F.count("*").alias("days"))


@query("o12_calibrated_rank", f"""WITH {LEDGER}{TM}, x AS (SELECT asset, pair, vol_error, ROUND(vol_error + 0.5 * ABS(drawdown) + 0.02 * turnover - 0.05 * sharpe, 7) AS rank_score FROM tr9)
SELECT asset, pair, rank_score + 0.0 AS rank_score, CAST(row_number() OVER (PARTITION BY asset ORDER BY vol_error, rank_score, pair) AS INT) AS rank FROM x""")
def o12(s, d):
    t = train(s, d).withColumn("rank_score", F.round(O.calibrated_score(F.col("vol_error"), F.col("drawdown"), F.col("turnover"), F.col("sharpe")), 7) + F.lit(0.0))
    return O.ranked(t, K, [F.col("vol_error"), F.col("rank_score"), F.col("pair")]).select("asset", "pair", "rank_score", "rank")


@query("q13_versus_benchmark", rsql(LEDGER + PERF + """, b AS (SELECT asset, sharpe, max_drawdown FROM perf WHERE pair = 'rv20__constant'), q AS (SELECT p.asset, p.pair, p.sharpe - b.sharpe AS sharpe_delta, ROUND(p.sharpe - b.sharpe, 9) > 0 AS sharpe_better, p.max_drawdown - b.max_drawdown AS max_drawdown_delta FROM perf p JOIN b ON b.asset = p.asset)""", "sharpe_delta", "max_drawdown_delta", digits=6, keys="asset, pair, sharpe_better"))
def q13(s, d):
    p = M.performance(V.ledger(s, d), P, "d", "ret").withColumns({"sharpe": F.round("sharpe", 10), "max_drawdown": F.round("max_drawdown", 10)})
    out = Q.versus(p, p.where("pair = 'rv20__constant'"), K, {"sharpe": True, "max_drawdown": False})
    return rounded(out.select("asset", "pair", "sharpe_delta", (F.round("sharpe_delta", 9) > 0).alias("sharpe_better"), "max_drawdown_delta"), 6)


@query("q16_event_triggers", f"""WITH RECURSIVE {R}, z AS (SELECT asset, d, rn, CASE WHEN COUNT(r) OVER w >= 20 AND STDDEV_SAMP(r) OVER w > 0 THEN (r - AVG(r) OVER w) / STDDEV_SAMP(r) OVER w END AS z, r, LAG(r) OVER (PARTITION BY asset ORDER BY d) AS p FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 59 PRECEDING)),
t AS (SELECT asset, d, rn, concat_ws('+', CASE WHEN ABS(z) >= 1.5 THEN 'z' END, CASE WHEN ABS(r - p) > 0.01 THEN 'change' END) AS reason FROM z),
f AS (SELECT asset, d, rn, reason, reason <> '' AS fired, CASE WHEN reason <> '' THEN 1 ELSE -1000 END AS last FROM t WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, n.reason, n.reason <> '' AND n.rn - f.last >= 10, CASE WHEN n.reason <> '' AND n.rn - f.last >= 10 THEN n.rn ELSE f.last END FROM f JOIN t n ON n.asset = f.asset AND n.rn = f.rn + 1)
SELECT asset, d, reason, fired FROM f""")  # fmt: skip
def q16(s, d):
    from ..operators.regimes import change_point

    rows = change_point(V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r"), K, "d", "r", 60, 20)
    jump = F.abs(F.col("r") - F.lag("r").over(along(K, "d"))) > 0.01
    rows = rows.withColumn("reason", Q.event_reason([("z", F.abs("z") >= 1.5), ("change", jump)]))
    return Q.spaced_events(rows.select("asset", "d", "reason"), K, "d", "reason")


@query("q19_payloads")
def q19(s, d):
    t = train(s, d).select("asset", "pair", F.round("sharpe", 4).alias("sharpe"), F.round("drawdown", 4).alias("drawdown"))
    return Q.payload(t, K, ["pair", "sharpe", "drawdown"])


STICKY = f"""{SCORE}, mp AS ({PICK}), x AS (SELECT mp.*, {BEST.replace('x.s', 's')} AS best FROM mp),
f AS (SELECT asset, d, i, best AS selected, 0 AS since, FALSE AS switched FROM x WHERE i = 1 UNION ALL
SELECT x.asset, x.d, x.i, CASE WHEN sw THEN best ELSE selected END, CASE WHEN sw THEN 0 ELSE since + 1 END, sw FROM (SELECT x.asset, x.d, x.i, x.best, f.selected, f.since, x.best <> f.selected AND f.since + 1 >= 5 AND x.s[x.best] - COALESCE(x.s[f.selected], -1e300) > 0 AS sw FROM f JOIN x ON x.asset = f.asset AND x.i = f.i + 1) x)"""
#: A selection f (asset, d, selected) booked with a lag of one row, and a cost on the rows of a switch.
BOOKED = """, lg AS (SELECT asset, d, LAG(selected) OVER (PARTITION BY asset ORDER BY d) AS pair FROM f), bk AS (SELECT lg.asset, lg.d, lg.pair, l.ret, COALESCE(LAG(lg.pair) OVER (PARTITION BY lg.asset ORDER BY lg.d) <> lg.pair, FALSE) AS switched FROM lg JOIN ledger l ON l.asset = lg.asset AND l.d = lg.d AND l.pair = lg.pair),
q AS (SELECT asset, d, pair, switched, ret - CASE WHEN switched THEN 0.0005 ELSE 0 END AS ret, EXP(SUM(ret - CASE WHEN switched THEN 0.0005 ELSE 0 END) OVER (PARTITION BY asset ORDER BY d)) AS equity FROM bk)"""


@query("q22_q25_routed_ledger", rsql("RECURSIVE " + LEDGER + WM + MARKET + STICKY + BOOKED, "ret", "equity", digits=6, keys="asset, d, pair, switched"))
def q22(s, d):
    return rounded(Q.routed_ledger(selected(s, d), V.ledger(s, d), K, "d").select("asset", "d", "pair", "switched", "ret", "equity"), 6)


@query("q25_replay", rsql(LEDGER + """, sw AS (SELECT asset, CAST(DATE_TRUNC('quarter', d) AS DATE) AS d, CASE WHEN QUARTER(d) % 2 = 0 THEN 'rv20__clip' ELSE 'rv60__constant' END AS pair FROM ledger GROUP BY ALL),
dd AS (SELECT DISTINCT asset, d FROM ledger), a AS (SELECT dd.asset, dd.d, sw.pair FROM dd ASOF LEFT JOIN sw ON sw.asset = dd.asset AND dd.d >= sw.d), q AS (SELECT a.asset, a.d, a.pair, l.ret FROM a JOIN ledger l ON l.asset = a.asset AND l.d = a.d AND l.pair = a.pair)""", "ret", keys="asset, d, pair"))  # fmt: skip
def q25(s, d):
    led = V.ledger(s, d)
    sw = led.select("asset", F.to_date(F.date_trunc("quarter", "d")).alias("d")).distinct().withColumn("pair", F.when(F.quarter("d") % 2 == 0, "rv20__clip").otherwise("rv60__constant"))
    return rounded(Q.replay(led, sw, led, K, "d").select("asset", "d", "pair", "ret"))


@query("a26_switch_stats", f"""WITH {LEDGER}, b AS (SELECT asset, CAST(DATE_TRUNC('month', d) AS DATE) AS m, pair, ROUND(SUM(ret), 12) AS ret FROM ledger GROUP BY ALL), c AS (SELECT asset, m, pair AS pick FROM b QUALIFY row_number() OVER (PARTITION BY asset, m ORDER BY ret DESC, pair) = 1),
s AS (SELECT *, CASE WHEN LAG(pick) OVER w <> pick THEN 1 ELSE 0 END AS s, row_number() OVER (PARTITION BY asset ORDER BY m DESC) AS k FROM c WINDOW w AS (PARTITION BY asset ORDER BY m)),
t AS (SELECT asset, MAX(k) AS top FROM (SELECT asset, pick, COUNT(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT asset, COUNT(*) AS n, CAST(SUM(s) AS BIGINT) AS switches, COUNT(DISTINCT pick) AS pairs, CAST(SUM(CASE WHEN k <= 12 THEN s ELSE 0 END) AS BIGINT) AS recent_switches, ROUND(SUM(s) / COUNT(*), 8) AS switch_rate, ROUND(FIRST(top) / COUNT(*), 8) AS top_share FROM s JOIN t USING (asset) GROUP BY 1""")  # fmt: skip
def a26(s, d):
    m = V.ledger(s, d).groupBy("asset", F.to_date(F.date_trunc("month", "d")).alias("m"), "pair").agg(F.round(F.sum("ret"), 12).alias("ret"))
    pick = O.best_of(m, ["asset", "m"], F.col("ret")).select("asset", "m", F.col("pair").alias("pick"))
    return rounded(M.switch_stats(pick, K, "m", "pick", 12))


SPLIT = """, sp0 AS (SELECT *, row_number() OVER (PARTITION BY asset, pair ORDER BY d) - 1 AS i, COUNT(*) OVER (PARTITION BY asset, pair) AS cnt FROM ledger),
sp AS (SELECT s.*, CAST(k AS INT) AS split, CASE WHEN i < k * 126 + 504 THEN 'train' ELSE 'test' END AS role FROM sp0 s, LATERAL unnest(range(CAST(FLOOR((cnt - 505) / 126) AS BIGINT) + 1)) AS u(k) WHERE i >= k * 126 AND i < k * 126 + 630)"""


@query("k1_walk_forward_splits", f"WITH {LEDGER}{SPLIT} SELECT asset, pair, split, role, COUNT(*) AS n, MIN(d) AS first, MAX(d) AS last FROM sp GROUP BY 1, 2, 3, 4")
def k1(s, d):
    rows = K_.splits(V.ledger(s, d), P, "d")
    return rows.groupBy("asset", "pair", "split", "role").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


TM2 = TM.replace("half AS (SELECT *, row_number() OVER (PARTITION BY asset, pair ORDER BY d) AS i FROM ledger), tr AS (SELECT * FROM half WHERE i <= 504)", "tr AS (SELECT * FROM sp WHERE role = 'train')").replace("asset, pair", "asset, split, pair")
TM2 = TM2.replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
CHAMP = TM2 + """, ch AS (SELECT asset, split, pair, ROUND(sharpe - 0.5 * drawdown - 0.5 * turnover - 0.5 * vol_error - COALESCE(qlike, 0), 9) AS value FROM tm),
best AS (SELECT * FROM ch QUALIFY row_number() OVER (PARTITION BY asset, split ORDER BY value DESC, pair) = 1)"""


@query("k2_champions", f"WITH {LEDGER}{SPLIT}{CHAMP} SELECT asset, split, pair, ROUND(value, 6) + 0.0 AS value FROM best")
def k2(s, d):
    return rounded(K_.walk_forward(V.ledger(s, d), K, "d")[0], 6)


@query("k3_a25_walk_forward_oos", rsql(LEDGER + SPLIT + CHAMP + """, oo AS (SELECT sp.asset, sp.split, sp.d, sp.ret, sp.r FROM sp JOIN best USING (asset, split, pair) WHERE role = 'test'),
q AS (SELECT asset, split, COUNT(*) AS n, CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END AS sharpe, AVG(r) / STDDEV_SAMP(r) * SQRT(252) AS bh_sharpe FROM oo GROUP BY 1, 2)""", "sharpe", "bh_sharpe", digits=6, keys="asset, split, n"))  # fmt: skip
def k3(s, d):
    rows = K_.walk_forward(V.ledger(s, d), K, "d")[1]
    return rounded(K_.oos_summary(rows, ["asset", "split"], "d").select("asset", "split", "n", "sharpe", "bh_sharpe"), 6)


@query("k5_regime_mix")
def k5(s, d):
    return K_.regime_mix(V.ledger(s, d), labels(s, d), K, "d")
