"""Queries of the gated switch rule with its ablations, of portfolio routing, soft ensembles and the full bandit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import qlike
from ..functions.frames import along, roll
from ..operators import covariance as C
from ..operators import ensemble as T
from ..operators import forecast as E
from ..operators import metrics as M
from ..operators import portfolio as B
from ..operators import regimes as R_
from ..operators import routing as Q
from ..operators import windows as W
from ..sources import views as V
from ..sources.series import settled
from .core import MARKET, WM
from .models import MODELS, models, rets
from .more import FRAME_DD
from .registry import LEDGER, R, query, rounded, rsql
from .reviews import _challenger_sql, review_ranks
from .routes import BEST, NEXT, REVIEWS, SCORE, WINDOWS, reviews, score_rows
from .tuned import M0, P as BOOK, TARGET, books

K = ["asset"]
STEP = 21
CONFIGS = {
    "full": Q.Switching(), "high": Q.Switching("high"), "low": Q.Switching("low"), "no_regime": Q.Switching(regime=False), "no_ranks": Q.Switching("high", ranks=False),
    "no_baseline": Q.Switching(without="rv20__constant"), "selection": Q.Switching(selects=True),
}
#: Windows of the gates, shortest first.
GATES = tuple(f"w{n}" for n in sorted(WINDOWS))


def gate_rows(s, d):
    """asset, d, scores, plain, drawdowns, changed and a map of ranks and metrics per window, on the first of a month."""
    marks = review_ranks(s, d)
    one = lambda n: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("win") == n, F.struct("pair", F.struct("rank", "sharpe", "ann", "drawdown"))))))
    marks = marks.groupBy("asset", "d").agg(*[one(n).alias(f"w{n}") for n in WINDOWS])
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "plain")))).alias("plain")
    rows = reviews(s, d).join(score_rows(s, d).groupBy("asset", "d").agg(pairs), ["asset", "d"]).join(marks, ["asset", "d"])
    return rows.withColumn("changed", F.coalesce(F.col("regime") != F.lag("regime").over(along(K, "d")), F.lit(False)))


def _settings() -> str:
    from ..operators.reviews import GROUP

    out = []
    for name, c in CONFIGS.items():
        gap, deep, deep_gap, new_gap = Q.SWITCH[c.sensitivity]
        group, hold = GROUP[c.sensitivity]
        out.append(f"('{name}', {gap}, {deep}, {deep_gap}, {'NULL::DOUBLE' if new_gap is None else new_gap}, {hold}, {group}, {c.sensitivity in ('high', 'very_high')}, {c.regime}, {c.ranks}, {c.selects}, {repr(c.without) if c.without else 'NULL'})")
    return f"(VALUES {', '.join(out)}) AS c(config, gap, deep, deep_gap, new_gap, hold, grp, quick, reg, ranks, sel, without)"


_OTHERS = "list_filter(map_keys(s), lambda p: p <> active)"
_SHORT = f"len(list_filter({_OTHERS}, lambda p: {GATES[0]}[p] IS NOT NULL AND ({GATES[0]}[p].sharpe > COALESCE({GATES[0]}[active].sharpe, 0) OR {GATES[0]}[p].sharpe >= COALESCE({GATES[0]}[active].sharpe, 0) AND {GATES[0]}[p].ann > COALESCE({GATES[0]}[active].ann, 0))))"
_BEATS = " + ".join(f"CASE WHEN {w}[p].k < {w}[active].k AND ({w}[p].sharpe >= {w}[active].sharpe OR {w}[p].drawdown <= {w}[active].drawdown) THEN 1 ELSE 0 END" for w in GATES)
_MAPS = ", ".join(f"MAP(list(pair ORDER BY pair) FILTER (win = {w[1:]}), list({{'k': k, 'sharpe': sharpe, 'ann': ann, 'drawdown': drawdown}} ORDER BY pair) FILTER (win = {w[1:]})) AS {w}" for w in GATES)
SWITCHED = f"""{REVIEWS}, rl AS ({' UNION ALL '.join(map(_challenger_sql, WINDOWS))}),
r1 AS (SELECT asset, pair, d, win, ROUND(CASE WHEN n >= 2 AND sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sharpe, ROUND(m * 252, 8) AS ann, ROUND(ABS({FRAME_DD}), 8) AS drawdown, ROUND(turnover, 8) AS turnover FROM rl WHERE DAY(d) = 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY asset, d, win ORDER BY -sharpe, turnover NULLS FIRST, pair) AS k FROM r1), gm AS (SELECT asset, d, {_MAPS} FROM rk GROUP BY 1, 2),
pm AS (SELECT wq.asset, wq.d, MAP(list(wq.pair ORDER BY wq.pair), list(ROUND(ls - lv, 6) ORDER BY wq.pair)) AS plain FROM wq JOIN sc USING (asset, pair, d) GROUP BY 1, 2),
gr AS (SELECT mp.asset, mp.d, mp.s, pm.plain, mp.dd, gm.* EXCLUDE (asset, d), COALESCE(mp.regime <> LAG(mp.regime) OVER (PARTITION BY mp.asset ORDER BY mp.d), FALSE) AS changed, row_number() OVER (PARTITION BY mp.asset ORDER BY mp.d) AS i FROM mp JOIN gm USING (asset, d) JOIN pm USING (asset, d)),
x AS (SELECT c.*, gr.* EXCLUDE (s, plain, changed), gr.changed AND reg AS changed, map_from_entries(list_filter(map_entries(CASE WHEN reg THEN gr.s ELSE gr.plain END), lambda e: without IS NULL OR e.key <> without)) AS s FROM gr, {_settings()}),
f AS (SELECT config, asset, d, i, {BEST} AS active, {BEST} AS best, 0 AS since, FALSE AS switched, NULL::VARCHAR AS reason FROM x WHERE i = 1 UNION ALL
SELECT config, asset, d, i, CASE WHEN why IS NOT NULL THEN best ELSE active END, best, CASE WHEN why IS NOT NULL THEN 0 ELSE since END, why IS NOT NULL, why FROM (
SELECT *, CASE WHEN best IS NULL THEN NULL WHEN sel THEN CASE WHEN best <> active THEN 'selection' END WHEN ranks AND quick AND short_n >= 1 THEN 'short_term' WHEN since < hold AND many < grp THEN NULL
WHEN changed AND (new_gap IS NULL OR lead >= new_gap) THEN 'regime' WHEN lead >= gap THEN 'score' WHEN fell AND lead >= deep_gap THEN 'drawdown' END AS why FROM (
SELECT *, s[best] - COALESCE(s[active], -1e300) AS lead, ABS(COALESCE(dd[active], 0)) > deep AS fell, {_SHORT} AS short_n, CASE WHEN ranks THEN len(list_filter({_OTHERS}, lambda p: {_BEATS} >= 2)) ELSE 0 END AS many FROM (
SELECT x.*, f.active, f.since + {STEP} AS since, CASE WHEN x.sel THEN {BEST} ELSE {NEXT} END AS best FROM f JOIN x ON x.config = f.config AND x.asset = f.asset AND x.i = f.i + 1))))"""


@query("q9_k7_gated_switches", f"WITH RECURSIVE {LEDGER}{WM}{MARKET}{SCORE}{SWITCHED} SELECT config, asset, d, active, best, switched, reason FROM f")
def q9(s, d):
    """Seven configurations of the switch rule, gates and ablations, in one pass over the monthly reviews."""
    return Q.gated_switches(gate_rows(s, d), K, "d", CONFIGS, GATES, GATES[0], STEP)


# --- Portfolio routing


ROUTES = {"quick": 5, "slow": 63}
PORTFOLIOS = M0.replace(", q AS (SELECT portfolio, d, asset, weight FROM tw)", "") + """, pw AS (SELECT bk.portfolio, bk.d, bk.asset, bk.r, COALESCE(tw.weight, 0) AS weight FROM bk LEFT JOIN tw USING (portfolio, d, asset)),
px2 AS (SELECT *, ABS(weight - COALESCE(LAG(weight) OVER a, 0)) AS dw, COALESCE(LAG(weight) OVER a * r, 0) AS gain FROM pw WINDOW a AS (PARTITION BY portfolio, asset ORDER BY d)), py AS (SELECT portfolio, d, SUM(dw) AS turnover, SUM(gain) AS gain FROM px2 GROUP BY 1, 2),
pz AS (SELECT portfolio, d, gain - COALESCE(LAG(turnover * 0.0005) OVER (PARTITION BY portfolio ORDER BY d), 0) AS ret FROM py),
ps AS (SELECT portfolio, d, CASE WHEN COUNT(ret) OVER w >= 63 AND STDDEV_SAMP(ret) OVER w > 0 THEN ROUND(AVG(ret) OVER w / STDDEV_SAMP(ret) OVER w * SQRT(252), 6) END AS score FROM pz WINDOW w AS (PARTITION BY portfolio ORDER BY d ROWS 62 PRECEDING)),
mp AS (SELECT d, MAP(list(portfolio ORDER BY portfolio), list(score ORDER BY portfolio)) AS s, row_number() OVER (ORDER BY d) AS i FROM ps WHERE score IS NOT NULL GROUP BY 1), x AS (SELECT route, sticky, mp.* FROM mp, (VALUES ('quick', 5), ('slow', 63)) AS t(route, sticky)),
f AS (SELECT route, d, i, """ + BEST + """ AS selected, 0 AS since FROM x WHERE i = 1 UNION ALL SELECT route, d, i, CASE WHEN sw THEN best ELSE selected END, CASE WHEN sw THEN 0 ELSE since + 1 END FROM (
SELECT x.route, x.d, x.i, f.selected, f.since, """ + BEST + """ AS best, """ + BEST + """ <> f.selected AND f.since + 1 >= x.sticky AND x.s[""" + BEST + """] - COALESCE(x.s[f.selected], -1e300) > 0 AS sw FROM f JOIN x ON x.route = f.route AND x.i = f.i + 1)),
lg AS (SELECT route, d, LAG(selected) OVER (PARTITION BY route ORDER BY d) AS portfolio FROM f), rw AS (SELECT lg.route, lg.d, lg.portfolio, tw.asset, tw.weight FROM lg JOIN tw ON tw.portfolio = lg.portfolio AND tw.d = lg.d),
ra AS (SELECT rt.route, bk.d, bk.asset, bk.r, COALESCE(rw.weight, 0) AS weight FROM bk, (VALUES ('quick'), ('slow')) AS rt(route) LEFT JOIN rw ON rw.route = rt.route AND rw.d = bk.d AND rw.asset = bk.asset WHERE bk.portfolio = 'all'),
rb AS (SELECT *, ABS(weight - COALESCE(LAG(weight) OVER a, 0)) AS dw, COALESCE(LAG(weight) OVER a * r, 0) AS gain FROM ra WINDOW a AS (PARTITION BY route, asset ORDER BY d)), rc AS (SELECT route, d, SUM(ABS(weight)) AS gross, SUM(dw) AS turnover, SUM(gain) AS gain FROM rb GROUP BY 1, 2),
rd AS (SELECT *, gain - COALESCE(LAG(turnover * 0.0005) OVER (PARTITION BY route ORDER BY d), 0) AS ret FROM rc), pf2 AS (SELECT DISTINCT route, d, portfolio FROM rw),
q AS (SELECT rd.route, rd.d, pf2.portfolio, gross, turnover, ret, EXP(SUM(ret) OVER (PARTITION BY rd.route ORDER BY rd.d)) AS equity FROM rd LEFT JOIN pf2 ON pf2.route = rd.route AND pf2.d = rd.d)"""


def book_weights(s, d):
    """books(), and both portfolios' target weights."""
    rows = settled(books(s, d), "books")
    cov = settled(C.sample(C.pair_panel(rows, "asset", "d", "r", BOOK), "d", keys=BOOK).where("cov IS NOT NULL").select(*BOOK, "d", "i", "j", "cov"), "cov")
    w = B.capped_by_room(B.inverse_vol(cov, "d", BOOK).select(*BOOK, "d", "asset", "weight"), "d", 0.35, BOOK)
    return rows, settled(B.to_target(w, cov, "d", TARGET, 1.5, BOOK).select(*BOOK, "d", "asset", "weight"), "weights")


@query("q22_portfolio_routing", rsql("RECURSIVE " + PORTFOLIOS, "gross", "turnover", "ret", "equity", digits=7, keys="route, d, portfolio"))
def q22(s, d):
    """Two routes between two portfolios that share assets: by trailing Sharpe, kept 5 or 63 rows; a switch trades weights."""
    rows, weights = book_weights(s, d)
    own = B.portfolio_ledger(weights, rows, "d", keys=BOOK)
    f = roll(along(BOOK, "d"), 63)
    sharpe = F.when((F.count("ret").over(f) >= 63) & (F.stddev_samp("ret").over(f) > 0), F.round(F.avg("ret").over(f) / F.stddev_samp("ret").over(f) * 252**0.5, 6))
    scored = settled(Q.score_map(own.select(*BOOK, "d", sharpe.alias("score")).where("score IS NOT NULL"), [], "d", "portfolio", "score"), "scores")
    picks = None
    for route, sticky in ROUTES.items():
        one = Q.sticky_argmax(scored.withColumn("route", F.lit(route)), ["route"], "d", sticky)
        picks = one if picks is None else picks.unionByName(one)
    held = settled(Q.routed_weights(picks, weights, ["route"], "d"), "held")
    market = rows.where("portfolio = 'all'").select("d", "asset", "r").withColumn("route", F.explode(F.array(*map(F.lit, ROUTES))))
    led = B.portfolio_ledger(held, market, "d", keys=["route"])
    names = held.select("route", "d", "portfolio").distinct()
    return rounded(led.join(names, ["route", "d"], "left").select("route", "d", "portfolio", "gross", "turnover", "ret", "equity"), 7)


# --- Soft states


HMM = R + """, hm AS (SELECT asset, d, rn, r, (0.5 * (EXP(-0.5 * POWER(r / 0.008, 2)) / 0.008)) / (0.5 * (EXP(-0.5 * POWER(r / 0.008, 2)) / 0.008) + 0.5 * (EXP(-0.5 * POWER(r / 0.004, 2)) / 0.004)) AS p FROM rr WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, n.r, ((f.p * 0.97 + (1 - f.p) * 0.03) * (EXP(-0.5 * POWER(n.r / 0.008, 2)) / 0.008)) / ((f.p * 0.97 + (1 - f.p) * 0.03) * (EXP(-0.5 * POWER(n.r / 0.008, 2)) / 0.008) + (1 - (f.p * 0.97 + (1 - f.p) * 0.03)) * (EXP(-0.5 * POWER(n.r / 0.004, 2)) / 0.004))
FROM hm f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1), pr AS (SELECT asset, d, rn, r, LAG(p) OVER (PARTITION BY asset ORDER BY d) AS p FROM hm)"""


def stress_before(s, d):
    """asset, d, r, p: the filtered probability of stress as of the row before."""
    out = R_.hmm_filter(rets(s, d), K, "d", "r", (0.0, 0.0), (0.004, 0.008))
    return out.select("asset", "d", "r", F.lag("p_stress").over(along(K, "d")).alias("p"))


@query("t4_soft_regimes", rsql("RECURSIVE " + LEDGER + ", " + HMM.removeprefix(R + ", ") + ", " + MODELS + """, w(regime, model, w) AS (VALUES ('calm', 'rv20', 0.2), ('calm', 'rv60', 0.8), ('stress', 'rv20', 0.7), ('stress', 'naive20', 0.3)),
q AS (SELECT fm.asset, fm.d, SUM(CASE WHEN w.regime = 'stress' THEN p ELSE 1 - p END * w * COALESCE(f, 0)) / SUM(CASE WHEN w.regime = 'stress' THEN p ELSE 1 - p END * w) AS ensemble FROM fm JOIN pr ON pr.asset = fm.asset AND pr.d = fm.d JOIN w ON w.model = fm.model WHERE p IS NOT NULL GROUP BY 1, 2)""", "ensemble", digits=7, keys="asset, d"))  # fmt: skip
def t4(s, d):
    """Forecasts weighted by the filtered probabilities of two states, as of the row before."""
    table = s.createDataFrame([("calm", "rv20", 0.2), ("calm", "rv60", 0.8), ("stress", "rv20", 0.7), ("stress", "naive20", 0.3)], "regime string, model string, w double")
    both = F.array(F.struct(F.lit("stress").alias("regime"), F.col("p")), F.struct(F.lit("calm").alias("regime"), (1 - F.col("p")).alias("p")))
    probs = stress_before(s, d).where("p IS NOT NULL").select("asset", "d", F.inline(both))
    return rounded(T.blended(models(s, d), probs, table, K, "d", "regime", "model", "f"), 7)


@query("e12_hybrid_stress", rsql("RECURSIVE " + HMM + """, ef AS (SELECT asset, rn, r * r AS a, r * r AS b FROM rr WHERE rn = 1 UNION ALL
SELECT n.asset, n.rn, POWER(0.5, 1 / 5.0) * f.a + (1 - POWER(0.5, 1 / 5.0)) * n.r * n.r, POWER(0.5, 1 / 40.0) * f.b + (1 - POWER(0.5, 1 / 40.0)) * n.r * n.r FROM ef f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1),
eg AS (SELECT pr.asset, pr.d, pr.rn, pr.p, LAG(SQRT(a * 252)) OVER w AS vf, LAG(SQRT(b * 252)) OVER w AS vs FROM ef JOIN pr USING (asset, rn) WINDOW w AS (PARTITION BY pr.asset ORDER BY pr.rn)),
eh AS (SELECT *, CASE WHEN vf IS NOT NULL THEN ABS(LN(GREATEST(vf, 1e-12)) - LN(GREATEST(vs, 1e-12))) END AS g FROM eg),
ei AS (SELECT *, CASE WHEN COUNT(g) OVER w >= 25 THEN (g - AVG(g) OVER w) / GREATEST(STDDEV_SAMP(g) OVER w, 1e-12) END AS z FROM eh WINDOW w AS (PARTITION BY asset ORDER BY rn ROWS 125 PRECEDING)),
ej AS (SELECT *, 1 / (1 + EXP(-(z - (1.5 - (p - 0.5))))) AS beta FROM ei), q AS (SELECT asset, d, beta, beta * vf + (1 - beta) * vs AS hybrid_stress FROM ej)""", "beta", "hybrid_stress", digits=6, keys="asset, d"))  # fmt: skip
def e12(s, d):
    """Fast and slow vols blended by their distance and by the filtered probability of stress."""
    return rounded(E.hybrid_stress(stress_before(s, d), K, "d", "r", "p").select("asset", "d", "beta", "hybrid_stress"), 6)


# --- Bandit


def pair_metrics(s, d):
    """asset, pair, d, ret and sharpe, drawdown, turnover, vol_error, loss of every pair's last 63 rows."""
    led = V.ledger(s, d)
    w = along(["asset", "pair"], "d")
    f = roll(w, 63)
    m, sd = F.avg("ret").over(f), F.stddev_samp("ret").over(f)
    loss = F.when(F.col("vol") > 0, qlike(F.col("vol") * F.col("vol"), 252.0 * F.col("r") * F.col("r")))
    rows = led.withColumns({"dw": F.abs(F.col("weight") - F.lag("weight").over(w)), "loss": loss})
    rows = rows.withColumns({"sharpe": F.when(sd > 0, m / sd * 252**0.5).otherwise(0.0), "vol_error": F.abs(sd * 252**0.5 - 0.10), "turnover": F.avg("dw").over(f), "loss": F.avg("loss").over(f), "peak": F.max("equity").over(f)})
    rows = rows.withColumn("down", 1 - F.col("equity") / F.col("peak")).withColumn("drawdown", F.max("down").over(f))
    return rows.select("asset", "pair", "d", "ret", *[F.round(c, 8).alias(c) for c in ("sharpe", "drawdown", "turnover", "vol_error", "loss")])


def bandit_rows(s, d):
    """asset, d, market features, obs, regime, and maps by pair of the row's return and of the last 63 rows' metrics."""
    metrics = F.struct("sharpe", "drawdown", "turnover", "vol_error", "loss").alias("metrics")
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", c))))
    maps = pair_metrics(s, d).select("asset", "d", "pair", "ret", metrics).groupBy("asset", "d").agg(entries("ret").alias("ret"), entries("metrics").alias("metrics"))
    base = V.returns(s, d).where("r IS NOT NULL")
    market = W.market_label(base, K, "d", "r", 63).where("market_vol IS NOT NULL")
    obs = F.least(F.row_number().over(along(K, "d")), F.lit(63)).cast("double")
    regime = F.when(F.col("market_regime") == "middle", "mid").otherwise(F.col("market_regime"))
    return market.select("asset", "d", "market_vol", "market_mean", "market_skew", obs.alias("market_obs"), regime.alias("regime")).join(maps, ["asset", "d"])


ARMS = [f"{e}__{c}" for e in V.ESTIMATORS for c in V.CONTROLLERS]


@query("q7_context_bandit")
def q7(s, d):
    return rounded(Q.context_bandit(bandit_rows(s, d), K, "d", ARMS), 6)
