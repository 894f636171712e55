"""Queries of the live walk-forward and of its out-of-sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as E
from ..operators import live as L
from ..operators import positions as P_
from ..operators import registered as U
from ..sources import views as V
from ..sources.series import settled
from .registry import R, query, rounded, rsql
from .routes import TM2

K = ["asset"]
TARGET = 0.10

#: rows of splits with both forecasts and their bias; ledgers by recursion over (asset, split, role, pair).
LIVE = R + """, vo0 AS (SELECT asset, d, r, CASE WHEN COUNT(r) OVER w20 >= 20 THEN STDDEV_SAMP(r) OVER w20 * SQRT(252) END AS rv20, CASE WHEN COUNT(r) OVER w60 >= 60 THEN SQRT(AVG(r * r) OVER w60 * 252) END AS naive60 FROM rr
WINDOW w20 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), w60 AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
vo AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY d) - 1 AS i, COUNT(*) OVER (PARTITION BY asset) AS cnt FROM vo0 WHERE rv20 > 0 AND naive60 > 0),
ss AS (SELECT s.*, CAST(k AS INT) AS split, CASE WHEN i < k * 126 + 504 THEN 'train' ELSE 'test' END AS role FROM vo s, LATERAL unnest(range(CAST(FLOOR((cnt - 505) / 126) AS BIGINT) + 1)) AS u(k) WHERE i >= k * 126 AND i < k * 126 + 630),
lf AS (SELECT asset, split, role, d, r, e, vol FROM (SELECT *, 'rv20' AS e, rv20 AS vol FROM ss UNION ALL SELECT *, 'naive60', naive60 FROM ss)),
bi AS (SELECT asset, split, e, LEAST(GREATEST(SQRT(252 * AVG(r * r) / AVG(vol * vol)), 0.5), 2) AS bias FROM lf WHERE role = 'train' GROUP BY 1, 2, 3),
lb AS (SELECT asset, split, role, e || '__clip' AS pair, d, r, vol * bias AS vol, bias, 0.10 / GREATEST(vol * bias, 1e-8) AS base, row_number() OVER p AS rn, COUNT(*) OVER (PARTITION BY asset, split, role, e) AS m FROM lf JOIN bi USING (asset, split, e) WINDOW p AS (PARTITION BY asset, split, role, e ORDER BY d)),
lw AS (SELECT asset, split, role, pair, rn, CASE WHEN m > 1 AND LEAST(base, 1.5) >= 0.05 THEN LEAST(base, 1.5) ELSE 0.0 END AS w FROM lb WHERE rn = 1 UNION ALL
SELECT n.asset, n.split, n.role, n.pair, n.rn, CASE WHEN n.rn < n.m AND ABS(LEAST(n.base, 1.5) - f.w) >= 0.05 THEN LEAST(n.base, 1.5) ELSE f.w END FROM lw f JOIN lb n ON n.asset = f.asset AND n.split = f.split AND n.role = f.role AND n.pair = f.pair AND n.rn = f.rn + 1),
lc AS (SELECT lb.*, w AS weight, LAG(w, 1, 0.0) OVER k AS w1, LAG(w, 2, 0.0) OVER k AS w2 FROM lb JOIN lw USING (asset, split, role, pair, rn) WINDOW k AS (PARTITION BY asset, split, role, pair ORDER BY rn)),
sp AS (SELECT asset, split, role, pair, d, r, vol, bias, weight, CASE WHEN rn = 1 THEN 0.0 ELSE w1 * r - ABS(w1 - w2) * 0.0005 END AS ret FROM lc), ledger AS (SELECT * FROM sp)""" + TM2.replace("FROM sp WHERE", "FROM sq WHERE").replace(", tr AS", ", sq AS (SELECT *, EXP(SUM(ret) OVER (PARTITION BY asset, split, role, pair ORDER BY d)) AS equity FROM sp), tr AS", 1) + """,
ch AS (SELECT asset, split, pair, ROUND(sharpe - 0.5 * drawdown - 0.5 * turnover - 0.5 * vol_error - COALESCE(qlike, 0), 9) AS value FROM tm),
best AS (SELECT *, row_number() OVER (PARTITION BY asset, split ORDER BY value DESC, pair) = 1 AS champion FROM ch)"""


def _register() -> None:
    U.register_forecast("rv20", lambda r, keys, order: E.realized(r, keys, order, 20))
    U.register_forecast("naive60", lambda r, keys, order: E.naive(r, keys, order, 60))
    U.register_position("clip", lambda vol: F.when(vol > 0, TARGET / F.greatest(vol, F.lit(1e-8))), P_.RULES["clip"])


def returns(s, d):
    return V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")


@query("k4_live_ledgers", rsql("RECURSIVE " + LIVE + ", q AS (SELECT sq.*, champion FROM sq JOIN best USING (asset, split, pair))", "bias", "vol", "weight", "ret", "equity", digits=7, keys="asset, split, role, pair, d, champion"))
def k4(s, d):
    """Two registered pairs in every split, each begun afresh for train and test, and the train window's champion."""
    _register()
    led = settled(L.live_ledgers(returns(s, d), K, "d", "r", ["rv20", "naive60"], ["clip"]), "live-ledgers")
    best = L.live_champions(led, K, "d", "r", TARGET)
    out = led.join(best.select("asset", "split", "pair", "champion"), ["asset", "split", "pair"])
    return rounded(out.select("asset", "split", "role", "pair", "d", "champion", "bias", "vol", "weight", "ret", "equity"), 7)


def detail_sql(source: str) -> str:
    """q: the out-of-sample table of ``source`` (asset, split, d, ret, r)."""
    sharpe = lambda x: f"CASE WHEN COUNT({x}) >= 2 AND STDDEV_SAMP({x}) > 0 THEN AVG({x}) / STDDEV_SAMP({x}) * SQRT(252) ELSE 0 END"
    return f"""o1 AS (SELECT *, CASE WHEN COUNT(r) OVER w >= 21 THEN STDDEV_SAMP(r) OVER w END AS v FROM {source} WINDOW w AS (PARTITION BY asset, split ORDER BY d ROWS 20 PRECEDING)),
o2 AS (SELECT *, COALESCE(v >= MEDIAN(v) OVER (PARTITION BY asset, split), FALSE) AS hi, SUM(ret) OVER w AS e, SUM(r) OVER w AS eh FROM o1 WINDOW w AS (PARTITION BY asset, split ORDER BY d)),
o3 AS (SELECT *, EXP(e - MAX(e) OVER w) - 1 AS dd, EXP(eh - MAX(eh) OVER w) - 1 AS ddh FROM o2 WINDOW w AS (PARTITION BY asset, split ORDER BY d)),
o4 AS (SELECT asset, split, QUANTILE_CONT(ret, 0.05) AS qr, QUANTILE_CONT(r, 0.05) AS qh FROM o3 GROUP BY 1, 2),
o5 AS (SELECT asset, split, COUNT(*) AS n, {sharpe('ret')} AS sharpe, {sharpe('r')} AS bh_sharpe, AVG(ret) * 252 AS m, AVG(r) * 252 AS mh, -MIN(dd) AS drawdown, -MIN(ddh) AS bh_drawdown, {sharpe('CASE WHEN hi THEN ret END')} AS sharpe_high_vol, {sharpe('CASE WHEN NOT hi THEN ret END')} AS sharpe_low_vol,
AVG(CASE WHEN dd < -0.05 THEN ABS(ret) END) AS size_in_drawdown, CASE WHEN COUNT(*) >= 10 THEN -AVG(CASE WHEN ret <= qr THEN ret END) ELSE 0 END AS cvar_95, CASE WHEN COUNT(*) >= 10 THEN -AVG(CASE WHEN r <= qh THEN r END) ELSE 0 END AS bh_cvar_95 FROM o3 JOIN o4 USING (asset, split) GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN drawdown > 0 THEN m / drawdown ELSE 0 END AS calmar, CASE WHEN bh_drawdown > 0 THEN mh / bh_drawdown ELSE 0 END AS bh_calmar, sharpe - bh_sharpe AS excess_sharpe FROM o5)"""


DETAIL = ("sharpe", "calmar", "cvar_95", "drawdown", "bh_sharpe", "bh_calmar", "bh_cvar_95", "bh_drawdown", "sharpe_high_vol", "sharpe_low_vol", "size_in_drawdown", "excess_sharpe")


@query("k4_a25_live_oos", rsql("RECURSIVE " + LIVE + ", oo AS (SELECT sp.asset, sp.split, sp.d, sp.ret, sp.r FROM sp JOIN best USING (asset, split, pair) WHERE role = 'test' AND champion), " + detail_sql("oo"), *DETAIL, digits=6, keys="asset, split, n"))
def k4_oos(s, d):
    """What each split's champion earns in its test, against buy and hold."""
    _register()
    rows = L.live_walk_forward(returns(s, d), K, "d", "r", ["rv20", "naive60"], ["clip"], TARGET)[1]
    return rounded(L.oos_detail(rows, ["asset", "split"], "d").select("asset", "split", "n", *DETAIL), 6)
