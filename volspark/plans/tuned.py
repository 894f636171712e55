"""Queries of portfolios as keys: target weights, the first year's tuning, ledgers under tuned parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import covariance as C
from ..operators import portfolio as B
from ..operators import tuning as T
from ..sources import views as V
from ..sources.series import settled
from .registry import R, query, rounded, rsql

P = ["portfolio"]
HALFLIVES, CAPS, GROSS = (10.0, 21.0, 42.0), (0.20, 0.35, 0.45), (1.0, 1.25, 1.5)
TARGET = 0.06  # near the vol of the weights before scaling, so that gross limits bind


def books(s, d):
    """Two portfolios in one table: all assets, and those whose names come before N."""
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    both = F.when(F.col("asset") < "N", F.array(F.lit("all"), F.lit("core"))).otherwise(F.array(F.lit("all")))
    return T.complete(rows.withColumn("portfolio", F.explode(both)), P, "d")


BOOKS = R + """, pf AS (SELECT portfolio, asset, d, r FROM rr, (VALUES ('all'), ('core')) AS p(portfolio) WHERE portfolio = 'all' OR asset < 'N'),
dd AS (SELECT portfolio, d, row_number() OVER (PARTITION BY portfolio ORDER BY d) AS n FROM (SELECT DISTINCT portfolio, d FROM pf)),
bk AS (SELECT portfolio, d, n, asset, COALESCE(r, 0) AS r FROM dd JOIN (SELECT DISTINCT portfolio, asset FROM pf) USING (portfolio) LEFT JOIN pf USING (portfolio, d, asset))"""
WB = "PARTITION BY portfolio, i, j ORDER BY d ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING"


def ewm(source: str, halflife: str, z: str = "") -> str:
    """cv{z} (portfolio, halflife, d, i, j, cov) of the panel ``source``, for the halflives that a table names."""
    return f"""pb{z} AS (SELECT a.portfolio, a.d, a.asset AS i, b.asset AS j, a.r AS x, b.r AS y FROM {source} a JOIN {source} b ON a.portfolio = b.portfolio AND a.d = b.d AND a.asset <= b.asset),
la{z} AS (SELECT portfolio, d, i, j, LIST({{'x': x, 'y': y}}) OVER ({WB}) AS a FROM pb{z}),
lb{z} AS (SELECT la{z}.portfolio, halflife, d, i, j, list_reduce(list_transform(a, lambda v: {{'w': 1.0::DOUBLE, 'x': v.x, 'y': v.y, 'xy': v.x * v.y}}),
lambda s, v: {{'w': s.w * POWER(0.5, 1 / halflife) + v.w, 'x': s.x * POWER(0.5, 1 / halflife) + v.x, 'y': s.y * POWER(0.5, 1 / halflife) + v.y, 'xy': s.xy * POWER(0.5, 1 / halflife) + v.xy}}) AS m FROM la{z} JOIN {halflife} WHERE LEN(a) >= 126),
cv{z} AS (SELECT portfolio, halflife, d, i, j, (m.xy / m.w - m.x / m.w * m.y / m.w) * 252 AS cov FROM lb{z})"""


def targets(caps: str, grosses: str, z: str = "") -> str:
    """tw{z} (portfolio, halflife, max_weight, max_gross, d, asset, weight, vol) from cv{z}."""
    by = "PARTITION BY portfolio, halflife, max_weight, d"
    return f"""iw{z} AS (SELECT portfolio, halflife, d, i AS asset, (1 / SQRT(cov)) / SUM(1 / SQRT(cov)) OVER (PARTITION BY portfolio, halflife, d) AS weight FROM cv{z} WHERE i = j AND cov > 0),
ca{z} AS (SELECT w.*, max_weight, LEAST(weight, max_weight) AS low FROM iw{z} w JOIN {caps}), cb{z} AS (SELECT *, 1 - SUM(low) OVER ({by}) AS rest, SUM(max_weight - low) OVER ({by}) AS room, COUNT(*) OVER ({by}) AS k FROM ca{z}),
cc{z} AS (SELECT portfolio, halflife, max_weight, d, asset, CASE WHEN rest <= 1e-10 THEN low WHEN rest >= room THEN 1 / k ELSE low + (max_weight - low) / room * rest END AS w FROM cb{z}),
cd{z} AS (SELECT portfolio, halflife, max_weight, d, asset, w / SUM(w) OVER ({by}) AS w FROM cc{z}),
vo{z} AS (SELECT c.portfolio, c.halflife, max_weight, c.d, SQRT(GREATEST(SUM(CASE WHEN i = j THEN 1 ELSE 2 END * a.w * b.w * cov), 0)) AS vol FROM cv{z} c JOIN cd{z} a ON a.portfolio = c.portfolio AND a.halflife = c.halflife AND a.d = c.d AND a.asset = c.i JOIN cd{z} b USING (max_weight) WHERE b.portfolio = c.portfolio AND b.halflife = c.halflife AND b.d = c.d AND b.asset = c.j GROUP BY ALL),
tw{z} AS (SELECT w.portfolio, halflife, max_weight, max_gross, d, asset, w * LEAST({TARGET} / GREATEST(vol, 1e-8), max_gross) AS weight, vol * LEAST({TARGET} / GREATEST(vol, 1e-8), max_gross) AS vol FROM cd{z} w JOIN vo{z} USING (portfolio, halflife, max_weight, d) JOIN {grosses})"""


def _values(name: str, xs) -> str:
    return f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in xs)}) AS {name}s({name}) ON TRUE"


GRID = BOOKS + f""", tr AS (SELECT * FROM bk JOIN (SELECT portfolio, LEAST(252, MAX(n) - 2) AS last FROM dd GROUP BY 1) USING (portfolio) WHERE n <= last), {ewm('tr', _values('halflife', HALFLIVES))}, {targets(_values('max_weight', CAPS), _values('max_gross', GROSS))},
nx AS (SELECT portfolio, d, asset, LEAD(r) OVER (PARTITION BY portfolio, asset ORDER BY d) AS nr FROM tr),
ww AS (SELECT tw.*, nr, ABS(weight - COALESCE(LAG(weight) OVER (PARTITION BY portfolio, halflife, max_weight, max_gross, asset ORDER BY d), 0)) AS dw FROM tw JOIN nx USING (portfolio, d, asset) WHERE nr IS NOT NULL),
dy AS (SELECT portfolio, halflife, max_weight, max_gross, d, SUM(weight * nr) AS r, ABS(ANY_VALUE(vol) - {TARGET}) AS e, SUM(dw) AS t FROM ww GROUP BY 1, 2, 3, 4, 5),
g AS (SELECT portfolio, halflife, max_weight, max_gross, COUNT(*) AS n, AVG(e) AS vol_error, AVG(t) AS turnover, CASE WHEN STDDEV_SAMP(r) > 0 THEN AVG(r) / STDDEV_SAMP(r) * SQRT(252) ELSE 0 END AS sharpe FROM dy GROUP BY 1, 2, 3, 4),
gs AS (SELECT *, vol_error + 0.02 * turnover - 0.01 * sharpe AS score FROM g WHERE n >= 20),
bp AS (SELECT portfolio, arg_min({{'halflife': halflife, 'max_weight': max_weight, 'max_gross': max_gross}}, {{'s': ROUND(score, 9), 'a': halflife, 'b': max_weight, 'c': max_gross}}) AS b FROM gs GROUP BY 1)"""


def scores(s, d):
    return T.grid_scores(books(s, d), P, "d", HALFLIVES, CAPS, GROSS, TARGET)


@query("m14_first_year_tuning", rsql(GRID + """, q AS (SELECT gs.*, gs.halflife = b.halflife AND gs.max_weight = b.max_weight AND gs.max_gross = b.max_gross AS best FROM gs JOIN bp USING (portfolio))""",
    "vol_error", "turnover", "sharpe", "score", keys="portfolio, halflife, max_weight, max_gross, n, best"))
def m14(s, d):
    """27 combinations for each of two portfolios, and which is its best."""
    found = settled(scores(s, d), "grid-scores")
    best = T.best_params(found, P).withColumn("best", F.lit(True))
    out = found.join(best, [*P, *T.PARAMS], "left").withColumn("best", F.coalesce("best", F.lit(False)))
    return rounded(out.select(*P, *T.PARAMS, "n", "vol_error", "turnover", "sharpe", "score", "best"), 8, halflife=2, max_weight=4, max_gross=4)


TUNED = GRID + f""", {ewm('bk', '(SELECT portfolio AS p, b.halflife FROM bp) AS hl ON hl.p = la2.portfolio', '2')}, {targets('(SELECT portfolio AS p, b.max_weight FROM bp) AS mw ON mw.p = w.portfolio', '(SELECT portfolio AS p, b.max_gross FROM bp) AS mg ON mg.p = w.portfolio', '2')},
w2 AS (SELECT bk.portfolio, bk.d, bk.asset, bk.r, COALESCE(tw2.weight, 0) AS weight FROM bk LEFT JOIN tw2 USING (portfolio, d, asset)), w3 AS (SELECT *, ABS(weight - COALESCE(LAG(weight) OVER a, 0)) AS dw, COALESCE(LAG(weight) OVER a * r, 0) AS gain FROM w2 WINDOW a AS (PARTITION BY portfolio, asset ORDER BY d)),
w4 AS (SELECT portfolio, d, SUM(ABS(weight)) AS gross, SUM(dw) AS turnover, SUM(gain) AS gain FROM w3 GROUP BY 1, 2), w5 AS (SELECT *, gain - COALESCE(LAG(turnover * 0.0005) OVER (PARTITION BY portfolio ORDER BY d), 0) AS ret FROM w4),
q AS (SELECT portfolio, d, gross, turnover, ret, EXP(SUM(ret) OVER (PARTITION BY portfolio ORDER BY d)) AS equity FROM w5)"""


@query("m13_m14_tuned_ledgers", rsql(TUNED, "gross", "turnover", "ret", "equity", digits=7, keys="portfolio, d"))
def m13(s, d):
    """Both portfolios' ledgers under the parameters that their first year chose."""
    rows = books(s, d)
    led = T.tuned_ledger(rows, T.best_params(scores(s, d), P), P, "d", TARGET)
    return rounded(led.select(*P, "d", "gross", "turnover", "ret", "equity"), 7)


M0 = BOOKS + f""", sp AS (SELECT portfolio, d, i, j, CASE WHEN COUNT(*) OVER w >= 126 THEN COVAR_SAMP(x, y) OVER w * 252 END AS cov FROM (SELECT a.portfolio, a.d, a.asset AS i, b.asset AS j, a.r AS x, b.r AS y FROM bk a JOIN bk b ON a.portfolio = b.portfolio AND a.d = b.d AND a.asset <= b.asset) WINDOW w AS ({WB})),
cv AS (SELECT portfolio, 0.0 AS halflife, d, i, j, cov FROM sp WHERE cov IS NOT NULL), {targets(_values('max_weight', [0.35]), _values('max_gross', [1.5]))}, q AS (SELECT portfolio, d, asset, weight FROM tw)"""


@query("m0_target_weights", rsql(M0, "weight", keys="portfolio, d, asset"))
def m0(s, d):
    """Inverse vols capped by room and scaled to the target vol, both portfolios by their key."""
    cov = settled(C.sample(C.pair_panel(books(s, d), "asset", "d", "r", P), "d", keys=P).where("cov IS NOT NULL").select(*P, "d", "i", "j", "cov"), "cov")
    w = B.capped_by_room(B.inverse_vol(cov, "d", P).select(*P, "d", "asset", "weight"), "d", 0.35, P)
    return rounded(B.to_target(w, cov, "d", TARGET, 1.5, P).select(*P, "d", "asset", "weight"))
