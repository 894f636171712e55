"""Queries of forecasts that choose their parameters again on refit dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as E
from ..operators import refits as RF
from ..sources import views as V
from .registry import R, query, rounded
from .reviews import macro

K = ["asset"]
_GRID = ", ".join(f"({a}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)" for a, g, b in RF.GRID)


def rets(s, d):
    return V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")


def likeliest(source: str, out: str) -> str:
    """out (asset, rn, p): of ``source`` (asset, rn, s) the likeliest (o, a, g, b) of the grid."""
    step = "list_reduce(list_transform(s, lambda x: {'x': x, 'v': 0.0::DOUBLE, 'l': 0.0::DOUBLE}), lambda t, y: {'x': y.x, 'v': GREATEST(o + (a + CASE WHEN y.x < 0 THEN g ELSE 0 END) * y.x * y.x + b * t.v, 1e-18), 'l': t.l - 0.5 * (LN(2 * PI() * t.v) + y.x * y.x / t.v)}, {'x': 0.0::DOUBLE, 'v': v0, 'l': 0.0::DOUBLE})"
    return f"""{out}_g AS (SELECT asset, rn, s, a, g, b, (1 - a - g / 2 - b) * list_avg(list_transform(s, lambda x: x * x)) AS o, GREATEST(list_avg(list_transform(s[1:20], lambda x: x * x)), 1e-18) AS v0 FROM {source}, (VALUES {_GRID}) AS gr(a, g, b)),
{out} AS (SELECT asset, rn, arg_min({{'o': o, 'a': a, 'g': g, 'b': b}}, {{'l': -ROUND(({step}).l, 6), 'a': a, 'g': g, 'b': b}}) AS p FROM {out}_g GROUP BY 1, 2)"""


#: Windows of 252 rows before, their EWMA and realised vols.
SEEN = R + """, ws AS (SELECT asset, d, r, rn, LIST(r) OVER w AS s, STDDEV_SAMP(r) OVER w * SQRT(252) AS sd, LAG(r) OVER (PARTITION BY asset ORDER BY d) AS x FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
wf AS (SELECT *, CASE WHEN LEN(s) >= 2 THEN SQRT(252 * list_reduce(list_transform(s, lambda x: x * x), lambda t, y: POWER(0.5, 1 / 21.0) * t + (1 - POWER(0.5, 1 / 21.0)) * y)) END AS ew FROM ws)"""


@query("e10_gjr_recalibrated", f"""WITH {SEEN}, due AS (SELECT asset, rn, s FROM wf WHERE LEN(s) >= 126 AND (rn - 127) % 63 = 0), {likeliest('due', 'fit')},
hp AS (SELECT wf.*, LAST_VALUE(fit.p IGNORE NULLS) OVER (PARTITION BY wf.asset ORDER BY wf.rn ROWS UNBOUNDED PRECEDING) AS p, fit.p IS NOT NULL AS refit FROM wf LEFT JOIN fit ON fit.asset = wf.asset AND fit.rn = wf.rn),
fv AS (SELECT *, CASE WHEN p IS NOT NULL AND LEN(s) >= 126 THEN SQRT(252 * (list_reduce(list_transform(s, lambda x: {{'x': x, 'v': 0.0::DOUBLE}}), lambda t, y: {{'x': y.x, 'v': GREATEST(p.o + (p.a + CASE WHEN y.x < 0 THEN p.g ELSE 0 END) * y.x * y.x + p.b * t.v, 1e-18)}}, {{'x': 0.0::DOUBLE, 'v': GREATEST(list_avg(list_transform(s[1:20], lambda x: x * x)), 1e-18)}})).v) END AS v FROM hp)
SELECT asset, d, p.a AS alpha, p.g AS gamma, p.b AS beta, refit, ROUND(CASE WHEN v > 0 THEN v WHEN ew > 0 THEN ew WHEN sd > 0 THEN sd END, 7) + 0.0 AS gjr, CASE WHEN v > 0 THEN 'model' WHEN ew > 0 THEN 'ewma' WHEN sd > 0 THEN 'realized' END AS source FROM fv""")  # fmt: skip
def e10(s, d):
    """Parameters refitted every 63 rows, held between; EWMA and realised vol where the model has none."""
    from ..functions.frames import along

    out = RF.gjr_recalibrated(rets(s, d), K, "d", "r")
    i = F.row_number().over(along(K, "d"))
    out = out.withColumn("refit", (i >= 127) & ((i - 127) % 63 == 0))
    return rounded(out.select("asset", "d", "params.alpha", "params.gamma", "params.beta", "refit", "gjr", F.col("gjr_source").alias("source")), 7)


def _state(new: str) -> str:
    """The three regimes' states, that of regime k + 1 replaced."""
    return f"[CASE WHEN k = 0 THEN {new} ELSE st[1] END, CASE WHEN k = 1 THEN {new} ELSE st[2] END, CASE WHEN k = 2 THEN {new} ELSE st[3] END]"


_NONE = "{'v': NULL::DOUBLE, 'e': NULL::DOUBLE, 'n': 0.0::DOUBLE, 'o': NULL::DOUBLE, 'a': NULL::DOUBLE, 'g': NULL::DOUBLE, 'b': NULL::DOUBLE}"
#: The state's parameters and start after a refit (u), then its advance by the last return (z).
_U = "{'v': CASE WHEN due AND c.v IS NULL THEN GREATEST(v0, 1e-16) ELSE c.v END, 'e': CASE WHEN due AND c.v IS NULL THEN x0 * x0 ELSE c.e END, 'n': CASE WHEN due AND c.v IS NULL THEN CASE WHEN x0 < 0 THEN 1.0 ELSE 0.0 END ELSE c.n END, 'o': CASE WHEN due THEN p.o ELSE c.o END, 'a': CASE WHEN due THEN p.a ELSE c.a END, 'g': CASE WHEN due THEN p.g ELSE c.g END, 'b': CASE WHEN due THEN p.b ELSE c.b END}"
_Z = "{'v': CASE WHEN u.o IS NOT NULL THEN GREATEST(u.o + (u.a + u.g * u.n) * u.e + u.b * u.v, 1e-18) ELSE u.v END, 'e': x * x, 'n': CASE WHEN x < 0 THEN 1.0::DOUBLE ELSE 0.0 END, 'o': u.o, 'a': u.a, 'g': u.g, 'b': u.b}"


def _advance(rows: str) -> str:
    """asset, i, st, v of ``rows`` (asset, i, k, due, x, v0, x0, p, st: the state before)."""
    return f"""SELECT asset, i, {_state('z')} AS st, z.o + (z.a + z.g * z.n) * z.e + z.b * z.v AS v FROM (SELECT *, {_Z} AS z FROM (SELECT *, {_U} AS u FROM (SELECT *, st[k + 1] AS c FROM ({rows}))))"""


@query("e11_regime_gjr", f"""WITH RECURSIVE {SEEN}, r5 AS (SELECT asset, d, rn, r, CASE WHEN COUNT(r) OVER w >= 3 THEN AVG(r * r) OVER w END AS rv FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 4 PRECEDING)),
q5 AS (SELECT asset, d, rn, LAG(rv) OVER (PARTITION BY asset ORDER BY d) AS now, QUANTILE_CONT(rv, 0.33) OVER w AS lo, QUANTILE_CONT(rv, 0.67) OVER w AS hi, COUNT(rv) OVER w AS k, COUNT(r) OVER w AS n, LIST({{'r': r, 'v': rv}}) OVER w AS al,
LIST(r * r) OVER t AS sq, QUANTILE_CONT(r * r, 0.9) OVER t AS cut, AVG(r * r) OVER t AS mean FROM r5 WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING), t AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)),
rg AS (SELECT *, CASE WHEN n >= 126 THEN CASE WHEN k < 10 THEN 1 WHEN now < lo THEN 0 WHEN now >= hi THEN 2 ELSE 1 END END AS regime, list_filter(sq, lambda x: x > cut) AS tail FROM q5),
ow AS (SELECT *, list_transform(list_filter(al, lambda x: x.v IS NOT NULL AND CASE WHEN x.v < lo THEN 0 WHEN x.v >= hi THEN 2 ELSE 1 END = regime), lambda x: x.r) AS s,
CASE WHEN LEN(sq) >= 10 AND LEN(tail) >= 5 AND mean > 0 THEN LEAST(GREATEST(SQRT(GREATEST(list_avg(tail), mean) / mean), 1), 1.5) ELSE 1 END AS tf FROM rg),
lb AS (SELECT asset, d, rn, regime AS k, s, LEN(s) >= 31 AS ok, row_number() OVER (PARTITION BY asset ORDER BY rn) AS i FROM ow WHERE regime IS NOT NULL),
fl AS (SELECT asset, i, k, ok AS due, [CASE WHEN ok AND k = 0 THEN i END, CASE WHEN ok AND k = 1 THEN i END, CASE WHEN ok AND k = 2 THEN i END] AS last FROM lb WHERE i = 1 UNION ALL
SELECT asset, i, k, due, [CASE WHEN due AND k = 0 THEN i ELSE last[1] END, CASE WHEN due AND k = 1 THEN i ELSE last[2] END, CASE WHEN due AND k = 2 THEN i ELSE last[3] END] FROM (SELECT n.asset, n.i, n.k, f.last, n.ok AND (f.last[n.k + 1] IS NULL OR n.i - f.last[n.k + 1] >= 63) AS due FROM fl f JOIN lb n ON n.asset = f.asset AND n.i = f.i + 1)),
du AS (SELECT lb.asset, lb.rn, lb.s FROM lb JOIN fl ON fl.asset = lb.asset AND fl.i = lb.i WHERE due), {likeliest('du', 'fit')},
inp AS (SELECT lb.asset, lb.rn, lb.i, lb.k, fl.due, wf.x, CASE WHEN fl.due THEN list_aggregate(lb.s, 'var_samp') END AS v0, CASE WHEN fl.due THEN lb.s[-1] END AS x0, fit.p FROM lb JOIN fl ON fl.asset = lb.asset AND fl.i = lb.i JOIN wf ON wf.asset = lb.asset AND wf.rn = lb.rn LEFT JOIN fit ON fit.asset = lb.asset AND fit.rn = lb.rn),
fo AS ({_advance(f"SELECT *, [{_NONE}, {_NONE}, {_NONE}] AS st FROM inp WHERE i = 1")} UNION ALL {_advance("SELECT n.*, f.st FROM fo f JOIN inp n ON n.asset = f.asset AND n.i = f.i + 1")}),
vv AS (SELECT ow.asset, ow.d, ow.regime, COALESCE(inp.due, FALSE) AS refit, SQRT(fo.v * 252) AS v, tf, ew, sd FROM ow JOIN wf ON wf.asset = ow.asset AND wf.rn = ow.rn LEFT JOIN inp ON inp.asset = ow.asset AND inp.rn = ow.rn LEFT JOIN fo ON fo.asset = inp.asset AND fo.i = inp.i)
SELECT asset, d, regime, refit, ROUND(CASE WHEN v > 0 AND v < 5 THEN v * CASE WHEN regime = 2 THEN tf ELSE 1 END WHEN ew > 0 THEN ew WHEN sd > 0 THEN sd END, 7) + 0.0 AS regime_gjr FROM vv""")  # fmt: skip
def e11(s, d):
    """A variance state and parameters for each regime; refits are spaced per regime."""
    return rounded(RF.regime_gjr(rets(s, d), K, "d", "r"), 7)


@query("e17_boosted_curve")
def e17(s, d):
    """Boosted trees on the curve features, fitted again every half year from the third year on."""
    return rounded(RF.curve_boosted(E.curve_features(macro(s, d), K, "d", "r"), K, "d"), 6)
