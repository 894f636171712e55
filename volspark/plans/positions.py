"""Queries of the position, covariance and portfolio operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import along, roll
from ..operators import covariance as C
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import portfolio as B
from ..operators import positions as P
from ..operators.fold import fold_ledger
from ..operators.forecast import realized
from ..sources import series as S
from ..sources import views as V
from .registry import EW, R, RF, VIX, query, rounded, rsql

K = ["asset"]
WD = "PARTITION BY asset ORDER BY d"
COLS = ["weight", "ret", "equity"]


def base(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    return rows.withColumn("vol", realized(F.col("r"), K, "d", 20))


def controlled(s, d, name: str, rf: bool = False):
    rows = base(s, d).withColumn("wanted", P.wanted(name, "vol", "r", 0.10, K, "d"))
    if rf:
        days = J.asof(rows.select("d").distinct(), V.risk_free(s, d), [], "d", ["y"])
        rows = rows.join(S.daily_risk_free(days, "d", "y").select("d", F.coalesce("rf", F.lit(0.0)).alias("rf")), "d")
    if name == "priority":
        rows = rows.withColumn("gates", P.priority_gates("r", K, "d"))
    return fold_ledger(rows, K, "d", "r", "wanted", P.RULES[name], "rf" if rf else None, gates="gates" if name == "priority" else None)


BASE = """vb AS (SELECT asset, d, rn, r, CASE WHEN COUNT(r) OVER w >= 20 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS vol, 0.0::DOUBLE AS rf,
rn = COUNT(*) OVER (PARTITION BY asset) AS is_last FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
sc AS (SELECT *, CASE WHEN vol > 0 THEN 0.10 / GREATEST(vol, 1e-8) END AS scaled FROM vb)"""


def fold_sql(wanted: str, extra: str = "", brake: str = "1.0", band: float = 0.05, strict: bool = False, high: str = "1e300", up: str = "1e300", down: str = "1e300", rf: str = "", gates: str = "0.0") -> str:
    """The fold as a recursive query; ``wanted`` is over ``sc``, ``brake`` over dd."""
    op = ">" if strict else ">="
    w = f"""CASE WHEN is_last OR base IS NULL THEN pw WHEN ABS(LEAST(GREATEST(base * ({brake}), 0), {high}) - pw) {op} {band}
    THEN LEAST(GREATEST(pw + LEAST(GREATEST(LEAST(GREATEST(base * ({brake}), 0), {high}) - pw, -{down}), {up}), 0), 1.5) ELSE pw END"""
    source = rf or "sc"
    return f"""WITH RECURSIVE {R}, {BASE}{extra}, b AS (SELECT asset, d, rn, r, rf, is_last, ({wanted})::DOUBLE AS base, ({gates})::DOUBLE AS g FROM {source}),
f AS (SELECT asset, d, rn, {w} AS w, pw, equity, peak, ret, cost FROM (SELECT *, 0.0::DOUBLE AS pw, 1.0::DOUBLE AS equity, 1.0::DOUBLE AS peak, 0.0::DOUBLE AS ret, 0.0::DOUBLE AS cost, 0.0::DOUBLE AS dd FROM b WHERE rn = 1)
UNION ALL SELECT asset, d, rn, {w}, pw, equity, peak, ret, cost FROM (
SELECT asset, d, rn, is_last, base, g, pw, equity, GREATEST(peak, equity) AS peak, ret, cost, 1 - equity / GREATEST(peak, equity) AS dd FROM (
SELECT n.asset, n.d, n.rn, n.is_last, n.base, n.g, f.w AS pw, f.peak, f.w * n.r + (1 - f.w) * n.rf - ABS(f.w - f.pw) * 0.0005 AS ret, 0.0::DOUBLE AS cost,
f.equity * EXP(f.w * n.r + (1 - f.w) * n.rf - ABS(f.w - f.pw) * 0.0005) AS equity FROM f JOIN b n ON n.asset = f.asset AND n.rn = f.rn + 1)))
SELECT asset, d, ROUND(w, 6) + 0.0 AS weight, ROUND(ret, 8) + 0.0 AS ret, ROUND(equity, 6) + 0.0 AS equity FROM f"""


def brake_sql(start: float, full: float, k: float, least: float) -> str:
    return f"CASE WHEN dd <= {start} THEN 1.0 ELSE GREATEST({least}, 1.0 - {k} * LEAST(1.0, (dd - {start}) / {full - start})) END"


ES = f""", es AS (SELECT *, LIST(-r) OVER w AS a, QUANTILE_CONT(-r, 0.95) OVER w AS c, COUNT(r) OVER w AS n FROM sc WINDOW w AS ({WD} ROWS 251 PRECEDING)),
esd AS (SELECT *, CASE WHEN n >= 63 THEN list_avg(list_filter(a, lambda x: x >= c)) END AS es FROM es)"""
CONTROLLERS = {
    "c1_constant": ("constant", fold_sql("CASE WHEN TRUE THEN 1.0 END", band=0.0)),
    "c2_naive_scaling": ("naive_scaling", fold_sql("scaled")),
    "c3_clip": ("clip", fold_sql("scaled", high="1.5")),
    "c4_hysteresis": ("hysteresis", fold_sql("scaled", high="1.5", strict=True)),
    "c5_inverse_variance": ("variance", fold_sql("v", f", iv AS (SELECT *, CASE WHEN vol > 0 THEN 0.10 * AVG(CASE WHEN vol > 0 THEN vol END) OVER ({WD} ROWS 251 PRECEDING) / GREATEST(vol * vol, 1e-8) END AS v FROM sc)", rf="iv")),
    "c6_regime": ("regime", fold_sql("scaled * CASE WHEN n >= 50 AND vol >= c THEN 0.5 ELSE 1.0 END", f", rg AS (SELECT *, COUNT(vol) OVER w AS n, QUANTILE_CONT(vol, 0.8) OVER w AS c FROM sc WINDOW w AS ({WD} ROWS 251 PRECEDING))", high="2.0", rf="rg")),
    "c7_trend": ("trend", fold_sql("scaled * GREATEST(LEAST(0.5 + 0.5 * TANH(0.75 * CASE WHEN n >= 12 AND sd > 0 THEN m / sd ELSE 0 END), 1), 0.85)", f", tr AS (SELECT *, COUNT(r) OVER w AS n, AVG(r) OVER w AS m, STDDEV_SAMP(r) OVER w AS sd FROM sc WINDOW w AS ({WD} ROWS 62 PRECEDING))", high="1.5", rf="tr")),
    "c8_expected_shortfall": ("es", fold_sql("CASE WHEN es > 0 THEN 0.02 / GREATEST(es, 1e-8) END", ES, high="1.5", rf="esd")),
    "c9_drawdown_brake": ("drawdown_brake", fold_sql("scaled", brake=brake_sql(0.10, 0.30, 1.0, 0.75), high="1.5")),
    "c10_drawdown_modulated": ("drawdown_modulated", fold_sql("scaled", brake=brake_sql(0.10, 0.30, 0.35, 0.65), high="1.5")),
    "c11_priority_stack": ("priority", fold_sql("CASE WHEN scaled IS NOT NULL THEN LEAST(scaled, 1.5) END", ES + f", pr AS (SELECT *, COUNT(r) OVER w AS n2, AVG(r) OVER w AS m, STDDEV_SAMP(r) OVER w AS sd FROM esd WINDOW w AS ({WD} ROWS 62 PRECEDING))",
        brake=f"(g + {brake_sql(0.10, 0.30, 1.0, 0.8)}) / 3", strict=True, high="1.5", up="0.35", down="0.35", rf="pr",
        gates="CASE WHEN n2 < 12 OR sd > 0 AND m / sd > 0 THEN 1.0 ELSE 0.8 END + COALESCE(GREATEST(LEAST(0.03 / GREATEST(es, 1e-8), 1), 0.8), 1)")),
    "c12_shock_throttle": ("shock", fold_sql("scaled * CASE WHEN n >= 5 AND vol >= 1.75 * c THEN 0.5 ELSE 1.0 END", f", sh AS (SELECT *, COUNT(vol) OVER w AS n, QUANTILE_CONT(vol, 0.5) OVER w AS c FROM sc WINDOW w AS ({WD} ROWS 29 PRECEDING))", band=0.025, up="0.20", down="0.75", rf="sh")),
    "c13_peg_aware": ("peg", fold_sql("scaled * GREATEST(LEAST(1 - (ABS(EXP(r) - 1) - 0.0015) / 0.0045, 1), 0)", brake=brake_sql(0.02, 0.08, 1.0, 0.0), band=0.01, up="0.25", down="0.25")),
}
for _name, (_ctrl, _sql) in CONTROLLERS.items():
    query(_name, _sql)(lambda s, d, c=_ctrl: rounded(controlled(s, d, c).select("asset", "d", *COLS), 6, ret=8))


@query("c14_c17_ledger_with_cash", fold_sql("scaled", f", {RF}, days AS (SELECT x.d, COALESCE(LN(1 + rf.y / 100 / 252), 0) AS rf FROM (SELECT DISTINCT d FROM rr) x ASOF LEFT JOIN rf ON x.d >= rf.d), sr AS (SELECT sc.asset, sc.d, rn, r, vol, days.rf, is_last, scaled FROM sc JOIN days ON days.d = sc.d)", high="1.5", rf="sr"))
def c14(s, d):
    return rounded(controlled(s, d, "clip", rf=True).select("asset", "d", *COLS), 6, ret=8)


COMPARED = {"naive_scaling": "c2_naive_scaling", "hysteresis": "c4_hysteresis", "drawdown_brake": "c9_drawdown_brake", "regime": "c6_regime", "trend": "c7_trend"}


def bare(sql: str) -> str:
    """A fold's query without rounding."""
    return sql.replace("ROUND(w, 6) + 0.0 AS weight, ROUND(ret, 8) + 0.0 AS ret, ROUND(equity, 6) + 0.0 AS equity", "w AS weight, ret, equity")


@query("c15_c16_controller_comparison", "WITH " + ", ".join(f"{n}_x AS ({bare(CONTROLLERS[q][1])})" for n, q in COMPARED.items()) + ", u AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS pair FROM {n}_x" for n in COMPARED) + """),
e AS (SELECT *, EXP(SUM(ret) OVER w) AS e, ABS(weight - LAG(weight) OVER w) AS dw FROM u WINDOW w AS (PARTITION BY asset, pair ORDER BY d)), dd AS (SELECT *, e / MAX(e) OVER (PARTITION BY asset, pair ORDER BY d) - 1 AS dd FROM e)
SELECT asset, pair, COUNT(*) AS n, ROUND(CASE WHEN STDDEV_SAMP(ret) > 0 THEN AVG(ret) / STDDEV_SAMP(ret) * SQRT(252) ELSE 0 END, 6) + 0.0 AS sharpe, ROUND(-MIN(dd), 6) + 0.0 AS max_drawdown, ROUND(SQRT(AVG(dd * dd)), 6) + 0.0 AS ulcer, ROUND(AVG(dw), 6) + 0.0 AS turnover FROM dd GROUP BY 1, 2""")  # fmt: skip
def c15(s, d):
    parts = [controlled(s, d, n).withColumn("pair", F.lit(n)) for n in COMPARED]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return rounded(M.performance(out, ["asset", "pair"], "d", "ret", "weight").select("asset", "pair", "n", "sharpe", "max_drawdown", "ulcer", "turnover"), 6)


LOOKBACKS = (10, 20, 60)


@query("c18_lookback_search", "WITH " + ", ".join(f"l{n} AS ({bare(fold_sql('scaled', high='1.5')).replace('COUNT(r) OVER w >= 20', f'COUNT(r) OVER w >= {n}').replace('BETWEEN 20 PRECEDING', f'BETWEEN {n} PRECEDING')})" for n in LOOKBACKS) + ", u AS (" + " UNION ALL ".join(f"SELECT *, {n} AS lookback FROM l{n}" for n in LOOKBACKS) + """),
h AS (SELECT *, PERCENT_RANK() OVER (PARTITION BY asset, lookback ORDER BY d) < 0.5 AS f FROM u),
p AS (SELECT asset, lookback, CASE WHEN STDDEV_SAMP(ret) FILTER (f) > 0 THEN AVG(ret) FILTER (f) / STDDEV_SAMP(ret) FILTER (f) * SQRT(252) ELSE 0 END AS i, CASE WHEN STDDEV_SAMP(ret) FILTER (NOT f) > 0 THEN AVG(ret) FILTER (NOT f) / STDDEV_SAMP(ret) FILTER (NOT f) * SQRT(252) ELSE 0 END AS o FROM h GROUP BY 1, 2)
SELECT asset, lookback, ROUND(i, 6) + 0.0 AS in_sharpe, ROUND(o, 6) + 0.0 AS out_sharpe FROM p QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ROUND(i, 8) DESC, lookback) = 1""")  # fmt: skip
def c18(s, d):
    """Lookbacks as keys: each is held in-sample, the best Sharpe of the first half is reported on the second."""
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    parts = [rows.select("*", F.lit(n).alias("lookback"), realized(F.col("r"), K, "d", n).alias("vol")) for n in LOOKBACKS]
    long = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("wanted", P.scaled("vol", 0.10))
    led = fold_ledger(long, ["asset", "lookback"], "d", "r", "wanted", P.RULES["clip"])
    half = led.withColumn("first", F.percent_rank().over(along(["asset", "lookback"], "d")) < 0.5)
    per = half.groupBy("asset", "lookback").agg(M.sharpe(F.when(F.col("first"), F.col("ret"))).alias("in_sharpe"), M.sharpe(F.when(~F.col("first"), F.col("ret"))).alias("out_sharpe"))
    best = F.min_by(F.struct("lookback", "in_sharpe", "out_sharpe"), F.struct(-F.round("in_sharpe", 8), "lookback"))
    return rounded(per.groupBy("asset").agg(best.alias("b")).select("asset", "b.*"), 6)


PANEL = R + """, pp AS (SELECT a.d, a.asset AS i, b.asset AS j, a.r AS x, b.r AS y FROM rr a JOIN rr b ON a.d = b.d AND a.asset <= b.asset)"""
WP = "PARTITION BY i, j ORDER BY d"
F126 = f"WINDOW w AS ({WP} ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)"


def panel(s, d):
    return C.pair_panel(V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r"), "asset", "d", "r")


def out(df):
    return rounded(df.select("d", "i", "j", "cov"))


SAMPLE = f"""sv AS (SELECT d, i, j, CASE WHEN COUNT(*) OVER w >= 126 THEN COVAR_SAMP(x, y) OVER w * 252 END AS cov FROM pp {F126})"""


@query("v1_sample_covariance", rsql(f"{PANEL}, {SAMPLE}, q AS (SELECT * FROM sv)", "cov", keys="d, i, j"))
def v1(s, d):
    return out(C.sample(panel(s, d), "d"))


@query("v2_expanding_covariance", rsql(f"""{PANEL}, q AS (SELECT d, i, j, CASE WHEN COUNT(*) OVER e >= 63 THEN COVAR_SAMP(x, y) OVER e ELSE COVAR_SAMP(x, y) OVER w END * 252 AS cov FROM pp {F126}, e AS ({WP} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "cov", keys="d, i, j"))
def v2(s, d):
    return out(C.expanding(panel(s, d), "d"))


EWM = f"""ea AS (SELECT d, i, j, LIST({{'x': x, 'y': y}}) OVER w AS a FROM pp {F126}), eb AS (SELECT d, i, j, list_reduce(list_transform(a, lambda v: {{'w': 1.0::DOUBLE, 'x': v.x, 'y': v.y, 'xy': v.x * v.y}}),
lambda s, v: {{'w': s.w * POWER(0.5, 1 / 21.0) + v.w, 'x': s.x * POWER(0.5, 1 / 21.0) + v.x, 'y': s.y * POWER(0.5, 1 / 21.0) + v.y, 'xy': s.xy * POWER(0.5, 1 / 21.0) + v.xy}}) AS m FROM ea WHERE LEN(a) >= 126),
ew2 AS (SELECT d, i, j, (m.xy / m.w - m.x / m.w * m.y / m.w) * 252 AS cov FROM eb)"""


@query("v3_v4_ewma_covariance", rsql(f"{PANEL}, {EWM}, q AS (SELECT d, i, j, cov, CASE WHEN i = j THEN cov ELSE 0 END AS diag FROM ew2)", "cov", "diag", keys="d, i, j"))
def v3(s, d):
    e = C.ewma(panel(s, d), "d").where("cov IS NOT NULL").select("d", "i", "j", "cov")
    return rounded(e.join(C.diagonal(e).withColumnRenamed("cov", "diag"), ["d", "i", "j"]))


@query("v5_correlation_scaled", rsql(f"""{PANEL}, {EWM}, rho AS (SELECT d, i, j, CASE WHEN COUNT(*) OVER w >= 126 THEN CORR(x, y) OVER w END AS rho FROM pp {F126}), dg AS (SELECT d, i, SQRT(cov) AS v FROM ew2 WHERE i = j),
q AS (SELECT rho.d, rho.i, rho.j, CASE WHEN rho.i = rho.j THEN 1 ELSE rho END * a.v * b.v AS cov FROM rho JOIN dg a ON a.d = rho.d AND a.i = rho.i JOIN dg b ON b.d = rho.d AND b.i = rho.j)""", "cov", keys="d, i, j"))
def v5(s, d):
    p = panel(s, d)
    return out(C.correlation_scaled(p, C.ewma(p, "d").where("cov IS NOT NULL"), "d"))


@query("v6_shrunk_covariance", rsql(f"{PANEL}, {SAMPLE}, q AS (SELECT d, i, j, CASE WHEN i = j THEN cov ELSE cov * 0.75 END AS cov FROM sv)", "cov", keys="d, i, j"))
def v6(s, d):
    return out(C.shrunk(C.sample(panel(s, d), "d")))


LEDOIT = f"""m AS (SELECT d, i, j, COVAR_POP(x, y) OVER w AS s, AVG(x) OVER w AS mx, AVG(y) OVER w AS my, LIST({{'x': x, 'y': y}}) OVER w AS a, COUNT(*) OVER w AS n FROM pp {F126}),
c AS (SELECT d, i, j, s, list_avg(list_transform(a, lambda v: POWER((v.x - mx) * (v.y - my), 2))) AS fm FROM m WHERE n >= 126),
t AS (SELECT d, AVG(CASE WHEN i = j THEN s END) AS mu, COUNT(*) FILTER (i = j) AS k, SUM(CASE WHEN i = j THEN 1 ELSE 2 END * s * s) AS ss, SUM(CASE WHEN i = j THEN 1 ELSE 2 END * (fm - s * s)) AS b2 FROM c GROUP BY 1),
u AS (SELECT d, mu, CASE WHEN ss - k * mu * mu > 0 THEN LEAST(GREATEST(b2 / 126, 0), ss - k * mu * mu) / (ss - k * mu * mu) ELSE 0 END AS rho FROM t),
q AS (SELECT c.d, c.i, c.j, ((1 - rho) * s + rho * CASE WHEN i = j THEN mu ELSE 0 END) * 252 AS cov, rho FROM c JOIN u ON c.d = u.d)"""
DOWN = f"""m AS (SELECT d, i, j, COVAR_SAMP(x, y) OVER w AS s, AVG(x) OVER w AS mx, AVG(y) OVER w AS my, LIST({{'x': x, 'y': y}}) OVER w AS a, COUNT(*) OVER w AS n FROM pp {F126}),
l AS (SELECT d, i, j, s, n, list_transform(a, lambda v: LEAST(v.x - mx, 0)) AS lx, list_transform(a, lambda v: LEAST(v.y - my, 0)) AS ly FROM m),
q AS (SELECT d, i, j, CASE WHEN n >= 126 THEN (0.65 * (list_inner_product(lx, ly) - list_sum(lx) * list_sum(ly) / 126) / 125 + 0.35 * s) * 252 END AS cov FROM l)"""


@query("v7_ledoit_wolf", rsql(f"{PANEL}, {LEDOIT}", "cov", "rho", digits=6, keys="d, i, j"))
def v7(s, d):
    return rounded(C.ledoit_wolf(panel(s, d), "d").where("cov IS NOT NULL"), 6)


@query("v8_downside_covariance", rsql(f"{PANEL}, {DOWN}", "cov", keys="d, i, j"))
def v8(s, d):
    return out(C.downside(panel(s, d), "d"))


@query("v9_robust_covariance", rsql(R + f""", m AS (SELECT asset, d, r, QUANTILE_CONT(r, 0.5) OVER w AS m, LIST(r) OVER w AS a FROM rr WINDOW w AS ({WD} ROWS 125 PRECEDING)), b AS (SELECT *, 4 * 1.4826 * list_aggregate(list_transform(a, lambda x: ABS(x - m)), 'median') AS b FROM m),
c AS (SELECT asset, d, CASE WHEN b > 0 THEN LEAST(GREATEST(r, m - b), m + b) ELSE r END AS r FROM b), pp AS (SELECT x.d, x.asset AS i, y.asset AS j, x.r AS x, y.r AS y FROM c x JOIN c y ON x.d = y.d AND x.asset <= y.asset), {SAMPLE}, q AS (SELECT * FROM sv)""", "cov", keys="d, i, j"))  # fmt: skip
def v9(s, d):
    rows = C.robust(V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r"), "asset", "d", "r")
    return out(C.sample(C.pair_panel(rows, "asset", "d", "r_rob"), "d"))


@query("v11_vix_scaled", rsql(VIX + f""", pp AS (SELECT a.d, a.asset AS i, b.asset AS j, a.r AS x, b.r AS y FROM rr a JOIN rr b ON a.d = b.d AND a.asset <= b.asset), {SAMPLE}, vd AS (SELECT x.d, vix.vix FROM (SELECT DISTINCT d FROM rr) x ASOF LEFT JOIN vix ON x.d >= vix.d),
k AS (SELECT d, COALESCE(LEAST(GREATEST(POWER(vix / QUANTILE_CONT(vix, 0.5) OVER (ORDER BY d ROWS 251 PRECEDING), 2), 0.35), 4), 1) AS k FROM vd), q AS (SELECT sv.d, sv.i, sv.j, sv.cov * k.k AS cov FROM sv JOIN k ON k.d = sv.d)""", "cov", keys="d, i, j"))  # fmt: skip
def v11(s, d):
    c = C.sample(panel(s, d), "d").select("d", "i", "j", "cov")
    days = J.asof(c.select("d").distinct(), V.vix(s, d), [], "d", ["vix"])
    return out(C.vix_scaled(c, days, "d"))


def _ewm_sql(name: str, halflife: float) -> str:
    return EWM.replace("1 / 21.0", f"1 / {float(halflife)}").replace("ea ", f"{name}a ").replace("FROM ea", f"FROM {name}a").replace("eb ", f"{name}b ").replace("FROM eb", f"FROM {name}b").replace("ew2", name)


STRESS = """ewr AS (SELECT d, AVG(r) AS r FROM rr GROUP BY 1), sv21 AS (SELECT d, STDDEV_SAMP(r) OVER w * SQRT(252) AS s FROM ewr WINDOW w AS (ORDER BY d ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING))"""


def stress(s, d):
    """d, s: annual vol of the equal-weight return over the 21 rows before."""
    return B.proxy(V.returns(s, d).where("r IS NOT NULL").select("d", "asset", "r"), "d").select("d", F.col("proxy_vol").alias("s"))


@query("v10_regime_blend", rsql(f"""{PANEL}, {_ewm_sql('ef', 10)}, {_ewm_sql('es', 63)}, {STRESS}, q AS (SELECT f.d, f.i, f.j, CASE WHEN ROUND(s, 9) >= 0.04 THEN 0.75 * f.cov + 0.25 * l.cov ELSE 0.35 * f.cov + 0.65 * l.cov END AS cov
FROM ef f JOIN es l ON l.d = f.d AND l.i = f.i AND l.j = f.j JOIN sv21 ON sv21.d = f.d)""", "cov", keys="d, i, j"))
def v10(s, d):
    p = panel(s, d)
    share = stress(s, d).select("d", F.when(F.round("s", 9) >= 0.04, 0.75).otherwise(0.35).alias("p"))
    return out(C.regime_blend(C.ewma(p, "d", 10).where("cov IS NOT NULL"), C.ewma(p, "d", 63).where("cov IS NOT NULL"), share, "d"))


@query("v13_dynamic_blend", rsql(f"""{PANEL}, {EWM}, lw AS (WITH {LEDOIT} SELECT d, i, j, cov FROM q WHERE cov IS NOT NULL), dn AS (WITH {DOWN} SELECT d, i, j, cov FROM q WHERE cov IS NOT NULL), {STRESS},
kk AS (SELECT d, LEAST(GREATEST((s - 0.08) / 0.20, 0), 1) AS k FROM sv21 WHERE s IS NOT NULL), q AS (SELECT e.d, e.i, e.j, (0.45 - 0.20 * k) * e.cov + 0.35 * lw.cov + (0.20 + 0.20 * k) * dn.cov AS cov FROM ew2 e JOIN lw USING (d, i, j) JOIN dn USING (d, i, j) JOIN kk USING (d))""", "cov", keys="d, i, j"))  # fmt: skip
def v13(s, d):
    p = panel(s, d)
    parts = {"e": C.ewma(p, "d", 21), "l": C.ledoit_wolf(p, "d"), "w": C.downside(p, "d")}
    return out(C.dynamic_blend(parts["e"], parts["l"], parts["w"], stress(s, d), "d"))


@query("v12_v14_pca_psd")
def v12(s, d):
    m = C.packed(C.sample(panel(s, d), "d"), "d")
    fixed = C.matrix_map(C.matrix_map(m, "d", C.pca), "d", C.psd)
    return rounded(fixed.select("d", F.size("assets").alias("k"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x).alias("total")))


@query("v15_portfolio_vol", rsql(f"{PANEL}, {SAMPLE}, q AS (SELECT d, SQRT(GREATEST(SUM(CASE WHEN i = j THEN 1 ELSE 2 END * cov / 36), 0)) AS vol FROM sv WHERE cov IS NOT NULL GROUP BY 1)", "vol", keys="d"))
def v15(s, d):
    c = C.sample(panel(s, d), "d").where("cov IS NOT NULL").select("d", "i", "j", "cov")
    w = c.where("i = j").select("d", F.col("i").alias("asset"), F.lit(1 / 6).alias("weight"))
    return rounded(C.portfolio_vol(c, w, "d"))


@query("v16_mean_correlation", rsql(f"{PANEL}, c AS (SELECT d, CASE WHEN COUNT(*) OVER w >= 63 THEN CORR(x, y) OVER w END AS c FROM pp WHERE i < j WINDOW w AS ({WP} ROWS 62 PRECEDING)), q AS (SELECT d, AVG(ABS(c)) AS mean_corr, COUNT(c) AS pairs FROM c GROUP BY 1)", "mean_corr", keys="d, pairs"))
def v16(s, d):
    return rounded(C.mean_correlation(panel(s, d), "d"))


IV = """dg AS (SELECT d, i AS asset, 1 / SQRT(cov) AS raw FROM sv WHERE i = j AND cov > 0), iv AS (SELECT d, asset, raw / SUM(raw) OVER (PARTITION BY d) AS weight FROM dg)"""


def cov(s, d):
    return C.sample(panel(s, d), "d").where("cov IS NOT NULL").select("d", "i", "j", "cov")


@query("m1_m3_inverse_vol", rsql(f"{PANEL}, {SAMPLE}, {IV}, q AS (SELECT d, asset, weight, 1 / COUNT(*) OVER (PARTITION BY d) AS equal FROM iv)", "weight", "equal", keys="d, asset"))
def m1(s, d):
    from pyspark.sql import Window

    return rounded(B.inverse_vol(cov(s, d), "d").select("d", "asset", "weight", (1.0 / F.count("*").over(Window.partitionBy("d"))).alias("equal")))


@query("m0_capped_target", rsql(f"""{PANEL}, {SAMPLE}, {IV}, c1 AS (SELECT *, SUM(GREATEST(weight - 0.18, 0)) OVER d AS ov, SUM(CASE WHEN weight < 0.18 THEN weight ELSE 0 END) OVER d AS room FROM iv WINDOW d AS (PARTITION BY d)),
c2 AS (SELECT d, asset, CASE WHEN weight >= 0.18 THEN 0.18 ELSE weight + ov * weight / room END AS weight FROM c1),
c3 AS (SELECT *, SUM(GREATEST(weight - 0.18, 0)) OVER d AS ov, SUM(CASE WHEN weight < 0.18 THEN weight ELSE 0 END) OVER d AS room FROM c2 WINDOW d AS (PARTITION BY d)),
c4 AS (SELECT d, asset, CASE WHEN weight >= 0.18 THEN 0.18 ELSE CASE WHEN room > 1e-12 THEN weight + ov * weight / room ELSE weight END END AS weight FROM c3), q AS (SELECT * FROM c4)""", "weight", keys="d, asset"))
def m0(s, d):
    return rounded(B.capped(B.inverse_vol(cov(s, d), "d"), "d", 0.18, 2))


@query("m8_momentum_tilt", rsql(f"""{PANEL}, {SAMPLE}, {IV}, mo AS (SELECT asset, d, SUM(r) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS m FROM rr),
k AS (SELECT asset, d, (RANK() OVER (PARTITION BY d ORDER BY m) + (COUNT(*) OVER (PARTITION BY d, m) - 1) / 2) / COUNT(*) OVER (PARTITION BY d) AS k FROM mo WHERE m IS NOT NULL),
t AS (SELECT iv.d, iv.asset, weight * (1 + 0.5 * (2 * k - 1)) AS raw FROM iv JOIN k ON k.d = iv.d AND k.asset = iv.asset), q AS (SELECT d, asset, raw / SUM(raw) OVER (PARTITION BY d) AS weight FROM t)""", "weight", keys="d, asset"))
def m8(s, d):
    r = V.returns(s, d).where("r IS NOT NULL")
    return rounded(B.momentum_tilt(B.inverse_vol(cov(s, d), "d"), r, "d").select("d", "asset", "weight"))


@query("m4_m7_optimised")
def m4(s, d):
    m = C.packed(cov(s, d), "d")
    parts = [B.optimised(m, "d", f).withColumn("rule", F.lit(n)) for n, f in (("min_variance", B.min_variance), ("vol_capped", B.vol_capped), ("risk_parity", B.risk_parity), ("diversified", B.diversified))]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), 6)


HOLD = """, pw AS (SELECT 'inverse' AS portfolio, d, asset, weight FROM iv UNION ALL SELECT 'equal', d, asset, 1 / COUNT(*) OVER (PARTITION BY d) FROM iv),
mp AS (SELECT portfolio, d, MAP(list(asset ORDER BY asset), list(weight ORDER BY asset)) AS w, row_number() OVER (PARTITION BY portfolio ORDER BY d) AS i FROM pw GROUP BY 1, 2),
hy AS (SELECT portfolio, d, i, w AS h FROM mp WHERE i = 1 UNION ALL SELECT x.portfolio, x.d, x.i, CASE WHEN list_sum(list_transform(list_distinct(list_concat(map_keys(x.w), map_keys(f.h))), lambda k: ABS(COALESCE(x.w[k], 0) - COALESCE(f.h[k], 0)))) >= 0.05 THEN x.w ELSE f.h END FROM hy f JOIN mp x ON x.portfolio = f.portfolio AND x.i = f.i + 1),
q AS (SELECT portfolio, d, asset, FIRST_VALUE(weight) OVER (PARTITION BY portfolio, asset ORDER BY d) AS weight, 'hold' AS rule FROM pw UNION ALL SELECT portfolio, d, e.key, e.value, 'hysteresis' FROM (SELECT portfolio, d, unnest(map_entries(h)) AS e FROM hy))"""


@query("m2_m12_hold_rules", rsql(f"{PANEL}, {SAMPLE}, {IV}{HOLD}", "weight", digits=6, keys="portfolio, d, asset, rule").replace("WITH ", "WITH RECURSIVE ", 1))
def m2(s, d):
    """Two portfolios in one table."""
    from pyspark.sql import Window

    w = B.inverse_vol(cov(s, d), "d").select("d", "asset", "weight")
    equal = w.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("d")))
    w = w.withColumn("portfolio", F.lit("inverse")).unionByName(equal.withColumn("portfolio", F.lit("equal")))
    parts = [B.buy_and_hold(w, "d", ["portfolio"]).withColumn("rule", F.lit("hold")), B.hysteresis(w, "d", ["portfolio"]).withColumn("rule", F.lit("hysteresis"))]
    return rounded(parts[0].unionByName(parts[1]).select("portfolio", "d", "asset", "weight", "rule"), 6)


@query("m9_mean_variance")
def m9(s, d):
    r = V.returns(s, d).where("r IS NOT NULL").select("d", "asset", "r")
    return rounded(B.mean_variance(B.with_means(C.packed(cov(s, d), "d"), r, "d"), "d"), 6)


PROXY = """, ewr AS (SELECT d, AVG(r) AS r FROM rr GROUP BY 1), px2 AS (SELECT d, STDDEV_SAMP(r) OVER v * SQRT(252) AS pv, LIST(r) OVER w AS a FROM ewr WINDOW v AS (ORDER BY d ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING), w AS (ORDER BY d ROWS BETWEEN 126 PRECEDING AND 1 PRECEDING)),
pd AS (SELECT d, pv, CASE WHEN LEN(a) > 0 THEN list_reduce(list_transform(a, lambda x: {'e': x, 'p': x}), lambda s, x: {'e': s.e + x.e, 'p': GREATEST(s.p, s.e + x.e)}) END AS z FROM px2)"""


@query("m11_drawdown_brake", rsql(f"{PANEL}, {SAMPLE}, {IV}{PROXY}, q AS (SELECT iv.d, iv.asset, iv.weight * CASE WHEN ROUND(EXP(z.e - z.p) - 1, 9) < -0.002 THEN 0.55 ELSE 1 END AS weight FROM iv JOIN pd ON pd.d = iv.d)", "weight", keys="d, asset"))
def m11(s, d):
    r = V.returns(s, d).where("r IS NOT NULL").select("d", "asset", "r")
    p = B.proxy(r, "d").withColumn("proxy_drawdown", F.round("proxy_drawdown", 9))
    return rounded(B.braked(B.inverse_vol(cov(s, d), "d").select("d", "asset", "weight"), p, "d", trigger=0.002))


@query("m10_risk_budget")
def m10(s, d):
    """The defensive assets of a date are the two of least vol over the 252 rows before it."""
    from pyspark.sql import Window

    r = V.returns(s, d).where("r IS NOT NULL").select("d", "asset", "r")
    past = r.select("d", "asset", F.stddev_samp("r").over(roll(along(K, "d"), 252, 1)).alias("v"))
    base = B.optimised(C.packed(cov(s, d), "d"), "d", B.risk_parity).join(past, ["d", "asset"])
    calm = F.rank().over(Window.partitionBy("d").orderBy(F.round("v", 9))) <= 2
    return rounded(B.risk_budget(base, B.proxy(r, "d"), "d", calm, high=0.04), 6)


PL = """wr AS (SELECT rr.d, rr.asset, rr.r, COALESCE(iv.weight, 0) AS weight FROM rr LEFT JOIN iv ON iv.d = rr.d AND iv.asset = rr.asset), wx AS (SELECT *, ABS(weight - COALESCE(LAG(weight) OVER w, 0)) AS dw, COALESCE(LAG(weight) OVER w * r, 0) AS g FROM wr WINDOW w AS (PARTITION BY asset ORDER BY d)),
dy AS (SELECT d, SUM(ABS(weight)) AS gross, SUM(dw) AS turnover, SUM(g) AS gain FROM wx GROUP BY 1), dz AS (SELECT *, gain - COALESCE(LAG(turnover * 0.0005) OVER (ORDER BY d), 0) AS ret FROM dy),
pl AS (SELECT d, gross, 1 - gross AS cash, turnover, turnover * 0.0005 AS cost, ret, EXP(SUM(ret) OVER (ORDER BY d)) AS equity, CASE WHEN COUNT(ret) OVER w >= 63 THEN STDDEV_SAMP(ret) OVER w * SQRT(252) END AS window_vol FROM dz WINDOW w AS (ORDER BY d ROWS 62 PRECEDING))"""


@query("m13_portfolio_ledger", rsql(f"{PANEL}, {SAMPLE}, {IV}, {PL}, q AS (SELECT * FROM pl)", "gross", "cash", "turnover", "cost", "ret", "equity", "window_vol", digits=7, keys="d"))
def m13(s, d):
    r = V.returns(s, d).where("r IS NOT NULL")
    return rounded(B.portfolio_ledger(B.inverse_vol(cov(s, d), "d").select("d", "asset", "weight"), r, "d"), 7)


@query("m15_vol_calibration", rsql(R + """, f AS (SELECT asset, LEAST(GREATEST(0.1 / GREATEST(STDDEV_SAMP(r) * SQRT(252), 1e-8), 0.5), 2) AS m FROM rr WHERE rn <= 252 GROUP BY 1),
q AS (SELECT rr.asset, rr.d, m AS multiplier, r * m AS ret_cal, EXP(SUM(r * m) OVER (PARTITION BY rr.asset ORDER BY d)) AS equity_cal FROM rr JOIN f ON f.asset = rr.asset)""", "multiplier", "ret_cal", "equity_cal", digits=7, keys="asset, d"))
def m15(s, d):
    led = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", F.col("r").alias("ret"))
    return rounded(B.calibrated(led, K, "d"), 7)
