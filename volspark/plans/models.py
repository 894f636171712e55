"""Queries of the forecast, regime, ensemble and diagnostic operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import along, roll, std
from ..operators import diagnostics as G
from ..operators import ensemble as T
from ..operators import forecast as E
from ..operators import regimes as R_
from ..operators import windows as W
from ..sources import views as V
from .registry import BARS, LEDGER, R, query, rounded, rsql

K = ["asset"]
WD = "PARTITION BY asset ORDER BY d"


def rets(s, d):
    return V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")


@query("e1_e2_e20_window_vols", rsql(R + f""", q AS (SELECT asset, d, CASE WHEN COUNT(r) OVER w >= 20 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS rv20,
CASE WHEN COUNT(r) OVER w >= 20 THEN SQRT(AVG(r * r) OVER w * 252) END AS naive20, 0.1::DOUBLE AS hold FROM rr WINDOW w AS ({WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""", "rv20", "naive20", "hold", keys="asset, d"))  # fmt: skip
def e1(s, d):
    r = F.col("r")
    return rounded(rets(s, d).select("asset", "d", E.realized(r, K, "d").alias("rv20"), E.naive(r, K, "d").alias("naive20"), F.lit(0.1).alias("hold")))


@query("e0_carried_forecast", rsql(R + f""", v AS (SELECT asset, d, rn, CASE WHEN COUNT(r) OVER w >= 20 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS v FROM rr WINDOW w AS ({WD} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, MAX(CASE WHEN DAYOFWEEK(d) = 1 THEN rn END) OVER ({WD} ROWS UNBOUNDED PRECEDING) AS k FROM v),
q AS (SELECT g.asset, g.d, v.v AS vol_held FROM g LEFT JOIN v ON v.asset = g.asset AND v.rn = g.k)""", "vol_held", keys="asset, d"))  # fmt: skip
def e0(s, d):
    rows = rets(s, d).withColumn("vol", E.realized(F.col("r"), K, "d"))
    return rounded(E.carried(rows, K, "d", "vol", F.weekday("d") == 0).select("asset", "d", "vol_held"))


@query("e3_ewma_window", rsql(R + f""", l AS (SELECT asset, d, LIST(r * r) OVER ({WD} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS a FROM rr),
q AS (SELECT asset, d, CASE WHEN LEN(a) >= 2 THEN SQRT(list_reduce(a, lambda s, x: POWER(0.5, 1 / 20.0) * s + (1 - POWER(0.5, 1 / 20.0)) * x) * 252) END AS ewma FROM l)""", "ewma", keys="asset, d"))  # fmt: skip
def e3(s, d):
    return rounded(rets(s, d).select("asset", "d", E.ewma_window(F.col("r"), K, "d", 63).alias("ewma")))


@query("e4_ar1", rsql(R + f""", y AS (SELECT asset, d, r * r AS y, LAG(r * r) OVER ({WD}) AS x FROM rr),
f AS (SELECT asset, d, COUNT(x) OVER w AS n, REGR_INTERCEPT(y, x) OVER w AS a, REGR_SLOPE(y, x) OVER w AS b, LAG(y, 2) OVER ({WD}) AS l FROM y WINDOW w AS ({WD} ROWS BETWEEN 125 PRECEDING AND 1 PRECEDING)),
q AS (SELECT asset, d, CASE WHEN n >= 125 THEN SQRT(GREATEST(a + b * l, 1e-9) * 252) END AS ar1 FROM f)""", "ar1", digits=6, keys="asset, d"))  # fmt: skip
def e4(s, d):
    return rounded(E.ar1(rets(s, d), K, "d", "r", 126).select("asset", "d", "ar1"), 6)


@query("e5_ar2", rsql(R + f""", y AS (SELECT asset, d, r * r AS y, LAG(r * r) OVER ({WD}) AS u, LAG(r * r, 2) OVER ({WD}) AS v FROM rr),
c AS (SELECT asset, d, COUNT(v) OVER w AS n, COVAR_SAMP(u, u) OVER w AS uu, COVAR_SAMP(v, v) OVER w AS vv, COVAR_SAMP(u, v) OVER w AS uv, COVAR_SAMP(u, y) OVER w AS uy, COVAR_SAMP(v, y) OVER w AS vy,
AVG(u) OVER w AS mu, AVG(v) OVER w AS mv, AVG(y) OVER w AS my, LAG(y, 2) OVER ({WD}) AS l2, LAG(y, 3) OVER ({WD}) AS l3 FROM y WINDOW w AS ({WD} ROWS BETWEEN 124 PRECEDING AND 1 PRECEDING)),
q AS (SELECT asset, d, CASE WHEN n >= 124 THEN SQRT(GREATEST(my + (uy * vv - vy * uv) / (uu * vv - uv * uv) * (l2 - mu) + (vy * uu - uy * uv) / (uu * vv - uv * uv) * (l3 - mv), 1e-9) * 252) END AS ar2 FROM c)""", "ar2", digits=6, keys="asset, d"))  # fmt: skip
def e5(s, d):
    return rounded(E.ar2(rets(s, d), K, "d", "r", 126).select("asset", "d", "ar2"), 6)


@query("e6_har_ridge")
def e6(s, d):
    return rounded(E.har(rets(s, d), K, "d", "r").select("asset", "d", "har"), 6)


@query("e8_regime_har")
def e8(s, d):
    rows = rets(s, d).withColumn("rv5", std(F.col("r"), roll(along(K, "d"), 5), 5))
    rows = R_.trailing_bucket(rows, K, "d", "rv5", 252, 0.33, 0.67, out="state")
    return rounded(E.har(rows, K, "d", "r", label="state").select("asset", "d", "state", "har"), 6)


GARCH = """p(o, a, b) AS (VALUES (1e-7, 0.05, 0.90), (1e-6, 0.10, 0.85), (1e-6, 0.15, 0.70)),
s0 AS (SELECT asset, AVG(r * r) AS v FROM rr WHERE rn <= 20 GROUP BY 1)"""


@query("e9_garch_filter", f"""WITH RECURSIVE {R}, {GARCH}, f AS (SELECT rr.asset, rr.d, rr.rn, rr.r, o, a, b, s0.v FROM rr JOIN s0 USING (asset), p WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, n.r, f.o, f.a, f.b, GREATEST(f.o + f.a * f.r * f.r + f.b * f.v, 1e-18) FROM f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1)
SELECT asset, d, CAST(o AS DOUBLE) AS omega, CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, ROUND(SQRT(v * 252), 7) + 0.0 AS garch FROM f""")  # fmt: skip
def e9(s, d):
    return rounded(_garch(s, d).select("asset", "d", "omega", "alpha", "beta", "garch"), 7)


def _garch(s, d, gamma: float | None = None):
    grid = F.array(*[F.struct(F.lit(o).alias("omega"), F.lit(a).alias("alpha"), F.lit(b).alias("beta")) for o, a, b in ((1e-7, 0.05, 0.90), (1e-6, 0.10, 0.85), (1e-6, 0.15, 0.70))])
    rows = rets(s, d).select("asset", "d", "r", F.inline(grid))
    if gamma is not None:
        rows = rows.withColumn("gamma", F.lit(gamma))
    return E.garch_filter(rows, ["asset", "omega", "alpha", "beta"], "d", "r", "omega", "alpha", "beta", "gamma" if gamma is not None else None)


@query("e9_garch_selection", f"""WITH RECURSIVE {R}, {GARCH}, f AS (SELECT rr.asset, rr.rn, rr.r, o, a, b, s0.v FROM rr JOIN s0 USING (asset), p WHERE rn = 1 UNION ALL
SELECT n.asset, n.rn, n.r, f.o, f.a, f.b, GREATEST(f.o + f.a * f.r * f.r + f.b * f.v, 1e-18) FROM f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1),
t AS (SELECT asset, o, a, b, ROUND(SUM(-0.5 * (LN(2 * PI() * v) + r * r / v)), 6) AS loglik FROM f GROUP BY ALL)
SELECT asset, CAST(o AS DOUBLE) AS omega, CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, ROUND(loglik, 4) AS loglik FROM t QUALIFY row_number() OVER (PARTITION BY asset ORDER BY loglik DESC, o, a, b) = 1""")  # fmt: skip
def e9s(s, d):
    return rounded(E.best_by_likelihood(_garch(s, d), K, ["omega", "alpha", "beta"]), 8, loglik=4)


@query("e10_gjr_filter", f"""WITH RECURSIVE {R}, {GARCH}, f AS (SELECT rr.asset, rr.d, rr.rn, rr.r, o, a, b, s0.v FROM rr JOIN s0 USING (asset), p WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, n.r, f.o, f.a, f.b, GREATEST(f.o + (f.a + CASE WHEN f.r < 0 THEN 0.05 ELSE 0 END) * f.r * f.r + f.b * f.v, 1e-18) FROM f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1)
SELECT asset, d, CAST(o AS DOUBLE) AS omega, CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, ROUND(SQRT(v * 252), 7) + 0.0 AS garch FROM f""")  # fmt: skip
def e10(s, d):
    return rounded(_garch(s, d, 0.05).select("asset", "d", "omega", "alpha", "beta", "garch"), 7)


@query("e12_hybrid_blend", f"""WITH RECURSIVE {R}, f AS (SELECT asset, d, rn, r * r AS a, r * r AS b FROM rr WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, POWER(0.5, 1 / 5.0) * f.a + (1 - POWER(0.5, 1 / 5.0)) * n.r * n.r, POWER(0.5, 1 / 60.0) * f.b + (1 - POWER(0.5, 1 / 60.0)) * n.r * n.r FROM f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1),
g AS (SELECT *, ABS(LN((a + 1e-18) / (b + 1e-18))) AS g FROM f), z AS (SELECT *, AVG(g) OVER w AS m, STDDEV_SAMP(g) OVER w AS sd FROM g WINDOW w AS ({WD} ROWS 125 PRECEDING)),
p AS (SELECT *, 1 / (1 + EXP(-0.5 * CASE WHEN sd > 1e-12 THEN (g - m) / sd ELSE 0 END)) AS p FROM z)
SELECT asset, d, ROUND(SQRT((p * a + (1 - p) * b) * 252), 7) + 0.0 AS hybrid FROM p""")  # fmt: skip
def e12(s, d):
    return rounded(E.hybrid(rets(s, d), K, "d", "r").select("asset", "d", "hybrid"), 7)


@query("e13_precision_ensemble", rsql(LEDGER + f""", m AS (SELECT asset, d, r, 'rv20' AS model, rv20 AS f FROM vols UNION ALL SELECT asset, d, r, 'rv60', rv60 FROM vols),
l AS (SELECT *, COALESCE(CASE WHEN f * f / 252 > 0 THEN LN(GREATEST(f * f / 252, 1e-12)) + r * r / GREATEST(f * f / 252, 1e-12) END, 1e6) AS loss FROM m),
s AS (SELECT *, SUM(loss) OVER (PARTITION BY asset, model ORDER BY d ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING) AS sl FROM l),
w AS (SELECT *, CASE WHEN f IS NOT NULL AND sl IS NOT NULL THEN 1 / GREATEST(sl, 1e-8) END AS wt FROM s), q AS (SELECT asset, d, SUM(wt * f) / SUM(wt) AS ensemble FROM w GROUP BY 1, 2)""", "ensemble", keys="asset, d"))  # fmt: skip
def e13(s, d):
    r = F.col("r")
    rows = rets(s, d).withColumns({"rv20": E.realized(r, K, "d", 20), "rv60": E.realized(r, K, "d", 60)})
    return rounded(E.precision_ensemble(rows, K, "d", "r", ["rv20", "rv60"]))


@query("e14_lasso_forecast")
def e14(s, d):
    rows = E.feature_table(rets(s, d), K, "d", "r", 22)
    return rounded(E.learned(rows, K, "d", [f"sq_{k}" for k in range(22)], "target", ["1998-01-01", "2000-01-01"], "lasso").select("asset", "d", "forecast"), 6)


@query("e15_boosted_forecast")
def e15(s, d):
    rows = E.feature_table(rets(s, d), K, "d", "r")
    feats = [c for c in rows.columns if c[:2] in ("r_", "sq", "ab", "rv")]
    return rounded(E.learned(rows, K, "d", feats, "target", ["1999-01-01"], "gbt", decay=0.999).select("asset", "d", "forecast"), 6)


@query("e16_forest_forecast")
def e16(s, d):
    rows = E.feature_table(rets(s, d), K, "d", "r")
    return rounded(E.learned(rows, K, "d", ["rv_5", "rv_21", "rv_63", "abs_0"], "target", ["1999-01-01"], "forest").select("asset", "d", "forecast"), 6)


@query("e18_daily_variance", rsql(LEDGER + """, m AS (SELECT asset, QUANTILE_CONT(rv20, 0.5) AS m FROM vols GROUP BY 1), q AS (SELECT asset, d, CASE WHEN m > 0.01 THEN rv20 * rv20 / 252 ELSE rv20 END AS vol_var FROM vols JOIN m USING (asset))""", "vol_var", digits=10, keys="asset, d"))
def e18(s, d):
    rows = rets(s, d).withColumn("vol", E.realized(F.col("r"), K, "d", 20))
    return rounded(E.daily_variance(rows, K, "vol").select("asset", "d", "vol_var"), 10)


@query("e19_sequences", rsql(R + f""", l AS (SELECT asset, d, LIST(r) OVER w AS a FROM rr WINDOW w AS ({WD} ROWS BETWEEN 21 PRECEDING AND 1 PRECEDING)),
q AS (SELECT asset, d, CASE WHEN LEN(a) = 21 THEN list_sum(list_transform(a, lambda x, i: x * i)) END AS checksum FROM l)""", "checksum", keys="asset, d"))  # fmt: skip
def e19(s, d):
    rows = E.sequences(rets(s, d), K, "d", [F.col("r"), F.col("r") * F.col("r")])
    parts = F.transform("seq", lambda x, i: x[0] * (i + 1))
    return rounded(rows.select("asset", "d", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x).alias("checksum")))


@query("e21_intraday_vol", rsql(BARS + f""", a AS (SELECT asset, d, CASE WHEN coverage >= 0.5 THEN rv END AS rv FROM bars), b AS (SELECT asset, d, AVG(rv) OVER w * SQRT(252) AS v FROM a WINDOW w AS ({WD} ROWS 4 PRECEDING)),
c AS (SELECT asset, d, LAG(v) OVER ({WD}) AS v FROM b), q AS (SELECT asset, d, LAST_VALUE(v IGNORE NULLS) OVER ({WD}) AS intraday_vol FROM c)""", "intraday_vol", digits=6, keys="asset, d"))  # fmt: skip
def e21(s, d):
    return rounded(E.intraday(V.bars(s, d), K, "d", "rv", "coverage").select("asset", "d", "intraday_vol"), 6)


@query("e22_range_vol", rsql(BARS + f""", v AS (SELECT asset, d, GREATEST(POWER(LN(high / low), 2) / (4 * LN(2)), 0) AS p, GREATEST(0.5 * POWER(LN(high / low), 2) - (2 * LN(2) - 1) * POWER(LN(close / open), 2), 0) AS g FROM bars),
a AS (SELECT asset, d, CASE WHEN COUNT(p) OVER w >= 5 THEN SQRT(AVG(p) OVER w * 252) END AS p, CASE WHEN COUNT(g) OVER w >= 5 THEN SQRT(AVG(g) OVER w * 252) END AS g FROM v WINDOW w AS ({WD} ROWS 9 PRECEDING)),
q AS (SELECT asset, d, LAG(p) OVER ({WD}) AS parkinson, LAG(g) OVER ({WD}) AS garman_klass FROM a)""", "parkinson", "garman_klass", digits=6, keys="asset, d"))  # fmt: skip
def e22(s, d):
    rows = E.range_based(V.bars(s, d), K, "d", "parkinson", 10).withColumnRenamed("range_vol", "parkinson")
    rows = E.range_based(rows, K, "d", "garman_klass", 10).withColumnRenamed("range_vol", "garman_klass")
    return rounded(rows.select("asset", "d", "parkinson", "garman_klass"), 6)


@query("e23_composite", rsql(LEDGER + """, q AS (SELECT asset, d, CASE WHEN COALESCE(rv20, rv60) IS NOT NULL THEN LEAST(GREATEST(COALESCE(0.6 * rv20, 0) + COALESCE(0.4 * rv60, 0), 0.01), 5) END AS composite FROM vols)""", "composite", keys="asset, d"))
def e23(s, d):
    r = F.col("r")
    rows = rets(s, d).withColumns({"rv20": E.realized(r, K, "d", 20), "rv60": E.realized(r, K, "d", 60)})
    return rounded(rows.select("asset", "d", E.composite({"rv20": 0.6, "rv60": 0.4}).alias("composite")))


BUCKET = """c AS (SELECT asset, QUANTILE_CONT(rv20, 0.3) AS lo, QUANTILE_CONT(rv20, 0.7) AS hi FROM vols GROUP BY 1),
bk AS (SELECT vols.*, CASE WHEN rv20 >= hi THEN 'high' WHEN rv20 <= lo THEN 'low' ELSE 'mid' END AS bucket FROM vols JOIN c USING (asset))"""


@query("r1_r2_r8_vol_buckets", f"""WITH {LEDGER}, {BUCKET} SELECT asset, d, bucket, CASE WHEN rv20 / p - 1 > 0.05 THEN 'rising' WHEN rv20 / p - 1 < -0.05 THEN 'falling' ELSE 'flat' END AS trend
FROM (SELECT *, LAG(rv20, 5) OVER ({WD}) AS p FROM bk)""")  # fmt: skip
def r1(s, d):
    rows = rets(s, d).withColumn("rv20", E.realized(F.col("r"), K, "d", 20))
    return R_.bucket(rows, K, "rv20").select("asset", "d", "bucket", R_.vol_trend("rv20", K, "d").alias("trend"))


@query("r5_rule_list", f"""WITH {LEDGER}, {BUCKET}, x AS (SELECT *, LAG(rv20, 5) OVER ({WD}) AS p FROM bk)
SELECT asset, d, CASE WHEN bucket = 'high' AND rv20 / p - 1 > 0.05 THEN 'stress' WHEN rv20 / p - 1 > 0.05 THEN 'transition' WHEN bucket = 'low' THEN 'calm' ELSE 'normal' END AS regime FROM x""")  # fmt: skip
def r5(s, d):
    rows = rets(s, d).withColumn("rv20", E.realized(F.col("r"), K, "d", 20))
    rows = R_.bucket(rows, K, "rv20").withColumn("trend", R_.vol_trend("rv20", K, "d"))
    up = F.col("trend") == "rising"
    rules = [(F.col("bucket") == "low", "calm"), (up, "transition"), (up & (F.col("bucket") == "high"), "stress")]
    return rows.select("asset", "d", R_.rule_list(rules).alias("regime"))


@query("r6_r7_change_point", rsql(R + f""", z0 AS (SELECT asset, d, CASE WHEN COUNT(r) OVER w >= 7 AND STDDEV_SAMP(r) OVER w > 0 THEN (r - AVG(r) OVER w) / STDDEV_SAMP(r) OVER w END AS z FROM rr WINDOW w AS ({WD} ROWS 20 PRECEDING)),
q AS (SELECT asset, d, z, 1 - EXP(-ABS(z)) AS change_score, COALESCE(ABS(z) >= 2.5, FALSE) AS is_change FROM z0)""", "z", "change_score", digits=6, keys="asset, d, is_change"))  # fmt: skip
def r6(s, d):
    return rounded(R_.change_point(rets(s, d), K, "d", "r").select("asset", "d", "z", "change_score", "is_change"), 6)


@query("r9_hmm_filter", f"""WITH RECURSIVE {R}, f AS (SELECT asset, d, rn, (0.5 * (EXP(-0.5 * POWER(r / 0.008, 2)) / 0.008)) / (0.5 * (EXP(-0.5 * POWER(r / 0.008, 2)) / 0.008) + 0.5 * (EXP(-0.5 * POWER(r / 0.004, 2)) / 0.004)) AS p FROM rr WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, ((f.p * 0.97 + (1 - f.p) * 0.03) * (EXP(-0.5 * POWER(n.r / 0.008, 2)) / 0.008)) / ((f.p * 0.97 + (1 - f.p) * 0.03) * (EXP(-0.5 * POWER(n.r / 0.008, 2)) / 0.008) + (1 - (f.p * 0.97 + (1 - f.p) * 0.03)) * (EXP(-0.5 * POWER(n.r / 0.004, 2)) / 0.004))
FROM f JOIN rr n ON n.asset = f.asset AND n.rn = f.rn + 1) SELECT asset, d, ROUND(p, 6) + 0.0 AS p_stress FROM f""")  # fmt: skip
def r9(s, d):
    return rounded(R_.hmm_filter(rets(s, d), K, "d", "r", (0.0, 0.0), (0.004, 0.008)).select("asset", "d", "p_stress"), 6)


@query("r10_persistence", f"""WITH RECURSIVE {R}, lab AS (SELECT asset, d, rn, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS label FROM rr),
f AS (SELECT asset, d, rn, label, 1 AS run, label AS held FROM lab WHERE rn = 1 UNION ALL
SELECT n.asset, n.d, n.rn, n.label, CASE WHEN n.label = f.label THEN f.run + 1 ELSE 1 END, CASE WHEN n.label <> f.held AND CASE WHEN n.label = f.label THEN f.run + 1 ELSE 1 END >= 3 THEN n.label ELSE f.held END
FROM f JOIN lab n ON n.asset = f.asset AND n.rn = f.rn + 1) SELECT asset, d, held AS label_held FROM f""")  # fmt: skip
def r10(s, d):
    rows = rets(s, d).withColumn("label", F.when(F.col("r") > 0, "up").otherwise("down"))
    return R_.persistent(rows, K, "d", "label").select("asset", "d", "label_held")


@query("r11_gmm_states")
def r11(s, d):
    r = F.col("r")
    rows = rets(s, d).withColumns({"rv5": E.realized(r, K, "d", 5), "rv60": E.realized(r, K, "d", 60)})
    return R_.clusters(rows, ["rv5", "rv60"], "rv60", 3, "gmm").select("asset", "d", "state")


@query("r12_kmeans_states")
def r12(s, d):
    r = F.col("r")
    rows = rets(s, d).withColumns({"rv5": E.realized(r, K, "d", 5), "rv60": E.realized(r, K, "d", 60)})
    return R_.clusters(rows, ["rv5", "rv60"], "rv60", 3).select("asset", "d", "state")


@query("r13_bocpd")
def r13(s, d):
    rows = rets(s, d).withColumn("spread", std(F.col("r"), roll(along(K, "d"), 252, 1), 20))
    return rounded(R_.bocpd(rows, K, "d", "r", scale="spread").select("asset", "d", "p_change"), 6)


@query("r14_stress_score", rsql(LEDGER + f""", x AS (SELECT asset, d, rv20, rv60 - rv20 AS vrp FROM vols WHERE rv60 IS NOT NULL), l AS (SELECT *, LIST(rv20) OVER w AS a, LIST(vrp) OVER w AS b FROM x WINDOW w AS ({WD} ROWS 125 PRECEDING)),
k AS (SELECT asset, d, CASE WHEN LEN(a) >= 126 THEN 0.6 * (LEN(LIST_FILTER(a, lambda y: y < rv20)) + (LEN(LIST_FILTER(a, lambda y: y = rv20)) + 1) / 2) / 126 + 0.4 * (1 - (LEN(LIST_FILTER(b, lambda y: y < vrp)) + (LEN(LIST_FILTER(b, lambda y: y = vrp)) + 1) / 2) / 126) END AS s FROM l),
q AS (SELECT asset, d, CASE WHEN COUNT(s) OVER w >= 5 THEN AVG(s) OVER w END AS stress FROM k WINDOW w AS ({WD} ROWS 4 PRECEDING))""", "stress", digits=6, keys="asset, d"))  # fmt: skip
def r14(s, d):
    r = F.col("r")
    rows = rets(s, d).withColumns({"rv20": E.realized(r, K, "d", 20), "rv60": E.realized(r, K, "d", 60)}).where("rv60 IS NOT NULL")
    return rounded(R_.stress_score(rows.withColumn("vrp", F.col("rv60") - F.col("rv20")), K, "d", "rv20", "vrp").select("asset", "d", "stress"), 6)


MODELS = """fm AS (SELECT asset, d, r, 'rv20' AS model, rv20 AS f FROM vols UNION ALL SELECT asset, d, r, 'rv60', rv60 FROM vols UNION ALL SELECT asset, d, r, 'naive20', naive20 FROM vols)"""


def models(s, d):
    r = F.col("r")
    rows = rets(s, d).withColumns({"rv20": E.realized(r, K, "d", 20), "rv60": E.realized(r, K, "d", 60), "naive20": E.naive(r, K, "d", 20)})
    return rows.unpivot(["asset", "d", "r"], ["rv20", "rv60", "naive20"], "model", "f")


@query("t1_component_forecasts", rsql(R + f""", q AS (SELECT asset, d, CASE WHEN COUNT(r) OVER w >= 2 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS rv, CASE WHEN COUNT(r) OVER w >= 2 THEN SQRT(AVG(r * r) OVER w * 252) END AS naive
FROM rr WINDOW w AS ({WD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""", "rv", "naive", keys="asset, d"))  # fmt: skip
def t1(s, d):
    return rounded(T.expanding_components(rets(s, d), K, "d", "r").select("asset", "d", "rv", "naive"))


@query("t2_equal_weight", rsql(LEDGER + ", " + MODELS + ", q AS (SELECT asset, d, AVG(f) AS ensemble FROM fm GROUP BY 1, 2)", "ensemble", keys="asset, d"))
def t2(s, d):
    return rounded(T.equal_weight(models(s, d), K, "d", "f"))


@query("t3_static_weights", rsql(LEDGER + ", " + MODELS + """, l AS (SELECT asset, model, AVG(POWER(f * f / 252 - r * r, 2)) AS mse FROM fm WHERE f > 0 AND d < DATE '1998-01-01' GROUP BY 1, 2),
w AS (SELECT asset, model, (1 / GREATEST(mse, 1e-18)) / SUM(1 / GREATEST(mse, 1e-18)) OVER (PARTITION BY asset) AS w FROM l),
q AS (SELECT fm.asset, fm.d, SUM(w * COALESCE(f, 0)) AS ensemble FROM fm JOIN w USING (asset, model) GROUP BY 1, 2)""", "ensemble", digits=7, keys="asset, d"))  # fmt: skip
def t3(s, d):
    rows = models(s, d)
    return rounded(T.static_weighted(rows, T.inverse_loss_weights(rows.where("d < DATE'1998-01-01'"), K, "model", "f", "r"), K, "d", "model", "f"), 7)


@query("t4_regime_weighted", rsql(LEDGER + ", " + BUCKET + ", " + MODELS + """, w(regime, model, w) AS (VALUES ('low', 'rv20', 0.2), ('low', 'rv60', 0.8), ('mid', 'rv20', 0.5), ('mid', 'rv60', 0.5), ('high', 'rv20', 0.9), ('high', 'naive20', 0.1)),
q AS (SELECT fm.asset, fm.d, SUM(w * COALESCE(f, 0))::DOUBLE AS ensemble FROM fm JOIN bk ON bk.asset = fm.asset AND bk.d = fm.d JOIN w ON w.regime = bk.bucket AND w.model = fm.model GROUP BY 1, 2)""", "ensemble", digits=7, keys="asset, d"))  # fmt: skip
def t4(s, d):
    table = s.createDataFrame([("low", "rv20", 0.2), ("low", "rv60", 0.8), ("mid", "rv20", 0.5), ("mid", "rv60", 0.5), ("high", "rv20", 0.9), ("high", "naive20", 0.1)], "regime string, model string, w double")
    lab = R_.bucket(rets(s, d).withColumn("rv20", E.realized(F.col("r"), K, "d", 20)), K, "rv20", out="regime")
    return rounded(T.regime_weighted(models(s, d), lab, table, K, "d", "regime", "model", "f"), 7)


EVAL = """ev AS (SELECT asset, model, f * f / 252 AS v, r * r AS y, f, ABS(r) * SQRT(252) AS a FROM fm WHERE f > 0), em AS (SELECT *, AVG(y) OVER (PARTITION BY asset, model) AS m FROM ev),
eval AS (SELECT asset, model, COUNT(*) AS n, AVG(POWER(y - v, 2)) AS mse_var, AVG(ABS(f - a)) AS mae_vol, AVG(LN(GREATEST(v, 1e-12)) + y / GREATEST(v, 1e-12)) AS qlike, CORR(f, a) AS corr_vol, CORR(v, y) AS corr_var, AVG(POWER(y - m, 2)) AS mse_const,
REGR_INTERCEPT(y, v) AS mz_alpha, REGR_SLOPE(y, v) AS mz_beta, REGR_R2(y, v) AS mz_r2 FROM em GROUP BY 1, 2)"""


@query("g1_g2_t5_forecast_evaluation", rsql(LEDGER + ", " + MODELS + ", " + EVAL + ", q AS (SELECT *, mse_var / mse_const AS rel_mse, 1 - mse_var / mse_const AS oos_r2, CAST(row_number() OVER (PARTITION BY asset ORDER BY qlike, model) AS INT) AS rank FROM eval)",
    "mse_var", "mae_vol", "qlike", "corr_vol", "corr_var", "mz_alpha", "mz_beta", "mz_r2", "rel_mse", "oos_r2", digits=6, keys="asset, model, n, rank"))
def g1(s, d):
    out = G.top_by(G.evaluate(models(s, d), ["asset", "model"], "f", "r"), K, [F.col("qlike"), F.col("model")], 100)
    return rounded(out.drop("mse_const"), 6)


VIOL = """vl AS (SELECT asset, model, d, CAST(r < -1.645 * f / SQRT(252) AS INT) AS v FROM fm WHERE f IS NOT NULL), vp AS (SELECT *, LAG(v) OVER (PARTITION BY asset, model ORDER BY d) AS p FROM vl),
vc AS (SELECT asset, model, COUNT(*) AS n, SUM(v) AS x, COUNT(*) FILTER (p = 0 AND v = 0) AS a, COUNT(*) FILTER (p = 0 AND v = 1) AS b, COUNT(*) FILTER (p = 1 AND v = 0) AS c, COUNT(*) FILTER (p = 1 AND v = 1) AS e FROM vp GROUP BY 1, 2)"""


def _xl(x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 THEN ({x}) * LN(GREATEST({y}, 1e-12)) ELSE 0 END"


_P01, _P11, _PI = "(b / GREATEST(a + b, 1))", "(e / GREATEST(c + e, 1))", "((b + e) / GREATEST(a + b + c + e, 1))"


@query("g3_g4_coverage_tests", rsql(LEDGER + ", " + MODELS + ", " + VIOL + f""", q AS (SELECT asset, model, n, CAST(x AS BIGINT) AS violations, x / n AS violation_rate,
GREATEST(2 * ({_xl('n - x', '1 - x / n')} + {_xl('x', 'x / n')} - {_xl('n - x', '0.95')} - {_xl('x', '0.05')}), 0) AS kupiec_lr,
GREATEST(2 * ({_xl('a', '1 - ' + _P01)} + {_xl('b', _P01)} + {_xl('c', '1 - ' + _P11)} + {_xl('e', _P11)} - {_xl('a + c', '1 - ' + _PI)} - {_xl('b + e', _PI)}), 0) AS christoffersen_lr FROM vc)""",
    "violation_rate", "kupiec_lr", "christoffersen_lr", digits=6, keys="asset, model, n, violations"))
def g3(s, d):
    return rounded(G.coverage_tests(G.violations(models(s, d), ["asset", "model"], "d", "r", "f"), ["asset", "model"]), 6)


@query("g5_turning_delay", rsql(LEDGER + f""", nx AS (SELECT asset, d, rv20 AS f, LEAD(rv20) OVER ({WD}) AS y FROM vols), x AS (SELECT asset, d, SIGN(f - LAG(f) OVER ({WD})) AS sf, SIGN(y - LAG(y) OVER ({WD})) AS sr FROM nx WHERE f IS NOT NULL AND y IS NOT NULL),
l AS ({' UNION ALL '.join(f"SELECT asset, {k} AS k, sr, LEAD(sf, {k}) OVER ({WD}) AS sf FROM x" for k in range(11))}), c AS (SELECT asset, k, COALESCE(ROUND(CORR(sr, sf), 10), -2) AS c FROM l GROUP BY 1, 2),
q AS (SELECT asset, k AS delay, c AS corr FROM c QUALIFY row_number() OVER (PARTITION BY asset ORDER BY c DESC, k) = 1)""", "corr", digits=6, keys="asset, delay"))  # fmt: skip
def g5(s, d):
    rows = rets(s, d).withColumn("f", E.realized(F.col("r"), K, "d", 20))
    rows = rows.withColumn("y", F.lead("f").over(along(K, "d")))
    return rounded(G.turning_delay(rows, K, "d", "f", "y"), 6)


@query("g6_qlike_halves", rsql(LEDGER + ", " + MODELS + """, o AS (SELECT *, QUANTILE_CONT(ABS(r), 0.5) OVER (PARTITION BY asset, model) AS m, LN(GREATEST(f * f / 252, 1e-12)) + r * r / GREATEST(f * f / 252, 1e-12) AS ql FROM fm WHERE f > 0),
q AS (SELECT asset, model, AVG(CASE WHEN ABS(r) > m THEN ql END) AS qlike_high, AVG(CASE WHEN ABS(r) <= m THEN ql END) AS qlike_low FROM o GROUP BY 1, 2)""", "qlike_high", "qlike_low", digits=6, keys="asset, model"))  # fmt: skip
def g6(s, d):
    return rounded(G.halves_qlike(models(s, d), ["asset", "model"], "f", "r"), 6)


@query("g7_exposure_convexity", rsql(LEDGER + """, a AS (SELECT *, AVG(ABS(r)) OVER (PARTITION BY asset, pair ORDER BY d ROWS 20 PRECEDING) AS a FROM ledger), b AS (SELECT *, QUANTILE_CONT(a, 0.8) OVER (PARTITION BY asset, pair) AS c FROM a),
q AS (SELECT asset, pair, AVG(CASE WHEN a >= c THEN weight END) - AVG(CASE WHEN a < c THEN weight END) AS convexity FROM b GROUP BY 1, 2)""", "convexity", digits=6, keys="asset, pair"))  # fmt: skip
def g7(s, d):
    return rounded(G.exposure_convexity(V.ledger(s, d), ["asset", "pair"], "d", "r", "weight"), 6)


@query("g8_g11_regime_errors", rsql(LEDGER + ", " + BUCKET + f""", rv AS (SELECT asset, d, bucket AS regime, rv20 AS f, CASE WHEN COUNT(r) OVER w >= 21 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS rv FROM bk WINDOW w AS ({WD} ROWS 20 PRECEDING)),
al AS (SELECT *, LEAD(rv) OVER ({WD}) AS y, STDDEV_SAMP(rv) OVER ({WD} ROWS 20 PRECEDING) AS vv FROM rv),
q AS (SELECT asset, regime, COUNT(*) AS n, AVG(ABS(f - y)) AS mean_abs_err, AVG(f - y) AS bias, AVG(CASE WHEN f > 0 THEN LN(GREATEST(f * f, 1e-12)) + y * y / GREATEST(f * f, 1e-12) END) AS qlike, AVG(vv) AS vol_of_vol,
QUANTILE_CONT(ABS(f - y), 0.25) AS abs_err_p25, QUANTILE_CONT(ABS(f - y), 0.5) AS abs_err_p50, QUANTILE_CONT(ABS(f - y), 0.75) AS abs_err_p75 FROM al WHERE y IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2)""",
    "mean_abs_err", "bias", "qlike", "vol_of_vol", "abs_err_p25", "abs_err_p50", "abs_err_p75", digits=6, keys="asset, regime, n"))
def g8(s, d):
    rows = R_.bucket(rets(s, d).withColumn("f", E.realized(F.col("r"), K, "d", 20)), K, "f", out="regime")
    return rounded(G.by_regime(G.aligned_errors(rows, K, "d", "f", "r"), K, "regime"), 6)


@query("g13_strategy_embedding")
def g13(s, d):
    from ..operators import metrics as M

    table = M.performance(V.ledger(s, d), ["asset", "pair"], "d", "ret", "weight")
    return rounded(T.embed(table, ["ann_return", "ann_vol", "sharpe", "max_drawdown", "turnover"]).select("asset", "pair", "x", "y"), 6)
