"""Queries of the scans, filters, joins, set operations and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.frames import along
from ..operators import clean as P
from ..operators import joins as J
from ..operators import windows as W
from ..sources import series as S
from ..sources import views as V
from .registry import EW, LEDGER, PX, R, RET, RF, VIX, query, rounded, rsql

K = ["asset"]


@query("s1_series_scan", """SELECT o_orderstatus AS symbol, CAST(o_orderdate AS DATE) AS date, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS close FROM orders
WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1, 2""")  # fmt: skip
def s1(s, d):
    aliases = {"date": ["date", "o_orderdate"], "symbol": ["o_orderstatus"], "close": ["o_totalprice"]}
    rows = S.read_parquet_series(s, f"{d}/orders.parquet", "1996-01-01", "1997-12-31", aliases)
    return rounded(rows.groupBy("symbol", "date").agg(F.count("*").alias("n"), F.sum("close").alias("close")), 2)


@query("s2_daily_close", """SELECT event_type AS symbol, CAST(ts AS DATE) AS date, ROUND(arg_max(value, (ts, event_id)), 6) AS close FROM events WHERE value IS NOT NULL GROUP BY 1, 2""")
def s2(s, d):
    e = V.table(s, d, "events").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date"), F.struct("ts", "event_id").alias("ts"), F.col("value").alias("close"))
    return rounded(S.daily_close(e), 6)


@query("s4_strategy_dataset", rsql(PX + """, x AS (SELECT asset, d, LN(1 + (close / LAG(close) OVER (PARTITION BY asset ORDER BY d) - 1)) AS returns FROM px),
c AS (SELECT asset, QUANTILE_CONT(returns, 0.01) AS lo, QUANTILE_CONT(returns, 0.99) AS hi FROM x GROUP BY 1),
q AS (SELECT asset, d, returns, CASE WHEN returns IS NOT NULL THEN GREATEST(LEAST(returns, hi), lo) END AS returns_clean FROM x JOIN c USING (asset))""", "returns", "returns_clean", keys="asset, d"))  # fmt: skip
def s4(s, d):
    return rounded(S.strategy_dataset(V.px(s, d), K, "d", "close", 0.01).select("asset", "d", "returns", "returns_clean"))


@query("s5_risk_free", rsql(f"{RF}, {PX}, q AS (SELECT x.d, LN(1 + rf.y / 100 / 252) AS rf FROM (SELECT DISTINCT d FROM px) x ASOF LEFT JOIN rf ON x.d >= rf.d)", "rf", digits=10, keys="d"))
def s5(s, d):
    days = J.asof(V.px(s, d).select("d").distinct(), V.risk_free(s, d), [], "d", ["y"])
    return rounded(S.daily_risk_free(days, "d", "y").select("d", "rf"), 10)


@query("s8_manifest_scan", f"WITH {LEDGER} SELECT asset, pair, COUNT(*) AS n FROM ledger WHERE pair NOT IN ('rv60__clip') GROUP BY 1, 2")
def s8(s, d):
    led = V.ledger(s, d)
    names = led.select(F.col("pair").alias("name")).distinct()
    manifest = names.withColumn("status", F.when(F.col("name") == "rv60__clip", "error").otherwise("ok"))
    return S.manifest_ok(led, manifest).groupBy("asset", "pair").agg(F.count("*").alias("n"))


@query("s12_macro_inputs", rsql(VIX + """, v AS (SELECT d, r, CASE WHEN COUNT(r) OVER w >= 20 THEN STDDEV_SAMP(r) OVER w * SQRT(252) END AS ew_vol FROM ew WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)),
ts AS (SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS d, AVG(l_discount) * 100 - 5 AS term FROM lineitem GROUP BY 1),
q AS (SELECT a.d, a.ew_vol, a.vix, ts.term FROM (SELECT v.d, v.ew_vol, vix.vix FROM v ASOF LEFT JOIN vix ON v.d >= vix.d) a ASOF LEFT JOIN ts ON a.d >= ts.d)""", "ew_vol", "vix", "term", keys="d"))  # fmt: skip
def s12(s, d):
    from ..functions.frames import roll, std

    ew = V.returns(s, d).where("r IS NOT NULL").groupBy("d").agg(F.avg("r").alias("r"))
    days = ew.select("d", (std(F.col("r"), roll(along([], "d"), 20), 20) * 252**0.5).alias("ew_vol"))
    lines = V.table(s, d, "lineitem")
    term = lines.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg((F.avg("l_discount") * 100 - 5).alias("term"))
    out = J.asof(J.asof(days, V.vix(s, d), [], "d", ["vix"]), term, [], "d", ["term"])
    return rounded(out.select("d", "ew_vol", "vix", "term"))


@query("s14_resume", f"WITH {LEDGER}, u AS (SELECT e || '__' || c AS pair FROM (VALUES ('rv20'), ('rv60'), ('ewma20')) a(e), (VALUES ('constant'), ('hysteresis')) b(c)) SELECT pair FROM u WHERE pair NOT IN (SELECT pair FROM ledger)")
def s14(s, d):
    est = s.createDataFrame([("rv20",), ("rv60",), ("ewma20",)], "estimator string")
    ctrl = s.createDataFrame([("constant",), ("hysteresis",)], "controller string")
    return S.missing_pairs(J.pair_universe(est, ctrl).select("pair"), V.ledger(s, d))


@query("p1_clean_prices", """SELECT event_type, CAST(ts AS DATE) AS d, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY event_id) AS k FROM events WHERE value > 0 AND event_type LIKE '%c%') WHERE k = 1 GROUP BY 1, 2""")
def p1(s, d):
    out = P.clean_prices(V.table(s, d, "events"), ["event_type"], "ts", "value", "event_id", "event_type", "c")
    return rounded(out.groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count("*").alias("n"), F.sum("value").alias("total")), 4)


@query("p2_sample_split", f"WITH {R} SELECT asset, d, rn <= FLOOR(COUNT(*) OVER (PARTITION BY asset) * 0.5) AS in_sample FROM rr")
def p2(s, d):
    return P.sample_split(V.returns(s, d).where("r IS NOT NULL"), K, "d").select("asset", "d", "in_sample")


@query("p3_date_filter", f"WITH {PX} SELECT asset, COUNT(*) AS n, MIN(d) AS first, MAX(d) AS last FROM px WHERE d BETWEEN DATE '1996-03-01' AND DATE '1997-03-01' GROUP BY 1")
def p3(s, d):
    return P.between(V.px(s, d), "d", "1996-03-01", "1997-03-01").groupBy("asset").agg(F.count("*").alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


@query("p4_exclude_pairs", f"WITH {LEDGER} SELECT pair, COUNT(*) AS n FROM ledger WHERE NOT contains(split_part(pair, '__', 1), 'naive') AND NOT contains(pair, 'rv60__c') GROUP BY 1")
def p4(s, d):
    return P.exclude_pairs(V.ledger(s, d), "pair", estimators=["NAIVE"], pairs=["rv60__c"]).groupBy("pair").agg(F.count("*").alias("n"))


@query("p5_include_pairs", f"WITH {LEDGER} SELECT asset, pair, COUNT(*) AS n FROM ledger WHERE pair IN (SELECT pair FROM ledger WHERE d < DATE '1996-01-01' AND weight > 1.2) GROUP BY 1, 2")
def p5(s, d):
    led = V.ledger(s, d)
    return P.include_pairs(led, led.where("d < DATE'1996-01-01' AND weight > 1.2")).groupBy("asset", "pair").agg(F.count("*").alias("n"))


@query("p6_returns_frame", rsql(RET + ", q AS (SELECT asset, d, COALESCE(r, 0) AS r FROM (SELECT *, COUNT(r) OVER (PARTITION BY d) AS k FROM ret) WHERE k > 0)", "r", keys="asset, d"))
def p6(s, d):
    return rounded(P.returns_frame(V.returns(s, d).select("asset", "d", "r"), "d", "r"))


@query("p7_winsorize", rsql(R + """, g AS (SELECT asset, QUANTILE_CONT(r, 0.02) AS lo, QUANTILE_CONT(r, 0.98) AS hi FROM rr GROUP BY 1),
t AS (SELECT asset, d, r, CASE WHEN COUNT(r) OVER w >= 20 THEN 2 * STDDEV_SAMP(r) OVER w END AS b FROM rr WINDOW w AS (PARTITION BY asset ORDER BY d ROWS 251 PRECEDING)),
q AS (SELECT asset, d, GREATEST(LEAST(r, hi), lo) AS global_w, CASE WHEN b IS NULL THEN r ELSE GREATEST(LEAST(r, b), -b) END AS trailing_w FROM t JOIN g USING (asset))""", "global_w", "trailing_w", keys="asset, d"))  # fmt: skip
def p7(s, d):
    rows = P.winsor_global(V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r"), K, "r", 0.02).withColumnRenamed("r_w", "global_w")
    return rounded(P.winsor_trailing(rows, K, "d", "r", 2.0).select("asset", "d", "global_w", F.col("r_w").alias("trailing_w")))


@query("p8_calendar_spine", rsql(PX + """, sp AS (SELECT asset, CAST(UNNEST(range(MIN(d), MAX(d) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM px GROUP BY asset),
q AS (SELECT sp.asset, sp.d, LAST_VALUE(px.close IGNORE NULLS) OVER (PARTITION BY sp.asset ORDER BY sp.d) AS close, px.close IS NULL AS filled FROM sp LEFT JOIN px ON px.asset = sp.asset AND px.d = sp.d
WHERE isodow(sp.d) <= 5)""", "close", digits=6, keys="asset, d, filled"))  # fmt: skip
def p8(s, d):
    return rounded(P.on_spine(V.px(s, d), K, "d", ["close"]), 6)


@query("p9_rebalance_dates", f"WITH {PX} SELECT asset, COUNT(*) FILTER (isodow(d) = 7) AS weekly, COUNT(*) FILTER (isodow(d) = 3) AS wednesdays, COUNT(*) FILTER (d = LAST_DAY(d)) AS monthly, COUNT(*) FILTER (d = LAST_DAY(d) AND MONTH(d) % 3 = 0) AS quarterly FROM px GROUP BY 1")
def p9(s, d):
    flags = {"weekly": "W", "wednesdays": "W-WED", "monthly": "M", "quarterly": "Q"}
    return V.px(s, d).groupBy("asset").agg(*[F.count_if(P.rebalance_flag("d", f)).alias(n) for n, f in flags.items()])


@query("p10_pair_coverage", f"WITH {PX} SELECT asset, COUNT(*) AS n FROM px WHERE asset IN (SELECT asset FROM px GROUP BY 1 HAVING MAX(d) >= DATE '2001-11-03') GROUP BY 1")
def p10(s, d):
    return P.covering(V.px(s, d), "asset", "d", "2001-11-03").groupBy("asset").agg(F.count("*").alias("n"))


@query("p12_one_per_estimator", f"WITH {LEDGER}, n AS (SELECT DISTINCT pair, split_part(pair, '__', 1) AS estimator FROM ledger) SELECT estimator, pair FROM (SELECT *, row_number() OVER (PARTITION BY estimator ORDER BY CASE WHEN contains(pair, 'constant') THEN 0 ELSE 1 END, pair) AS k FROM n) WHERE k = 1")
def p12(s, d):
    return P.one_per_estimator(V.ledger(s, d).select("pair").distinct(), "pair", ["constant"]).select("estimator", "pair")


@query("j1_asof_join", rsql(VIX + ", q AS (SELECT rr.asset, rr.d, vix.vix FROM rr ASOF LEFT JOIN vix ON rr.d >= vix.d)", "vix", keys="asset, d"))
def j1(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d")
    days = J.asof(rows.select("d").distinct(), V.vix(s, d), [], "d", ["vix"])
    return rounded(rows.join(days, "d").select("asset", "d", "vix"))


@query("j1_asof_by_key", rsql(R + """, m AS (SELECT asset, d, close FROM rr WHERE DAY(d) = 1), q AS (SELECT rr.asset, rr.d, m.close FROM rr ASOF LEFT JOIN m ON rr.asset = m.asset AND rr.d >= m.d)""", "close", digits=6, keys="asset, d"))
def j1k(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL")
    return rounded(J.asof(rows.select("asset", "d"), rows.where("day(d) = 1").select("asset", "d", "close"), K, "d", ["close"]), 6)


@query("j1b_align_fill", rsql(VIX + """, x AS (SELECT rr.asset, rr.d, vix.vix FROM rr LEFT JOIN vix ON rr.d = vix.d),
y AS (SELECT asset, d, LAST_VALUE(vix IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d) AS vix FROM x),
q AS (SELECT asset, d, FIRST_VALUE(vix IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS vix FROM y)""", "vix", keys="asset, d"))  # fmt: skip
def j1b(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d")
    by_day = V.vix(s, d).join(rows, "d").select("asset", "d", "vix")
    return rounded(J.align_fill(rows, by_day, K, "d", ["vix"], back=True))


@query("j3_common_dates", f"WITH {R} SELECT d, COUNT(*) AS n FROM rr GROUP BY 1 HAVING COUNT(DISTINCT asset) = (SELECT COUNT(DISTINCT asset) FROM rr)")
def j3(s, d):
    return J.common_dates(V.returns(s, d).where("r IS NOT NULL"), "asset", "d").groupBy("d").agg(F.count("*").alias("n"))


@query("j5_outer_align", rsql(R + """, a AS (SELECT asset, d, r FROM rr WHERE rn % 2 = 0), b AS (SELECT asset, d, ABS(r) AS r FROM rr WHERE rn % 3 = 0),
q AS (SELECT asset, d, a.r AS even, b.r AS third FROM a FULL JOIN b USING (asset, d))""", "even", "third", keys="asset, d"))  # fmt: skip
def j5(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL")
    rows = rows.withColumn("n", F.row_number().over(along(K, "d")))
    frames = {"even": rows.where("n % 2 = 0"), "third": rows.where("n % 3 = 0").withColumn("r", F.abs("r"))}
    return rounded(J.outer_align(frames, K, "d", "r"))


@query("j6_j7_universe_grid", "SELECT e || '__' || c AS pair, e AS estimator, c AS controller, l AS lookback, t AS target, n FROM (SELECT DISTINCT p_type AS e FROM part) a, (SELECT DISTINCT o_orderstatus AS c, n FROM (SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1)) b, (VALUES (20), (60)) x(l), (VALUES (0.1::DOUBLE), (0.2::DOUBLE)) y(t)")
def j6(s, d):
    est = V.table(s, d, "part").select(F.col("p_type").alias("estimator")).distinct()
    ctrl = V.table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("controller")).agg(F.count("*").alias("n"))
    return J.parameter_grid(J.pair_universe(est, ctrl), {"lookback": [20, 60], "target": [0.1, 0.2]}).select("pair", "estimator", "controller", "lookback", "target", "n")


@query("j8_trailing_range_join", rsql(R + """, t AS (SELECT DISTINCT asset, CAST(DATE_TRUNC('quarter', d) AS DATE) AS as_of FROM rr),
q AS (SELECT t.asset, t.as_of, COUNT(*) AS n, AVG(r) AS mean_r, STDDEV_SAMP(r) AS sd_r FROM t JOIN rr ON rr.asset = t.asset AND rr.d >= t.as_of - INTERVAL 24 MONTH AND rr.d < t.as_of GROUP BY 1, 2)""",
    "mean_r", "sd_r", keys="asset, as_of, n"))
def j8(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    when = rows.select("asset", F.to_date(F.date_trunc("quarter", "d")).alias("as_of")).distinct()
    out = J.trailing_rows(when, rows, K, "d", 24)
    return rounded(out.groupBy("asset", "as_of").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r"), F.stddev_samp("r").alias("sd_r")))


@query("j9_labelled_past", rsql(R + """, lab AS (SELECT asset, d, r, CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS regime FROM rr), t AS (SELECT asset, d AS as_of, regime FROM lab WHERE DAY(d) = 1),
q AS (SELECT t.asset, t.as_of, t.regime, COUNT(*) AS n, AVG(r) AS mean_r FROM t JOIN lab ON lab.asset = t.asset AND lab.regime = t.regime AND lab.d >= t.as_of - INTERVAL 12 MONTH AND lab.d < t.as_of GROUP BY 1, 2, 3)""",
    "mean_r", keys="asset, as_of, regime, n"))
def j9(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").select("asset", "d", "r")
    labels = rows.select("asset", "d", F.when(F.col("r") > 0, "up").otherwise("down").alias("regime"))
    when = labels.where("day(d) = 1").withColumnRenamed("d", "as_of")
    out = J.labelled_past(when, rows, labels, K, "d", "regime", 12)
    return rounded(out.groupBy("asset", "as_of", "regime").agg(F.count("*").alias("n"), F.avg("r").alias("mean_r")))


RECORDS = """, rec AS (SELECT asset, d AS prediction_date, CASE WHEN rn % 30 = 0 THEN d + 40 WHEN rn % 20 = 0 THEN d ELSE d - 1 END AS feature_end, CASE WHEN r > 0.001 THEN 'high' WHEN r < -0.001 THEN 'low' ELSE 'middle' END AS regime FROM rr WHERE rn % 10 = 0)"""


@query("j10_recorded_regime", f"WITH {R}{RECORDS} SELECT rr.asset, rr.d, arg_max(k.regime, k.prediction_date) AS regime FROM rr LEFT JOIN rec k ON k.asset = rr.asset AND k.prediction_date <= rr.d AND k.feature_end < rr.d GROUP BY 1, 2")
def j10(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL").withColumn("n", F.row_number().over(along(K, "d")))
    label = F.when(F.col("r") > 0.001, "high").when(F.col("r") < -0.001, "low").otherwise("middle")
    end = F.when(F.col("n") % 30 == 0, F.date_add("d", 40)).when(F.col("n") % 20 == 0, F.col("d")).otherwise(F.date_sub("d", 1))
    rec = rows.where("n % 10 = 0").select("asset", F.col("d").alias("prediction_date"), end.alias("feature_end"), label.alias("regime"))
    return J.recorded_regime(rows.select("asset", "d"), rec, K, "d")


@query("j11_hold_anchors", rsql(R + ", q AS (SELECT asset, d, LAST_VALUE(CASE WHEN (rn - 1) % 10 = 0 THEN r END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY d) AS r_held FROM rr)", "r_held", keys="asset, d"))
def j11(s, d):
    return rounded(J.hold_until_next(V.returns(s, d).where("r IS NOT NULL"), K, "d", "r", 10).select("asset", "d", "r_held"))


@query("u1_u5_set_operations", f"""WITH {R}, a AS (SELECT d FROM rr WHERE asset = (SELECT MIN(asset) FROM rr)), b AS (SELECT d FROM rr WHERE asset = (SELECT MAX(asset) FROM rr))
SELECT 'union' AS op, d FROM (SELECT d FROM a UNION SELECT d FROM b) UNION ALL SELECT 'intersect', d FROM (SELECT d FROM a INTERSECT SELECT d FROM b) UNION ALL SELECT 'difference', d FROM (SELECT d FROM a EXCEPT SELECT d FROM b)""")  # fmt: skip
def u1(s, d):
    rows = V.returns(s, d).where("r IS NOT NULL")
    ends = rows.agg(F.min("asset").alias("lo"), F.max("asset").alias("hi"))
    a, b = (rows.join(F.broadcast(ends), rows["asset"] == ends[c]).select("d") for c in ("lo", "hi"))
    sets = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "difference": a.subtract(b)}
    parts = [x.select(F.lit(n).alias("op"), "d") for n, x in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("u5_keep_first", "SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def u5(s, d):
    return P.keep_first(V.table(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey")


@query("f1_f3_scalars", rsql(LEDGER + """, q AS (SELECT asset, pair, d, 1 / (1 + EXP(-r * 100)) AS logistic, CASE WHEN vol > 1e-12 THEN LN(GREATEST(vol * vol, 1e-12)) + r * r * 252 / GREATEST(vol * vol, 1e-12) END AS qlike,
GREATEST(LEAST(r, 0.005), -0.005) AS clipped, split_part(pair, '__', 1) AS estimator FROM ledger WHERE pair LIKE 'rv20%')""", "logistic", "qlike", "clipped", digits=7, keys="asset, pair, d, estimator"))  # fmt: skip
def f1(s, d):
    led = V.ledger(s, d).where("pair LIKE 'rv20%'")
    v, r = F.col("vol"), F.col("r")
    q = F.when(v > 1e-12, C.qlike(v * v, r * r * 252))
    return rounded(led.select("asset", "pair", "d", C.pair_parts(F.col("pair"))[0].alias("estimator"), C.logistic(r * 100).alias("logistic"), q.alias("qlike"), C.clip(r, -0.005, 0.005).alias("clipped")), 7)


@query("f4_strings", """SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
def f4(s, d):
    return V.table(s, d, "part").select("p_partkey", C.slug(F.col("p_name")).alias("slug"))


@query("f7_arrays", """WITH a AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS x FROM orders GROUP BY 1)
SELECT o_custkey, ROUND(list_avg(x), 6) AS m, ROUND(list_stddev_pop(x), 6) AS sd, ROUND(list_aggregate(x, 'quantile_cont', 0.8), 6) AS q80, ROUND(list_sum(list_transform(x, lambda v: v * v)) / list_sum(x), 6) AS self_weighted FROM a""")  # fmt: skip
def f7(s, d):
    a = V.table(s, d, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))), lambda v: v["o_totalprice"]).alias("x"))
    x = F.col("x")
    return rounded(a.select("o_custkey", C.array_mean(x).alias("m"), C.array_std(x).alias("sd"), C.array_quantile(x, 0.8).alias("q80"), C.weighted_sum(x, C.normalized(x)).alias("self_weighted")), 6)
