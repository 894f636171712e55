"""Queries of the constrained router, routed out-of-sample tables, macro inputs with credit, and QLIKE weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.frames import along
from ..operators import ensemble as T
from ..operators import live as L
from ..operators import protocol as K_
from ..operators import regimes as R_
from ..operators import routing as Q
from ..sources import views as V
from .core import MARKET, WM
from .live import DETAIL, detail_sql
from .models import MODELS, models
from .registry import LEDGER, R, query, rounded, rsql
from .reviews import CONFIGS, ROUTED
from .routes import SCORE, SPLIT, score_rows
from .switching import pair_metrics

K = ["asset"]
P = ["asset", "pair"]
TRAIN = 504
LIMITS = ("loss", "turnover", "vol_error")

#: Metrics of every pair's last 63 rows, of the row before (pm), and the thresholds and champion of the train rows.
METRICS = """, k0 AS (SELECT *, ABS(weight - LAG(weight) OVER w) AS dw, CASE WHEN vol > 0 THEN LN(GREATEST(vol * vol, 1e-12)) + 252 * r * r / GREATEST(vol * vol, 1e-12) END AS l, row_number() OVER w AS k FROM ledger WINDOW w AS (PARTITION BY asset, pair ORDER BY d)),
k1 AS (SELECT *, AVG(ret) OVER f AS m, STDDEV_SAMP(ret) OVER f AS sd, AVG(dw) OVER f AS tn, AVG(l) OVER f AS loss, 1 - equity / MAX(equity) OVER f AS down FROM k0 WINDOW f AS (PARTITION BY asset, pair ORDER BY d ROWS 62 PRECEDING)),
k2 AS (SELECT asset, pair, d, k, ROUND(CASE WHEN sd > 0 THEN m / sd * SQRT(252) ELSE 0 END, 8) AS sharpe, ROUND(MAX(down) OVER (PARTITION BY asset, pair ORDER BY d ROWS 62 PRECEDING), 8) AS drawdown, ROUND(tn, 8) AS turnover, ROUND(ABS(sd * SQRT(252) - 0.1), 8) AS vol_error, ROUND(loss, 8) AS loss FROM k1)"""


@query("q4_q5_constrained_router", f"""WITH RECURSIVE {LEDGER}{METRICS}, tq AS (SELECT asset, ROUND(QUANTILE_CONT(loss, 0.8), 8) AS ql, ROUND(QUANTILE_CONT(turnover, 0.8), 8) AS qt, ROUND(QUANTILE_CONT(vol_error, 0.8), 8) AS qv FROM k2 WHERE k = 504 GROUP BY 1),
ts AS (SELECT asset, pair, d, k, loss, turnover, vol_error, ROUND(sharpe - 0.5 * GREATEST(drawdown, 0) - (0.5 * turnover + 0.5 * vol_error + COALESCE(loss, 0)), 8) AS score FROM k2), df AS (SELECT asset, arg_min(pair, {{'s': -score, 'p': pair}}) AS dflt FROM ts WHERE k = 504 GROUP BY 1),
lg AS (SELECT asset, pair, d, k, LAG(score) OVER w AS score, LAG(loss) OVER w AS loss, LAG(turnover) OVER w AS turnover, LAG(vol_error) OVER w AS vol_error FROM ts WINDOW w AS (PARTITION BY asset, pair ORDER BY d)),
bl AS (SELECT lg.*, CASE WHEN NOT COALESCE(loss <= ql, FALSE) THEN 'loss' WHEN NOT COALESCE(turnover <= qt, FALSE) THEN 'turnover' WHEN NOT COALESCE(vol_error <= qv, FALSE) THEN 'vol_error' END AS blocked FROM lg JOIN tq USING (asset) WHERE k > 504),
x AS MATERIALIZED (SELECT asset, d, k - 504 AS i, MAP(list(pair ORDER BY pair), list(score ORDER BY pair)) AS s, list(pair ORDER BY pair) FILTER (blocked IS NULL AND score IS NOT NULL) AS free FROM bl GROUP BY 1, 2, 3),
f AS (SELECT asset, 0::BIGINT AS i, NULL::DATE AS d, dflt AS active, 0 AS since, FALSE AS switched, 0 AS n_feasible, NULL::VARCHAR AS held_by FROM df UNION ALL
SELECT asset, i, d, CASE WHEN sw THEN best ELSE active END, CASE WHEN sw THEN 0 ELSE since END, sw, n, CASE WHEN sw THEN NULL WHEN n = 0 THEN 'blocked' WHEN best <> active THEN 'sticky' ELSE 'best' END FROM (
SELECT *, best <> active AND since >= 5 AS sw FROM (SELECT x.asset, x.i, x.d, f.active, f.since + 1 AS since, COALESCE(LEN(x.free), 0) AS n,
COALESCE((list_sort(list_transform(x.free, lambda p: {{'v': -ROUND(x.s[p] - CASE WHEN p <> f.active THEN 0.05 ELSE 0 END, 9), 'o': p <> f.active, 'k': p}})))[1].k, f.active) AS best FROM f JOIN x ON x.asset = f.asset AND x.i = f.i + 1)))
SELECT asset, d, active AS selected, switched, n_feasible, held_by FROM f WHERE i > 0""")  # fmt: skip
def q4(s, d):
    """Thresholds from the 80 % quantiles of the train rows; then the best pair that passes them, day by day."""
    rows = pair_metrics(s, d).withColumn("k", F.row_number().over(along(P, "d")))
    score = Q.constrained_score(F.col("sharpe"), F.col("drawdown"), F.col("turnover"), F.col("vol_error"), F.col("loss"))
    rows = rows.withColumn("score", F.round(score, 8))
    last = rows.where(F.col("k") == TRAIN).groupBy("asset").agg(*[F.round(F.percentile(c, 0.8), 8).alias(f"q_{c}") for c in LIMITS], F.min_by("pair", F.struct(-F.col("score"), "pair")).alias("default"))
    w = along(P, "d")
    test = rows.select(*P, "d", "k", *[F.lag(c).over(w).alias(c) for c in ("score", *LIMITS)]).where(F.col("k") > TRAIN).join(last, "asset")
    test = Q.constrained(test, K, "d", [(c, F.col(c) <= F.col(f"q_{c}")) for c in LIMITS])
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", c)))).alias(c)
    maps = test.groupBy("asset", "d").agg(entries("score"), entries("blocked"), F.first("default").alias("default")).withColumnRenamed("score", "scores")
    return Q.constrained_choice(maps, K, "d", "default")


@query("a25_routed_oos", rsql("RECURSIVE " + LEDGER + WM + MARKET + SCORE + ", sc2 AS (SELECT sc.*, ROUND(wq.ls - wq.lv, 6) AS plain FROM sc JOIN wq USING (asset, pair, d))" + ROUTED + """, lg AS (SELECT config, asset, split, d, LAG(selected) OVER (PARTITION BY config, asset, split ORDER BY d) AS pair FROM f),
bk AS (SELECT lg.config || '/' || lg.asset AS asset, lg.split, lg.d, l.ret, l.r, CASE WHEN LAG(lg.pair) OVER (PARTITION BY lg.config, lg.asset, lg.split ORDER BY lg.d) <> lg.pair THEN 1 ELSE 0 END AS sw, lg.pair FROM lg JOIN ledger l ON l.asset = lg.asset AND l.d = lg.d AND l.pair = lg.pair),
oo AS (SELECT asset, split, d, r, ret - 0.0005 * sw AS ret FROM bk), """ + detail_sql("oo").replace("q AS (SELECT *,", "q0 AS (SELECT *,") + ", sw AS (SELECT asset, split, CAST(SUM(sw) AS BIGINT) AS switches, COUNT(DISTINCT pair) AS pairs FROM bk GROUP BY 1, 2), q AS (SELECT q0.*, switches, pairs, switches / n AS switch_rate FROM q0 JOIN sw USING (asset, split))",
    *DETAIL, "switch_rate", digits=6, keys="asset, split, n, switches, pairs").replace("SELECT asset, split, n, switches, pairs,", "SELECT split_part(asset, '/', 1) AS config, split_part(asset, '/', 2) AS asset, split, n, switches, pairs,"))
def a25(s, d):
    """Every configuration's routed test rows against buy and hold, with switches and distinct pairs."""
    led = V.ledger(s, d)
    key = ["config", "asset", "split"]
    picks = Q.routed_ledger(K_.routed_splits(score_rows(s, d), K, "d", CONFIGS), led, key, "d", on=K)
    rows = picks.join(led.select("asset", "d", "pair", "r"), ["asset", "d", "pair"])
    out = L.oos_detail(rows, key, "d", switched="switched").join(rows.groupBy(*key).agg(F.count_distinct("pair").alias("pairs")), key)
    return rounded(out.select(*key, "n", F.col("switches").cast("long").alias("switches"), "pairs", *DETAIL, "switch_rate"), 6)


CREDIT = """cr AS (SELECT CAST(l_shipdate AS DATE) AS d, ROUND(AVG(l_discount) * 100, 8) AS hy FROM lineitem GROUP BY 1), tm AS (SELECT CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS d, ROUND(AVG(l_discount) * 100 - 5, 8) AS term FROM lineitem GROUP BY 1)"""


@query("s6_s12_r16_credit_inputs", f"""WITH {R}, ew AS (SELECT d, AVG(r) AS r FROM rr GROUP BY 1), {CREDIT}, vx AS (SELECT d, ROUND(vix, 8) AS vix FROM (SELECT d, CASE WHEN COUNT(r) OVER w >= 20 THEN 100 * STDDEV_SAMP(r) OVER w * SQRT(252) + 5 END AS vix, row_number() OVER (ORDER BY d) AS n FROM ew WINDOW w AS (ORDER BY d ROWS 19 PRECEDING)) WHERE n % 3 = 0 AND vix IS NOT NULL),
v AS (SELECT d, CASE WHEN COUNT(r) OVER a >= 10 THEN STDDEV_SAMP(r) OVER a * SQRT(252) END AS vol_21, CASE WHEN COUNT(r) OVER b >= 20 THEN STDDEV_SAMP(r) OVER b * SQRT(252) END AS vol_63 FROM ew WINDOW a AS (ORDER BY d ROWS 20 PRECEDING), b AS (ORDER BY d ROWS 62 PRECEDING)),
j AS (SELECT v.*, LAST_VALUE(vx.vix IGNORE NULLS) OVER w AS vix, LAST_VALUE(tm.term IGNORE NULLS) OVER w AS term, LAST_VALUE(cr.hy IGNORE NULLS) OVER w AS hy_oas FROM v LEFT JOIN vx USING (d) LEFT JOIN tm USING (d) LEFT JOIN cr USING (d) WINDOW w AS (ORDER BY d ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, ROUND(hy_oas - LAG(hy_oas, 20) OVER (ORDER BY d), 8) AS hy_change FROM j)
SELECT d, ROUND(vol_21, 8) + 0.0 AS vol_21, ROUND(vol_63, 8) + 0.0 AS vol_63, vix, term, hy_oas, hy_change, CASE WHEN COALESCE(ROUND(vol_63, 8), 0) >= 0.14 OR COALESCE(vix, 0) >= 24 OR COALESCE(hy_oas, 0) >= 5 OR COALESCE(hy_change, 0) >= 0.5 THEN 'defensive'
WHEN COALESCE(ROUND(vol_63, 8), 0) <= 0.09 AND COALESCE(vix, 0) <= 18 AND (hy_change IS NULL OR hy_change <= 0.15) THEN 'risk_on' ELSE 'balanced' END AS regime FROM c""")  # fmt: skip
def r16(s, d):
    """Macro inputs with the credit spread and its change over 20 rows, from columns that are found by their candidates."""
    lines = V.table(s, d, "lineitem")
    credit = lines.groupBy(F.to_date("l_shipdate").alias("d")).agg(F.round(F.avg("l_discount") * 100, 8).alias("HY_OAS"))
    term = lines.groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("d")).agg(F.round(F.avg("l_discount") * 100 - 5, 8).alias("T10Y2Y"))
    vix = V.vix(s, d).select("d", F.round("vix", 8).alias("Close"))
    aux = {
        "vix": (vix, ["vix_close", "vix", "close", "value", "adj_close", "price"]), "term": (term, ["termspread", "term_spread", "t10y2y"]),
        "hy_oas": (credit, ["hy_oas"]), "ig_oas": (credit, ["ig_oas"]),
    }
    rows = R_.macro_inputs(V.returns(s, d).where("r IS NOT NULL").select("d", "r"), "d", aux)
    rows = rounded(rows.withColumn("hy_change", F.round(F.col("hy_oas") - F.lag("hy_oas", 20).over(along([], "d")), 8)))
    regime = R_.macro_regime(F.col("vol_63"), F.col("vix"), F.col("hy_oas"), F.col("hy_change"))
    return rows.select("d", "vol_21", "vol_63", "vix", "term", "hy_oas", "hy_change", regime.alias("regime"))


@query("t3_qlike_and_manual_weights", rsql(LEDGER + ", " + MODELS + """, l AS (SELECT asset, model, AVG(LN(GREATEST(f * f / 252, 1e-12)) + r * r / GREATEST(f * f / 252, 1e-12)) AS q FROM fm WHERE f > 0 AND d < DATE '1998-01-01' GROUP BY 1, 2),
v AS (SELECT asset, model, CASE WHEN q > 0 THEN 1 / q ELSE 0 END AS v FROM l), w AS (SELECT asset, model, CASE WHEN SUM(v) OVER (PARTITION BY asset) > 0 THEN v / SUM(v) OVER (PARTITION BY asset) END AS w, 'qlike' AS method FROM v UNION ALL SELECT asset, model, CASE model WHEN 'rv20' THEN 0.5 WHEN 'rv60' THEN 0.25 ELSE 0.25 END, 'manual' FROM v),
q AS (SELECT method, fm.asset, fm.d, SUM(w * COALESCE(f, 0)) AS ensemble FROM fm JOIN w USING (asset, model) GROUP BY 1, 2, 3)""", "ensemble", digits=7, keys="method, asset, d"))  # fmt: skip
def t3(s, d):
    """Weights by inverse QLIKE (a loss of zero or less gets none) and given ones, over the same forecasts."""
    rows = models(s, d)
    learned = T.inverse_loss_weights(rows.where("d < DATE'1998-01-01'"), K, "model", "f", "r", "qlike")
    given = learned.select(*K, "model", F.when(F.col("model") == "rv20", 0.5).otherwise(0.25).alias("w"))
    parts = [T.static_weighted(rows, w, K, "d", "model", "f").withColumn("method", F.lit(m)) for m, w in (("qlike", learned), ("manual", given))]
    return rounded(parts[0].unionByName(parts[1]).select("method", *K, "d", "ensemble"), 7)
