"""Rows of the past do not change when the future is cut off, and rules worked by hand."""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import normal
from volspark.functions import columns as C
from volspark.operators import joins, metrics, portfolio, ranking, regimes, routing
from volspark.plans import QUERIES

CUT = dt.date(1996, 6, 1)
#: Forecasts, regimes, covariances, positions and selections that use rows before or at their own only.
PAST_ONLY = [
    "e0_carried_forecast", "e1_e2_e20_window_vols", "e3_ewma_window", "e4_ar1", "e5_ar2", "e6_har_ridge", "e8_regime_har", "e12_hybrid_blend", "e13_precision_ensemble", "e19_sequences", "e23_composite",
    "r6_r7_change_point", "r9_hmm_filter", "r10_persistence", "r13_bocpd", "r14_stress_score", "r15_metric_regime", "r17_past_quantile_regime", "t1_component_forecasts", "t2_equal_weight",
    "v1_sample_covariance", "v7_ledoit_wolf", "v10_regime_blend", "v13_dynamic_blend", "c8_expected_shortfall", "c11_priority_stack", "m11_drawdown_brake", "m9_mean_variance",
    "e10_gjr_recalibrated", "e11_regime_gjr", "e12_hybrid_stress", "t4_soft_regimes", "m0_target_weights", "m4_m7_optimised", "m10_risk_budget", "v11_vix_scaled", "q7_context_bandit", "q9_k7_gated_switches", "q14_checkpointed_router", "q21_review_gates",
    "q1_q2_scores", "q3_sticky_selection", "q6_mixture_of_experts", "q9_rule_switches", "q16_event_triggers", "q18_diversity_guard", "q20_portfolio_scores", "j10_recorded_regime", "o4_regime_block_ranks",
]


@pytest.fixture(scope="module")
def cut_dir(spark, sf_dir, tmp_path_factory):
    """The tables without line items from CUT on."""
    out = tmp_path_factory.mktemp("cut")
    for f in os.listdir(sf_dir):
        if f != "lineitem.parquet":
            os.symlink(f"{sf_dir}/{f}", out / f)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(F.to_date("l_shipdate") < F.lit(CUT)).write.parquet(str(out / "lineitem.parquet"))
    return str(out)


@pytest.mark.parametrize("name", PAST_ONLY)
def test_cutting_the_future_changes_nothing_before(name, spark, sf_dir, cut_dir):
    date = "as_of" if name.startswith("o4") else "d"
    whole, cut = QUERIES[name](spark, sf_dir).where(F.col(date) < F.lit(CUT)).toPandas(), QUERIES[name](spark, cut_dir).toPandas()
    if name.startswith("c"):  # a position ledger's last row holds the weight before it
        whole, cut = (x[x["d"] < x.groupby("asset")["d"].transform("max")] for x in (whole, cut))
    pd.testing.assert_frame_equal(normal(whole), normal(cut), check_dtype=False, rtol=0, atol=2e-6)


# --- Rules by hand


def value(spark, column, **cols):
    return spark.createDataFrame([tuple(cols.values())], list(cols)).select(column).first()[0]


def test_candidate_score_by_hand(spark):
    c = F.col
    blocks = [(c("s1"), c("d1"), c("c1")), (c("s2"), c("d2"), c("c2"))]
    row = {"s": 1.0, "d": 0.05, "c": 0.01, "s1": 2.0, "d1": 0.02, "c1": 0.03, "s2": 0.0, "d2": 0.14, "c2": 0.05}
    found = value(spark, routing.candidate_score(c("s"), c("d"), c("c"), blocks, "very_low"), **row)
    # Sharpe 0.55 + 0.45, drawdown max(0.05, 0.08), CVaR max(0.01, 0.04), inconsistency 0.06 + 0.02 + 0.04
    assert found == pytest.approx(0.8 * 1.0 - 4.75 * 0.08 - 3.25 * 0.04 - 2.25 * 0.12)
    alone = value(spark, routing.candidate_score(c("s"), c("d"), c("c")), **row)
    assert alone == pytest.approx(1.0 - 3.5 * 0.05 - 2.0 * 0.01 - 1.25 * 0.01)


def test_metric_and_macro_regimes_by_hand(spark):
    rows = [(0.9, -0.20, 0.0, 0.10, 0.09, "risk_on"), (0.9, -0.01, 0.0, 0.12, 0.09, "risk_on"), (0.7, -0.07, 0.0, 0.12, 0.09, "defensive"), (0.7, -0.01, 0.032, 0.13, 0.06, "balanced"), (0.7, -0.01, 0.0, 0.1, 0.01, "defensive")]
    df = spark.createDataFrame(rows, "s double, d double, e double, v double, a double, want string")
    got = df.select("want", regimes.metric_regime(*[F.col(x) for x in "sdeva"]).alias("g")).collect()
    assert all(r.want == r.g for r in got)
    rows = [(0.14, 10.0, None, None, "defensive"), (0.05, 24.0, None, None, "defensive"), (0.05, 10.0, 5.0, None, "defensive"), (0.05, 10.0, 1.0, 0.2, "balanced"), (0.05, 10.0, 1.0, None, "risk_on"), (0.10, 10.0, None, None, "balanced")]
    df = spark.createDataFrame(rows, "v double, x double, h double, c double, want string")
    assert all(r.want == r.g for r in df.select("want", regimes.macro_regime(*[F.col(x) for x in "vxhc"]).alias("g")).collect())


def test_consistency_and_names_by_hand(spark):
    df = spark.createDataFrame([("a", 0.05), ("a", 0.09)], "p string, dd double")
    r = metrics.drawdown_consistency(df, ["p"], "dd").first()
    assert (r.dd_mean, r.dd_std, r.dd_gap, r.dd_score) == pytest.approx((0.07, 0.02, 0.02, -0.04))
    assert metrics.drawdown_consistency(df, ["p"], "dd", None).first().dd_score == pytest.approx(-0.09)
    names = spark.createDataFrame([("Very High", "very_high"), (" low ", "low"), ("medium", "normal"), ("?", "normal"), (None, "normal"), ("very-low", "very_low")], "s string, w string")
    assert all(r.w == r.g for r in names.select("w", C.sensitivity(F.col("s")).alias("g")).collect())
    pairs = spark.createDataFrame([("garch__regime", "high", 0.60), ("ewma__constant", "low", 0.35), ("rv__variance", "middle", 0.10), ("rv__clip", "high", 0.0)], "pair string, regime string, want double")
    none = spark.createDataFrame([], "pair string, regime string, score double")
    assert all(r.bias == pytest.approx(r.want) for r in routing.regime_bias(pairs, "pair", "regime", {"pair": none}).collect())


def test_recorded_regime_counts_from_the_day_after_its_features(spark):
    day = dt.date(2020, 1, 1)
    days = spark.createDataFrame([("a", day + dt.timedelta(i)) for i in range(8)], "k string, d date")
    at = lambda i: day + dt.timedelta(i)
    rec = [("a", at(1), at(1), "x"), ("a", at(3), at(2), "y"), ("a", at(2), at(5), "late")]
    rec = spark.createDataFrame(rec, "k string, prediction_date date, feature_end date, regime string")
    got = [r.regime for r in joins.recorded_regime(days, rec, ["k"], "d").orderBy("d").collect()]
    assert got == [None, None, "x", "y", "y", "y", "y", "y"]


def test_switch_rule_and_diversity_by_hand(spark):
    rows = [("k", i, {"a": 1.0, "b": 1.0 + 0.1 * i}, {"a": -0.2, "b": 0.0}, False) for i in range(6)]
    df = spark.createDataFrame(rows, "k string, d int, scores map<string,double>, drawdowns map<string,double>, changed boolean")
    out = routing.rule_switches(df, ["k"], "d", "very_low", 2).orderBy("d").collect()
    assert [r.active for r in out] == ["a", "a", "b", "b", "b", "b"] and [r.switched for r in out] == [False, False, True, False, False, False]
    picks = df.select("k", "d", F.lit("b").alias("selected"), F.create_map(F.lit("a"), F.lit(0.97), F.lit("b"), F.lit(1.0), F.lit("c"), F.lit(0.5)).alias("scores"))
    assert "".join(r.picked for r in routing.diversified_picks(picks, ["k"], "d").orderBy("d").collect()) == "bbbabb"


def test_portfolios_of_one_table_are_apart(spark):
    rows = [(p, i, a, w) for p, ws in (("p", [0.5, 0.52, 0.60]), ("q", [0.1, 0.2, 0.2])) for i, x in enumerate(ws) for a, w in (("u", x), ("v", 1 - x))]
    df = spark.createDataFrame(rows, "p string, d int, asset string, weight double")
    held = {(r.p, r.d): r.weight for r in portfolio.hysteresis(df, "d", ["p"]).where("asset = 'u'").collect()}
    assert held == pytest.approx({("p", 0): 0.5, ("p", 1): 0.5, ("p", 2): 0.6, ("q", 0): 0.1, ("q", 1): 0.2, ("q", 2): 0.2})
    first = portfolio.buy_and_hold(df, "d", ["p"]).where("asset = 'u'").groupBy("p").agg(F.collect_set("weight").alias("w")).collect()
    assert {r.p: r.w for r in first} == {"p": [0.5], "q": [0.1]}


def test_mean_variance_equals_numpy(spark):
    m, mu = np.array([[0.04, 0.01], [0.01, 0.09]]), np.array([0.05, 0.12])
    df = spark.createDataFrame([(1, ["u", "v"], m.ravel().tolist(), mu.tolist())], "d int, assets array<string>, m array<double>, mu array<double>")
    x = np.maximum(np.linalg.pinv(m) @ mu / 6, 0)
    got = {r.asset: r.weight for r in portfolio.mean_variance(df, "d").collect()}
    assert got == pytest.approx(dict(zip("uv", x / x.sum())))


def test_calibrated_score_and_hurdle(spark):
    c = F.col
    row = {"v": 0.01, "d": -0.2, "t": 0.5, "s": 1.0}
    assert value(spark, ranking.calibrated_score(c("v"), c("d"), c("t"), c("s")), **row) == pytest.approx(0.01 + 0.1 + 0.01 - 0.05)
    assert value(spark, routing.clears_hurdle(c("v"), c("t"), c("d")), **row) is True
    assert value(spark, routing.risk_adjusted(c("s"), c("t"), c("d"), c("v"), c("s")), **row) == pytest.approx(1.0 - 2.0 + 0.1 - 0.02 + 0.15)
