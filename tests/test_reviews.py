"""Reviews, rate features and registered pairs: the past stays as it is, and small cases by other ways."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from compare import normal
from test_past_only import CUT, cut_dir  # noqa: F401
from volspark.operators import forecast, registered, reviews
from volspark.operators.fold import Rule
from volspark.plans import QUERIES
from volspark.plans.reviews import macro


@pytest.mark.parametrize("name", ["e7_rate_har", "e17_curve_features", "q10_challengers", "q12_regime_pair_pool", "q14_checkpointed_router", "q15_vol_target_scores", "q21_review_gates", "q22_recorded_routing", "q22_q25_routed_ledger", "q23_carried_regime"])
def test_cutting_the_future_changes_nothing_before(name, spark, sf_dir, cut_dir):  # noqa: F811
    date = "as_of" if name == "q12_regime_pair_pool" else "d"
    whole, cut = QUERIES[name](spark, sf_dir).where(F.col(date) < F.lit(CUT)).toPandas(), QUERIES[name](spark, cut_dir).toPandas()
    pd.testing.assert_frame_equal(normal(whole), normal(cut), check_dtype=False, rtol=0, atol=2e-6)


def test_rate_har_equals_a_ridge_per_window(spark, sf_dir):
    one = forecast.curve_features(macro(spark, sf_dir), ["asset"], "d", "r")
    got = forecast.rate_har(one, ["asset"], "d").toPandas()
    name = got["asset"].min()
    got = got[got["asset"] == name].sort_values("d")["har_rates"].to_numpy()
    rows = one.where(F.col("asset") == name).toPandas().sort_values("d")
    x, sq = rows[forecast.RATES].astype(float).shift(1).to_numpy(), rows["rv_d"].to_numpy(float)
    checked = 0
    for i in range(251, len(rows), 37):
        at = [j for j in range(i - 252 + 1 + 64, i) if np.isfinite(x[j]).all()]
        if len(at) < 60 or not np.isfinite(x[i]).all():
            continue
        a = np.column_stack([np.ones(len(at)), x[at]])
        pen = 1e-3 * np.eye(a.shape[1])
        pen[0, 0] = 0
        b = np.linalg.solve(a.T @ a + pen, a.T @ np.log(sq[at] + 1e-8))
        assert got[i] == pytest.approx(np.sqrt(np.exp(b @ np.r_[1.0, x[i]]) * 252), rel=1e-5)
        checked += 1
    assert checked > 5
    assert np.isnan(got[:251]).all()


def test_first_source_takes_one_source_a_key(spark):
    a = spark.createDataFrame([("x", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", 3), ("y", 4)], "k string, v int")
    got = sorted(map(tuple, reviews.first_source([a, b], ["k"]).select("k", "v", "source").collect()))
    assert got == [("x", 1, 0), ("y", 3, 1), ("y", 4, 1)]
    assert reviews.first_source([a.limit(0), b.limit(0)], ["k"]).count() == 0


def test_review_gates_by_hand(spark):
    up, down = {"a": 1.0, "b": 2.0, "c": 0.0}, {"a": 2.0, "b": 1.0, "c": 0.0}
    good, bad = {"a": 2, "b": 1, "c": 3}, {"a": 1, "b": 9, "c": 2}
    rows = [(1, i, up if i < 1 else down, good if i < 3 else bad, good if i < 3 else bad) for i in range(12)]
    df = spark.createDataFrame(rows, "k int, i int, scores map<string,double>, rank_20 map<string,int>, rank_60 map<string,int>")
    got = {r.i: (r.active, r.reason) for r in reviews.reviewed_switches(df, ["k"], "i", (20, 60), 2, 5, 3, 2, 8).collect()}
    assert [got[i] for i in range(5)] == [("b", "initial"), ("b", "interval"), ("b", "cooldown"), ("b", "interval"), ("a", "switch")]
    assert got[6] == ("a", "cooldown") and got[5][1] == "interval"
    assert reviews.reviewed_switches(df.limit(0), ["k"], "i", (20, 60)).count() == 0


def test_vol_target_score_by_hand(spark):
    c = [F.lit(x) for x in (1.0, 0.5, 0.05, 0.05, -0.1, -0.02, 0.3)]
    got = spark.range(1).select(reviews.vol_target_score(*c, 0.10)).first()[0]
    assert got == pytest.approx(1.35 + 0.225 - 0.2 - 2 * 0.02 - 0.175 - 0.015 - 0.03)


def test_registered_pairs_run_for_every_series(spark):
    registered.register_forecast("flat", lambda r, keys, order: F.lit(0.2) + 0 * F.coalesce(r, F.lit(0.0)))
    registered.register_position("twice", lambda vol: 2 * vol, Rule(band=0.0))
    rows = spark.createDataFrame([(k, i, 0.01 * i) for k in "xy" for i in range(4)], "k string, i int, r double")
    got = registered.run_registered(rows, ["k"], "i", "r", ["flat"], ["twice"]).orderBy("k", "i").toPandas()
    assert set(got["pair"]) == {"flat__twice"} and len(got) == 8
    assert got["weight"].tolist() == pytest.approx([0.4] * 8)
