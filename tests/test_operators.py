import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from volspark.functions import columns as C
from volspark.operators import clean, covariance, fold, forecast, joins, metrics, portfolio, positions, protocol, ranking, regimes, routing, windows
from volspark.sources import series

DAY = dt.date(2020, 1, 1)


def frame(spark, values, key="a", name="r"):
    rows = [(key, DAY + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"asset string, d date, {name} double")


def column(df, c, order="d"):
    return [r[c] for r in df.orderBy(order).select(c).collect()]


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).normal(0, 0.01, 400)


def test_guards_and_arrays(spark):
    df = spark.createDataFrame([("1.5", [1.0, 2.0, 4.0]), ("bad", []), (None, [None, 3.0])], "x string, a array<double>")
    rows = df.select(C.finite(F.col("x")).alias("f"), C.finite(F.col("x"), -1.0).alias("g"), C.array_quantile(F.col("a"), 0.5).alias("q"), C.array_std(F.col("a"), 1).alias("s")).collect()
    assert [r.f for r in rows] == [1.5, None, None] and [r.g for r in rows] == [1.5, -1.0, -1.0]
    assert rows[0].q == 2.0 and rows[1].q is None and rows[2].q == 3.0 and rows[0].s == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_windows_gate_on_nulls_and_constants(spark):
    out = windows.rolling(frame(spark, [1, None, 3, 3, 3]), ["asset"], "d", "r", 3, 2)
    assert column(out, "mean_3") == [None, None, 2.0, 3.0, 3.0]
    assert column(out, "std_3")[-1] == 0.0
    assert metrics.performance(frame(spark, [0.0] * 5), ["asset"], "d", "r").first()["sharpe"] == 0.0


def test_single_row_group_and_bad_prices(spark):
    out = windows.with_returns(frame(spark, [5.0], name="p"), ["asset"], "d", "p").first()
    assert out["log_return"] is None
    out = windows.with_returns(frame(spark, [5.0, -1.0, 0.0, 4.0], name="p"), ["asset"], "d", "p")
    assert column(out, "log_return") == [None] * 4


def test_ewma_and_drawdown_match_pandas(spark, noise):
    df = frame(spark, noise)
    got = column(windows.ewma(df, ["asset"], "d", "r", halflife=10), "ewma")
    assert np.allclose(got, pd.Series(noise).ewm(halflife=10, adjust=False).mean())
    e = np.exp(np.cumsum(noise))
    assert np.allclose(column(windows.equity_curve(df, ["asset"], "d", "r"), "drawdown"), e / np.maximum.accumulate(e) - 1)


def test_frame_drawdown(spark, noise):
    df = frame(spark, noise[:80]).withColumn("w", F.lit(1.0))
    got = column(metrics.window_metrics(df, ["asset"], "d", "r", "w", 0.1, 20), "drawdown_n")
    part = np.concatenate([[0.0], np.cumsum(noise[60:80])])
    assert got[-1] == pytest.approx(np.exp((part - np.maximum.accumulate(part)).min()) - 1)


def test_forecasts_do_not_look_ahead(spark, noise):
    changed = noise.copy()
    changed[300:] *= 5
    for make in (lambda df: forecast.ar1(df, ["asset"], "d", "r", 100), lambda df: forecast.ar2(df, ["asset"], "d", "r", 100), lambda df: forecast.har(df, ["asset"], "d", "r", 100)):
        a, b = make(frame(spark, noise)), make(frame(spark, changed))
        name = a.columns[-1]
        assert column(a, name)[:301] == pytest.approx(column(b, name)[:301], nan_ok=True)


def test_har_solves_the_ridge(spark, noise):
    sq = noise**2
    w = pd.Series(sq).rolling(5, min_periods=1).mean().to_numpy()
    m = pd.Series(sq).rolling(22, min_periods=1).mean().to_numpy()
    t, n = 350, 200
    rows = [i for i in range(t - n, t) if i >= 22]
    x = np.stack([np.ones(len(rows)), sq[[i - 1 for i in rows]], w[[i - 1 for i in rows]], m[[i - 1 for i in rows]]], 1)
    s = np.sqrt((x**2).sum(0))
    beta = np.linalg.solve((x / s).T @ (x / s) + 1e-6 * np.eye(4), (x / s).T @ sq[rows]) / s
    want = np.sqrt(max(beta @ [1, sq[t - 1], w[t - 1], m[t - 1]], 1e-12) * 252)
    got = column(forecast.har(frame(spark, noise), ["asset"], "d", "r", n), "har")[t]
    assert got == pytest.approx(want, rel=1e-6)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-0.05, 0.05), min_size=3, max_size=40), st.sampled_from(sorted(positions.RULES)))
def test_fold_keeps_its_bounds(spark, values, name):
    df = frame(spark, values).withColumn("wanted", F.lit(1.2))
    out = fold.fold_ledger(df, ["asset"], "d", "r", "wanted", positions.RULES[name]).orderBy("d").toPandas()
    assert out["weight"].between(0, 1.5).all()
    assert np.allclose(out["equity"], np.exp(out["ret"].cumsum()))
    assert np.allclose(out["ret"].iloc[1:], out["weight"].iloc[:-1].to_numpy() * np.array(values)[1:] - out["cost"].iloc[:-1].to_numpy())


def test_fold_holds_on_missing_forecasts(spark):
    df = frame(spark, [0.01, 0.01, 0.01, 0.01]).withColumn("wanted", F.when(F.col("d") == DAY, 1.0))
    assert column(fold.fold_ledger(df, ["asset"], "d", "r", "wanted", fold.Rule()), "weight") == [1.0] * 4


def test_asof_and_alignment_differ(spark):
    left = frame(spark, [1, 1, 1, 1])
    right = spark.createDataFrame([("a", DAY - dt.timedelta(days=1), 7.0), ("a", DAY + dt.timedelta(days=2), 9.0)], "asset string, d date, v double")
    assert column(joins.asof(left, right, ["asset"], "d", ["v"]), "v") == [7.0, 7.0, 9.0, 9.0]
    assert column(joins.align_fill(left, right, ["asset"], "d", ["v"]), "v") == [None, None, 9.0, 9.0]
    assert column(joins.align_fill(left, right, ["asset"], "d", ["v"], back=True), "v") == [9.0] * 4


def test_clean_prices_keeps_the_first_of_a_timestamp(spark):
    df = spark.createDataFrame([("x", DAY, 1, 5.0), ("x", DAY, 2, 6.0), ("x", DAY, 0, -1.0)], "s string, d date, i int, p double")
    assert [r.p for r in clean.clean_prices(df, ["s"], "d", "p", "i").collect()] == [5.0]


def test_csv_scan_drops_bad_dates(spark, tmp_path):
    (tmp_path / "x.csv").write_text("DateTime,Ticker,ADJ_CLOSE\n2020-01-01 10:00:00,ES,1.5\nnonsense,ES,2\n2020-01-01 11:00:00,ES,oops\n2020-01-01 12:00:00,ES,3\n")
    rows = series.read_csv_series(spark, str(tmp_path / "x.csv"), "ES")
    assert sorted(r.close for r in rows.where("close IS NOT NULL").collect()) == [1.5, 3.0] and rows.count() == 3
    assert series.daily_close(rows).first()["close"] == 3.0
    with pytest.raises(ValueError):
        series.resolve_columns(rows, {"open": ["open"]}, ["open"])


def test_ledger_sink_round_trip_prunes(spark, tmp_path):
    df = spark.createDataFrame([("a__x", DAY, 0.1), ("b__y", DAY, 0.2)], "pair string, d date, returns_with_rf double")
    series.write_ledger(df, str(tmp_path / "l"))
    back = series.read_ledgers(spark, str(tmp_path / "l"), ["b__y"])
    assert series.normalize_ledger(back).select("estimator", "controller", "returns").first() == ("b", "y", 0.2)
    assert "PartitionFilters: [isnotnull(pair" in back._jdf.queryExecution().toString()


def test_matrix_rules():
    m = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    x = portfolio.risk_parity(m)
    c = x * (m @ x)
    assert np.allclose(c, c.mean(), rtol=1e-3) and x.sum() == pytest.approx(1)
    assert np.linalg.eigvalsh(covariance.psd(np.array([[1.0, 2.0], [2.0, 1.0]]))).min() >= 1e-9
    w = portfolio.min_variance(m)
    assert all(w @ m @ w <= v @ m @ v + 1e-12 for v in np.eye(3))


def test_capped_weights_sum_to_one(spark):
    df = spark.createDataFrame([(1, c, w) for c, w in zip("abcd", (0.7, 0.1, 0.1, 0.1))], "d int, asset string, weight double")
    w = [r.weight for r in portfolio.capped(df, "d", 0.4).collect()]
    assert max(w) == pytest.approx(0.4) and sum(w) == pytest.approx(1)


def test_rankings_are_permutations_with_ties(spark):
    df = spark.createDataFrame([("k", p, 1.0, 0.1, 0.2, 0.3, None) for p in "cab"], "k string, pair string, turnover double, drawdown double, sharpe double, vol_error double, qlike double")
    out = ranking.ranked(df, ["k"], ranking.train_order())
    assert [r.pair for r in out.orderBy("rank").collect()] == ["a", "b", "c"]


def test_splits_cover_positions(spark):
    df = frame(spark, range(40))
    out = protocol.splits(df, ["asset"], "d", 10, 5, 5).toPandas()
    for k, part in out.groupby("split"):
        at = sorted(part["r"])
        assert at == list(range(5 * k, 5 * k + min(15, 40 - 5 * k))) and (part["role"] == "train").sum() == 10
    assert out["split"].max() == 5


def test_sticky_selection_holds(spark):
    rows = [("k", i, {"a": 1.0, "b": 2.0 if i in (1, 2, 5, 6) else 0.0}) for i in range(8)]
    df = spark.createDataFrame(rows, "k string, d int, scores map<string,double>")
    assert column(routing.sticky_argmax(df, ["k"], "d", 3), "selected") == ["a", "a", "a", "a", "a", "b", "b", "b"]


def test_change_probability_rises_at_a_break(spark):
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, 80), np.random.default_rng(1).normal(8, 1, 20)])
    p = column(regimes.bocpd(frame(spark, x), ["asset"], "d", "r"), "p_change")
    assert max(p[80:84]) > 0.9 > 0.5 > np.median(p[20:80])


def test_persistent_labels(spark):
    df = spark.createDataFrame([("k", i, c) for i, c in enumerate("aababbbb")], "k string, d int, l string")
    assert "".join(column(regimes.persistent(df, ["k"], "d", "l", 3), "l_held")) == "aaaaaabb"
