"""Gates, routing by weights, caps, refits and the bandit against rules worked by hand and plain replays."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volspark.operators import forecast as E
from volspark.operators import live as L
from volspark.operators import metrics as M
from volspark.operators import portfolio as B
from volspark.operators import refits as RF
from volspark.operators import registered as U
from volspark.operators import routing as Q
from volspark.operators import tuning
from volspark.plans import refits as PR
from volspark.plans import switching as S

MARK = "map<string,struct<rank:int,sharpe:double,ann:double,drawdown:double>>"
REVIEW = f"k string, d date, scores map<string,double>, plain map<string,double>, drawdowns map<string,double>, changed boolean, w20 {MARK}, w60 {MARK}, w100 {MARK}"


def day(i):
    return dt.date(2020, 1, 1) + dt.timedelta(days=int(i))


def review(i, scores, marks=(), down=0.0, changed=False, plain=None):
    """A review of pairs a, b, c; ``marks`` names those that beat a in each window."""
    maps = []
    for beats in [*marks, *[()] * (3 - len(marks))]:
        m = {"a": (2, 1.0, 0.1, 0.05)}
        m |= {p: ((1 if p in beats else 3), 1.0 if p in beats else 0.5, 0.1, 0.05) for p in "bc"}
        maps.append(m)
    return ("k", day(i), scores, plain or scores, {p: -down for p in scores}, changed, *maps)


def picks(spark, rows, configs, step=1):
    out = Q.gated_switches(spark.createDataFrame(rows, REVIEW), ["k"], "d", configs, ("w20", "w60", "w100"), "w20", step).collect()
    found = {}
    for r in sorted(out, key=lambda r: r.d):
        found.setdefault(r.config, []).append((r.active, r.reason))
    return found


def test_gates_by_hand(spark):
    start = review(0, {"a": 2.0, "b": 1.0, "c": 0.5})
    # b leads by the plain gap but nothing has been held for 30 rows, and it beats a in one window only
    held = review(1, {"a": 1.0, "b": 2.0, "c": 0.5}, [("b",)])
    # now b and c beat a in two windows each: the group lifts the hold
    group = review(2, {"a": 1.0, "b": 2.0, "c": 0.5}, [("b", "c"), ("b", "c")])
    found = picks(spark, [start, held, group], {"n": Q.Switching(), "no_ranks": Q.Switching(ranks=False), "low": Q.Switching("low")})
    assert found["n"] == [("a", None), ("a", None), ("b", "score")]
    assert found["no_ranks"] == [("a", None)] * 3 and found["low"] == [("a", None)] * 3  # low asks for three such pairs

    # high sensitivity: one better pair of the short window is enough, whatever the score says
    worse = {"a": 2.0, "b": 1.0, "c": 0.5}
    short = ("k", day(1), worse, worse, dict.fromkeys("abc", 0.0), False, {"a": (1, 1.0, 0.1, 0.05), "b": (2, 1.0, 0.2, 0.05)}, {}, {})
    found = picks(spark, [start, short], {"high": Q.Switching("high"), "n": Q.Switching(), "blind": Q.Switching("high", ranks=False)})
    assert found["high"][1] == ("b", "short_term") and found["n"][1] == ("a", None) and found["blind"][1] == ("a", None)


def test_hold_regime_drawdown_and_ablations_by_hand(spark):
    start = review(0, {"a": 2.0, "b": 1.0, "c": 0.5}, plain={"a": 1.0, "b": 2.0, "c": 0.5})
    near = {"a": 2.0, "b": 1.95, "c": 0.5}
    configs = {"n": Q.Switching(), "no_regime": Q.Switching(regime=False), "no_b": Q.Switching(without="b"), "pick": Q.Switching(selects=True)}
    # after a review that counts as 30 rows: b is 0.05 behind, which a drawdown over 0.08 forgives (0.10)
    found = picks(spark, [start, review(1, near, down=0.09, plain=near)], configs, 30)
    assert found["n"] == [("a", None), ("b", "drawdown")]
    assert found["no_regime"] == [("b", None), ("a", "score")]  # begins by the scores without the regime
    assert found["no_b"] == [("a", None), ("a", None)] and found["pick"] == [("a", None), ("a", None)]
    close = {"a": 2.0, "b": 1.99, "c": 0.5}
    for changed, reason in ((True, "regime"), (False, "score")):
        assert picks(spark, [start, review(1, close, changed=changed)], {"n": Q.Switching()}, 30)["n"][1] == ("b", reason)


def test_a_switch_trades_the_difference_of_weights(spark):
    w = [("u", 0.5, 0.5, 0.0), ("v", 0.0, 0.2, 0.8)]
    rows = [(p, day(i), a, x) for p, *xs in w for i in range(5) for a, x in zip("xyz", xs) if x]
    weights = spark.createDataFrame(rows, "portfolio string, d date, asset string, weight double")
    chosen = spark.createDataFrame([("k", day(i), "u" if i < 2 else "v") for i in range(5)], "route string, d date, selected string")
    held = Q.routed_weights(chosen, weights, ["route"], "d")
    returns = spark.createDataFrame([("k", day(i), a, 0.01) for i in range(5) for a in "xyz"], "route string, d date, asset string, r double")
    led = {r.d: r for r in B.portfolio_ledger(held, returns, "d", keys=["route"]).collect()}
    assert [round(led[day(i)].turnover, 9) for i in range(5)] == [0.0, 1.0, 0.0, 0.5 + 0.3 + 0.8, 0.0]  # y is traded by 0.3 only
    assert led[day(4)].ret == pytest.approx(0.01 - 1.6 * 0.0005) and led[day(2)].ret == pytest.approx(0.01 - 0.0005)


def by_passes(w, cap):
    """Cut and deal the rest by room, up to ten times."""
    w = np.minimum(w, cap)
    for _ in range(10):
        rest = 1 - w.sum()
        room = np.maximum(cap - w, 0)
        if rest <= 1e-10 or room.sum() <= 0:
            break
        w = np.minimum(w + room / room.sum() * rest, cap)
    return w / w.sum()


def test_caps_by_room_equal_repeated_passes(spark):
    rng = np.random.default_rng(3)
    books = {f"p{i}": rng.dirichlet(np.full(5, 0.4)) for i in range(12)}
    rows = [(p, 1, f"a{j}", float(x), cap) for p, w in books.items() for j, x in enumerate(w) for cap in (0.15, 0.2, 0.3, 0.6)]
    df = spark.createDataFrame(rows, "p string, d int, asset string, weight double, cap double")
    got = {(r.p, r.cap, r.asset): r.weight for r in B.capped_by_room(df, "d", "cap", ["p", "cap"]).collect()}
    for p, w in books.items():
        for cap in (0.15, 0.2, 0.3, 0.6):
            assert [got[p, cap, f"a{j}"] for j in range(5)] == pytest.approx(by_passes(w, cap).tolist())


def test_tuning_equals_a_loop(spark):
    """Two portfolios, every combination by a loop over dates."""
    rng = np.random.default_rng(8)
    x = {"p": rng.normal(0, [0.01, 0.02, 0.005], (60, 3)), "q": rng.normal(0, [0.02, 0.01], (50, 2))}
    rows = [(b, day(i), f"a{j}", float(v)) for b, m in x.items() for i, line in enumerate(m) for j, v in enumerate(line)]
    panel = tuning.complete(spark.createDataFrame(rows, "b string, d date, asset string, r double").where("d <> DATE'2020-01-05' OR asset <> 'a1'"), ["b"], "d")
    for m in x.values():
        m[4, 1] = 0.0
    got = {(r.b, r.halflife, r.max_weight, r.max_gross): r for r in tuning.grid_scores(panel, ["b"], "d", (5, 20), (0.4, 0.6), (1.0, 1.5), 0.1, 55, 20).collect()}
    for b, m in x.items():
        last = min(55, len(m) - 2)
        for h, cap, gross in [(h, c, g) for h in (5, 20) for c in (0.4, 0.6) for g in (1.0, 1.5)]:
            held, rets, errors, turns = np.zeros(m.shape[1]), [], [], []
            for i in range(20, last - 1):
                age = 0.5 ** (np.arange(19, -1, -1) / h)
                age /= age.sum()
                z = m[i - 20 : i] - age @ m[i - 20 : i]
                cov = (z * age[:, None]).T @ z * 252
                w = 1 / np.sqrt(np.diag(cov))
                w = by_passes(w / w.sum(), cap)
                w = w * min(0.1 / np.sqrt(w @ cov @ w), gross)
                rets.append(w @ m[i + 1])
                errors.append(abs(np.sqrt(w @ cov @ w) - 0.1))
                turns.append(np.abs(w - held).sum())
                held = w
            r = got[b, h, cap, gross]
            sharpe = np.mean(rets) / np.std(rets, ddof=1) * 252**0.5
            assert (r.n, r.vol_error, r.turnover, r.sharpe) == pytest.approx((len(rets), np.mean(errors), np.mean(turns), sharpe))
            assert r.score == pytest.approx(np.mean(errors) + 0.02 * np.mean(turns) - 0.01 * sharpe)
    best = {r.b: (r.halflife, r.max_weight, r.max_gross) for r in tuning.best_params(spark.createDataFrame(list(got.values())), ["b"]).collect()}
    assert best == {b: min((round(r.score, 9), *k[1:]) for k, r in got.items() if k[0] == b)[1:] for b in x}


def test_live_splits_start_afresh(spark):
    """Overlapping splits of one series: no state of one window is in another, the bias comes from train rows."""
    U.register_forecast("flat", lambda r, keys, order: F.lit(0.2))
    U.register_position("half", lambda vol: 0.1 / vol)
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, 120)
    df = spark.createDataFrame([("k", day(i), float(v)) for i, v in enumerate(r)], "k string, d date, r double")
    led = L.live_ledgers(df, ["k"], "d", "r", ["flat"], ["half"], train=50, test=20, step=10).toPandas().sort_values("d")
    assert sorted(led["split"].unique()) == list(range(7))
    for (split, role), part in led.groupby(["split", "role"]):
        first = 10 * split + (0 if role == "train" else 50)
        assert part["d"].iloc[0] == day(first) and len(part) == (50 if role == "train" else min(20, 120 - first))
        k = np.clip(np.sqrt(252 * np.mean(r[10 * split : 10 * split + 50] ** 2)) / 0.2, 0.5, 2.0)
        w = min(0.1 / (0.2 * k), 1.5)
        own = r[first : first + len(part)]
        want = np.r_[0.0, w * own[1:]]
        want[1] -= w * 0.0005
        assert part["ret"].to_numpy() == pytest.approx(want) and part["weight"].to_numpy() == pytest.approx(w)
    scored = L.live_champions(spark.createDataFrame(led), ["k"], "d", "r", 0.1)
    assert scored.where("champion").count() == 7


def test_checkpoint_metrics_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    x, w = rng.normal(0, 0.02, 40), rng.random(40)
    df = spark.createDataFrame([("k", day(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, w))], "k string, d date, r double, w double")
    got = {r.d: r for r in M.checkpoint_metrics(df, ["k"], "d", "r", "w", 10, F.dayofmonth("d") % 7 == 0).collect()}
    assert set(got) == {day(i) for i in range(9, 40) if day(i).day % 7 == 0}
    for i in range(40):
        if day(i) in got:
            a, level = x[i - 9 : i + 1], np.exp(np.cumsum(x[i - 9 : i + 1]))
            dw = np.abs(np.diff(w))[i - 10 if i > 9 else 0 : i]
            r = got[day(i)]
            assert (r.ann, r.vol, r.total) == pytest.approx((a.mean() * 252, a.std(ddof=1) * 252**0.5, a.sum()))
            assert r.drawdown == pytest.approx(-(level / np.maximum.accumulate(level) - 1).min()) and r.turnover == pytest.approx(dw.mean())


def test_bandit_equals_a_replay(spark, sf_dir):
    """The fold against one that keeps each arm's whole matrix and solves it anew."""
    rows = S.bandit_rows(spark, sf_dir).where("asset IN ('SMALL', 'PROMO')")
    got = Q.context_bandit(rows, ["asset"], "d", S.ARMS).toPandas().sort_values(["asset", "d"])
    for asset, part in rows.toPandas().groupby("asset"):
        part = part.sort_values("d").head(250)
        a, b = {p: np.eye(13) for p in S.ARMS}, {p: np.zeros(13) for p in S.ARMS}
        arm, earned, arms = None, [], []
        for row in part.itertuples():
            if arm is not None:
                earned.append(row.ret.get(arm) or 0.0)
                m = row.metrics[arm]
                some = [0.0 if m[k] is None or m[k] != m[k] else m[k] for k in ("sharpe", "drawdown", "turnover", "vol_error", "loss")]
                value = some[0] - 0.5 * max(some[1], 0) - 0.2 * some[2] - 0.5 * some[3] - 0.25 * some[4] - 0.05 * moved
                a[arm] += np.outer(x, x)
                b[arm] += np.clip(value, -5, 5) * x
            e = pd.Series(earned[-63:], dtype=float)
            own = [0.0] * 4
            if len(e) >= 2:
                level = np.exp(e.cumsum())
                own = [e.mean() / e.std() * 252**0.5 if e.std() > 0 else 0.0, -(level / level.cummax() - 1).min(), e.std() * 252**0.5, abs(e.std() * 252**0.5 - 0.1)]
            values = [row.market_vol, row.market_mean, row.market_skew, *own, row.market_obs]
            x = np.array([*np.tanh(np.nan_to_num(values) / [0.25, 0.5, 2, 2, 0.25, 0.25, 0.1, 252]), row.regime == "low", row.regime == "mid", row.regime == "high", arm is not None, 1.0], float)
            ucb = {p: b[p] @ np.linalg.solve(a[p], x) + 0.5 * np.sqrt(x @ np.linalg.solve(a[p], x)) - 0.05 * (arm is not None and p != arm) for p in S.ARMS}
            best = max(ucb.values())
            pick = min(p for p in ucb if ucb[p] > best - 1e-9)
            moved, arm = arm is not None and pick != arm, pick
            arms.append(arm)
        assert got[got["asset"] == asset]["arm"].head(250).tolist() == arms


def test_refits_are_spaced_by_label(spark):
    labels = [None, 0, 0, 1, 0, 1, 1, 0, 2, 0, 0, 1]
    ready = [True] * 12
    ready[1] = ready[8] = False
    df = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate(zip(labels, ready))], "k string, d int, regime int, ok boolean")
    out = RF.spaced_refits(df, ["k"], "d", "regime", "ok", 4).orderBy("d").collect()
    assert [r.d for r in out if r.refit] == [2, 3, 7, 11]  # 0 at steps 2 and 7, 1 at 3 and 11; 2 is never ready


def test_curve_forecast_has_refits_and_no_future(spark, sf_dir):
    rows = E.curve_features(PR.macro(spark, sf_dir), ["asset"], "d", "r").where("d < DATE'1998-03-01'")
    assert RF.refit_dates(rows, "d") == ["1997-01-01", "1997-07-01", "1998-01-01"]
    whole = RF.curve_boosted(rows, ["asset"], "d").where("d < DATE'1997-12-01'").toPandas()
    cut = RF.curve_boosted(rows.where("d < DATE'1997-12-01'"), ["asset"], "d").toPandas()
    both = whole.merge(cut, on=["asset", "d"], suffixes=("", "_cut")).dropna()
    assert len(both) == len(cut.dropna()) > 300 and np.isclose(both["boosted_curve"], both["boosted_curve_cut"], rtol=1e-6).mean() > 0.98
    assert both.groupby(both["d"] >= dt.date(1997, 7, 1)).size().min() > 100


def test_refits_read_rows_that_are_made_once(spark):
    days = spark.range(90).select(F.col("id").cast("int").alias("i"), F.expr("date_add(DATE'2000-01-01', CAST(id AS INT))").alias("d"))
    rows = days.join(days.select("i", (F.col("i") % 7 / 7.0).alias("x")), "i").select(F.lit("k").alias("asset"), "d", "x", (2 * F.col("x")).alias("target"))
    out = E.learned(rows, ["asset"], "d", ["x"], "target", ["2000-02-01", "2000-03-01"], "lasso")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Range" not in plan and out.count() == 59
    assert all(abs(r.forecast - r.target) < 0.01 for r in out.collect())
