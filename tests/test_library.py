"""Temporal operators, statistics, contracts, sources and streams on small made-up data."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.operators import contracts, temporal
from ledgerwake.sources import tables
from ledgerwake.stats import effects, likelihood, moments, scores
from ledgerwake.streaming import streams

# Temporal -------------------------------------------------------------------------


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof(spark, direction, strict):
    r = random.Random(1)
    ev = [(r.choice([1, 2, None]), r.choice([None, *range(30)]), i, r.choice([None, i])) for i in range(80)]
    q = [(i, r.choice([1, 2, 3, None]), r.choice([None, *range(-1, 32)])) for i in range(60)]
    e, a = spark.createDataFrame(ev, "k long, t long, o long, v long"), spark.createDataFrame(q, "id long, k long, t long")
    for target in (10, 10_000):
        got = {x.id: (x.asof_t, x.asof_v) for x in temporal.asof_join(a, e, ["k"], "t", "t", ["v"], "o", direction, strict, target_rows=target).collect()}
        for i, k, t in q:
            own = [(u, o, v) for k2, u, o, v in ev if k2 == k and k is not None and u is not None and t is not None and ((u < t or u == t and not strict) if direction == "backward" else (u > t or u == t and not strict))]
            best = (max if direction == "backward" else min)(own, key=lambda x: x[:2], default=(None, None, None))
            assert got[i] == (best[0], best[2])


def test_asof_of_two_keys_keeps_null_payload(spark):
    e = spark.createDataFrame([("a", 1, 5, 1), ("a", 1, 6, None), ("a", None, 7, 3)], "x string, y int, t long, v int")
    q = spark.createDataFrame([("a", 1, 9), ("a", 2, 9), ("a", None, 9)], "x string, y int, t long")
    assert sorted(map(str, temporal.asof_join(q, e, ["x", "y"], "t", "t", ["v"]).select("y", "asof_t", "asof_v").collect())) == sorted(["Row(y=1, asof_t=6, asof_v=None)", "Row(y=2, asof_t=None, asof_v=None)", "Row(y=None, asof_t=None, asof_v=None)"])


def test_window_counts_and_range_join(spark):
    e = spark.createDataFrame([(1, 10), (1, 10), (1, 20), (2, 15), (None, 10), (1, None)], "k long, t long")
    q = spark.createDataFrame([(7, 1, 20), (7, 1, 20), (8, 2, 15), (9, 1, 9)], "id long, k long, t long")
    got = {x.id: (x.before, x.around) for x in temporal.window_counts(q, e, ["k"], ["id"], "t", "t", {"before": (-10, 0), "around": (-5, 6)}).collect()}
    assert got == {7: (2, 1), 8: (0, 1), 9: (0, 2)}
    spans = spark.createDataFrame([(0, 11), (10, 21), (15, 15), (-5, 100)], "lo long, hi long")
    assert temporal.range_join(e.where("t is not null"), spans, "t", "lo", "hi", 7).count() == 3 + 5 + 5


def test_sessions_carried_over_a_cut(spark):
    ts = [0, 5, 50, 51, 58, 120, 121]
    df = spark.createDataFrame([(1, t) for t in ts], "k long, t long")
    whole = {x.t: x.session_no for x in temporal.sessionize(df, "k", "t", [], 10).collect()}
    assert list(dict(sorted(whole.items())).values()) == [1, 1, 2, 2, 2, 3, 3]
    for cut in (1, 51, 55, 60, 119):
        early = temporal.sessionize(df.where(F.col("t") < cut), "k", "t", [], 10)
        carry = early.groupBy("k").agg(F.max("t").alias("last_at"), F.max("session_no").alias("session_no"))
        late = temporal.carried_sessions(df.where(F.col("t") >= cut), carry, "k", "t", [], 10)
        assert {x.t: x.session_no for x in late.collect()} == {t: s for t, s in whole.items() if t >= cut}


def test_first_event_is_not_moved_forward(spark):
    df = spark.createDataFrame([(1, 5, False), (1, 6, True), (2, 1, True), (None, 1, True)], "k long, t long, ok boolean")
    assert [tuple(x) for x in temporal.first_event(df, "k", ["t"], F.col("ok")).collect()] == [(2, 1, True)]


def test_horizon_bounds(spark):
    q = spark.createDataFrame([(1, 9, 100)], "id long, k long, at long")
    e = spark.createDataFrame([(9, t) for t in (99, 100, 101, 150, 151)], "key long, t long")
    assert sorted(x.t for x in temporal.within_horizon(q, e, ("k", "key"), "at", "t", 50).collect()) == [101, 150]


@pytest.mark.parametrize("target", [8, 100_000])
def test_first_outcome_equals_all_pairs(spark, target):
    r = random.Random(4)
    none = lambda x: r.choice([x, x, x, x, None])
    ev = [(none(r.randrange(3)), none(r.randrange(4)), none(r.randrange(80)), none(r.randrange(80)), i, r.choice([None, f"g{i}"])) for i in range(150)]
    ev += ev[:20]
    q = [(i, none(r.randrange(4)), none(r.randrange(4)), none(r.randrange(90))) for i in range(80)]
    e = spark.createDataFrame(ev, "k long, o long, s long, t long, ord long, gid string")
    left = spark.createDataFrame(q + q[:5], "id long, key long, me long, at long")
    for started in (None, "s"):
        got = temporal.first_outcome(left, e, ["id", "key", "me", "at"], ("key", "k"), "at", "t", 20, ["ord"], ["gid", "ord"], ("me", "o"), started, target).collect()
        assert len(got) == len(q)
        for x in got:
            own = [(t, n, g) for k, o, s, t, n, g in ev if None not in (k, o, t, x.key, x.me, x.at) and k == x.key and o != x.me and x.at < t <= x.at + 20 and (started is None or s is not None and s > x.at)]
            best = min(own, key=lambda v: v[:2], default=(None, None, None))
            assert (x.ord, x.gid) == best[1:]


@pytest.mark.parametrize("target", [8, 100_000])
def test_adjacency_states(spark, target):
    events = [("prior1", 1, 1, 2), ("focal1", 5, 1, 2), ("prior2", 1, 3, 4), ("prior3", 2, 5, 6), ("focal2", 5, 3, 5), ("focal3", 5, 7, 8), ("prior4", 1, 9, 10), ("tied1", 1, 9, 11), ("focal4", 5, 9, 10), ("prior5", 1, 12, 13), ("focal5", 5, 12, 13), ("tied2", 5, 12, 14), ("lost", 6, 15, None), ("null", None, 1, 2)]
    df = spark.createDataFrame(events + events[:3], "g string, t long, a long, b long")
    got = {x.g: x.status for x in temporal.adjacency(df, "g", ("a", "b"), "t", target).collect()}
    assert [got[f"focal{i}"] for i in range(1, 6)] == ["mutual", "different", "left_boundary", "ambiguous", "ambiguous"]
    assert got["lost"] == "unmapped" and "null" not in got and len(got) == 13


def test_last_n_in_blocks(spark):
    r = random.Random(5)
    h = [(k, r.choice([None, *range(60)]), i, r.choice([None, 1.0, 2.5, 7.0, 7.5])) for i, k in enumerate([1] * 40 + [2] * 3 + [None])]
    q = [(i, r.choice([1, 1, 2, 3, None]), r.choice([None, *range(-1, 62)])) for i in range(60)]
    df, ask = spark.createDataFrame(h + h[:6], "k long, t long, o long, v double"), spark.createDataFrame(q + q[:3], "id long, who long, at long")
    for target in (10, 10**6):
        got = temporal.last_n_features(df, ask.withColumnRenamed("who", "k"), "k", "t", "v", ["o"], ["id"], "at", [3, 5], target).collect()
        assert len(got) == len(q)
        for x in got:
            _, who, at = q[x.id]
            own = sorted((t, o, v) for k, t, o, v in h if None not in (who, at, t, k) and k == who and t < at)[::-1][:6]
            assert x.n_prior == len(own)
            for w in (3, 5):
                tie = len(own) > w and own[w - 1][0] == own[w][0]
                z = [v for *_, v in own[:w]]
                assert bool(x[f"tie{w}"]) == tie
                if len(own) < w or tie or None in z:
                    assert x[f"sd{w}"] is None and x[f"span{w}"] is None
                    continue
                line = np.polyfit(np.arange(w), z, 1)
                assert math.isclose(x[f"sd{w}"], np.std(z, ddof=1), abs_tol=1e-9) and math.isclose(x[f"iqr{w}"], np.subtract(*np.quantile(z, [0.75, 0.25])), abs_tol=1e-9)
                assert math.isclose(x[f"detrended{w}"], math.sqrt(((np.array(z) - np.polyval(line, np.arange(w))) ** 2).sum() / (w - 2)), abs_tol=1e-6)


@pytest.mark.parametrize("target", [1])
def test_spaced_times(spark, target):
    r = random.Random(2)
    rows = [(r.choice([1, 2, None]), r.choice([None, *range(300)])) for _ in range(200)] + [(9, 5)]
    got = sorted(map(tuple, temporal.spaced(spark.createDataFrame(rows, "k long, t long"), "k", "t", 20).collect()))
    want = []
    for k in (1, 2, 9):
        last = None
        for t in sorted({t for a, t in rows if a == k and t is not None}):
            if last is None or t > last + 20:
                want.append((k, t))
                last = t
    assert got == want and len(got) > 20


def test_seasonal_scores_of_observed_slots(spark):
    from ledgerwake.operators.anomaly import Baseline, observed_grid, seasonal_scores

    r = random.Random(3)
    covered = [s for s in range(200) if s not in (50, 51, 120)]
    counts = [("a", s, 10 + r.randrange(5) + (300 if s == 100 else 0)) for s in covered if s % 9] + [("b", 70, 3), ("a", 50, 99)]
    traffic = [(s, 100 + r.randrange(20) if s != 90 else 10_000) for s in covered]
    grid = observed_grid(spark.createDataFrame(counts, "k string, s long, n long"), spark.createDataFrame(traffic, "s long, n long"), "k", "s")
    at = {(x.k, x.s): x.n for x in grid.collect()}
    assert len(at) == 2 * len(covered) and at["a", 9] == 0 and ("a", 50) not in at and at["b", 70] == 3
    law = Baseline(offsets=(-20, -10, 10, 20), traffic=(5, 2), least_traffic=50.0, least_references=3)
    before = {s: sum(dict(traffic)[u] for u in range(s - 5, s - 2)) for s in range(205) if all(u in dict(traffic) for u in range(s - 5, s - 2))}
    got = {(x.k, x.s): x for x in seasonal_scores(grid, "k", "s", law, spark.createDataFrame(traffic, "s long, n long")).collect()}
    assert set(got) == set(at)
    for (k, s), x in got.items():
        refs = []
        for o in law.offsets:
            if (k, s + o) in at and s in before and s + o in before and 0.25 <= before[s] / before[s + o] <= 4:
                refs.append(at[k, s + o] * before[s] / before[s + o])
        assert x.refs == len(refs)
        if len(refs) < 3:
            assert x.score is None
            continue
        mid = np.median(refs)
        mad = np.median(np.abs(np.array(refs) - mid))
        assert math.isclose(x.expected, mid) and math.isclose(x.score, (at[k, s] - mid) / max(math.sqrt(mid + 1), 1.4826 * mad), rel_tol=1e-9, abs_tol=1e-9)
    assert got["a", 100].score > 20


def test_replay_of_two_party_states(spark):
    day = 86_400_000
    g = spark.createDataFrame([("p", i * day, f"g{i}", i % 3, 3 + i % 2, 1500 + i, 1500.0, [0.0, 0.5, 1.0][i % 3], i != 3) for i in range(20)] + [("p", None, "x", 1, 2, 1, 1.0, 1.0, True), ("p", 1, "y", 1, 1, 1, 1.0, 1.0, True)], "pool string, t long, g string, a long, b long, ra long, rb double, s double, seen boolean")
    run = lambda d: sorted(map(tuple, temporal.rating_replay(d, "pool", "t", "g", ("a", "b"), ("ra", "rb"), "s", "seen").collect()), key=lambda x: x[1])
    one = run(g)
    assert one == run(g.repartition(3)) and len(one) == 20
    assert one[0][3:9] == (500.0, 500.0, 0.09, 0.09, 0, 0)
    assert one[5][8] == 1 and one[6][7] == 1, "the game that was not observed updates neither player"
    assert all(45 <= x[3] <= 500 for x in one) and one[19][3] < 500
    # the example of the Glicko-2 paper, one opponent at a time of its three: the first game
    law = temporal.ReplayLaw(most_sigma=1.0, tau=0.5, least_rd=1.0)
    rating, rd, sigma = temporal.after_game(1500, 200, 0.06, 1400, 30, 1.0, law)
    assert 1560 < rating < 1567 and 174 < rd < 177 and abs(sigma - 0.06) < 1e-4
    assert math.isclose(temporal.grown(100.0, 0.06, 10.0, law), math.sqrt(100**2 + (0.06 * 173.7178) ** 2 * 2.1436))


# Statistics -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(0)
    n = 600
    u, m = r.integers(0, 40, n), r.integers(0, 6, n)
    x = r.normal(size=n) + u / 20
    y = 0.7 * x + u * 0.1 + m * 0.3 + r.normal(size=n)
    return u, m, x, y, spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, c, d in zip(u, m, x, y, strict=True)], "u long, m long, x double, y double")


def dummies(*codes):
    out = [np.ones((len(codes[0]), 1))]
    out += [(c[:, None] == np.unique(c)[1:]).astype(float) for c in codes]
    return np.hstack(out)


def test_within_and_absorbed_equal_dummy_ols(panel):
    u, m, x, y, df = panel
    one = np.linalg.lstsq(np.hstack([x[:, None], dummies(u)]), y, rcond=None)[0][0]
    fit = moments.within_ols(df, "y", ["x"], "u")
    assert math.isclose(fit["coef"][0], one, rel_tol=1e-8)
    xd, e = x - np.array([x[u == k].mean() for k in u]), None
    e = y - np.array([y[u == k].mean() for k in u]) - one * xd
    meat = sum(((xd * e)[u == k].sum()) ** 2 for k in np.unique(u))
    g, n = len(np.unique(u)), len(u)
    assert math.isclose(fit["se"][0], math.sqrt(g / (g - 1) * (n - 1) / (n - 1) * meat) / (xd @ xd), rel_tol=1e-8)
    two = np.linalg.lstsq(np.hstack([x[:, None], dummies(u, m)]), y, rcond=None)[0][0]
    assert math.isclose(effects.effects_ols(df, "y", ["x"], ["u", "m"])["coef"][0], two, rel_tol=1e-5)


def test_unconverged_absorption_raises(panel):
    with pytest.raises(ArithmeticError):
        effects.absorb(panel[4].withColumn("__n", F.lit(1.0)), ["u", "m"], ["y"], tolerance=1e-14, most=1)


def test_dyadic_meat_equals_all_pairs(spark):
    r = random.Random(3)
    rows = [(r.randrange(8), 8 + r.randrange(6), r.randrange(4), r.gauss(0, 1)) for _ in range(60)]
    df = spark.createDataFrame(rows, "a long, b long, d long, s double")
    share = lambda x, y: bool({x[0], x[1]} & {y[0], y[1]})
    assert math.isclose(moments.dyadic_meat(df, "s", "a", "b"), sum(x[3] * y[3] for x in rows for y in rows if share(x, y)), abs_tol=1e-9)
    assert math.isclose(moments.dyadic_meat(df, "s", "a", "b", "d"), sum(x[3] * y[3] for x in rows for y in rows if share(x, y) or x[2] == y[2]), abs_tol=1e-9)


def test_sets_tails_and_adjustments():
    assert moments.quadratic_set(1, 0, -4) == [(-2.0, 2.0)] and moments.quadratic_set(1, 0, 4) == []
    assert moments.quadratic_set(-1, 0, 4) == [(-math.inf, -2.0), (2.0, math.inf)] and moments.quadratic_set(-1, 0, -4) == [(-math.inf, math.inf)]
    assert math.isclose(moments.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(moments.chi2_sf(30, 10), 0.000856641210775, rel_tol=1e-6)
    assert moments.holm([0.01, 0.04, 0.03]) == [0.03, 0.06, 0.06]
    assert moments.equivalence(0.01, 0.01, 0.05)["equivalent"]
    assert scores.roots([-1, 0, 1], -3, 3) == ([-1.0, 1.0], "several roots") and scores.roots([1, 0, 1], -3, 3)[1] == "no root"


def test_iv_and_weak_set(spark):
    r = np.random.default_rng(1)
    z, e = r.normal(size=500), r.normal(size=500)
    d = z + e + r.normal(size=500)
    y = 2 * d + e
    fit = moments.iv(spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, d, z, strict=True)], "y double, d double, z double"), "y", "d", "z")
    assert abs(fit["iv"] - 2) < 0.2 and len(fit["set"]) == 1 and fit["set"][0][0] < fit["iv"] < fit["set"][0][1]
    weak = moments.iv(spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(y, e, r.normal(size=500), strict=True)], "y double, d double, z double"), "y", "d", "z")
    assert not (len(weak["set"]) == 1 and all(map(math.isfinite, weak["set"][0])))


def test_likelihoods(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(7, 2))
    y, beta = np.array([1, 0, 1, 0, 0, 1, 0]), np.array([0.3, -0.2])
    from itertools import combinations

    total = sum(math.exp(sum(x[i] @ beta for i in s)) for s in combinations(range(7), 3))
    value, grad, info = likelihood.conditional_kernel(x, y, beta)
    assert math.isclose(value, (x @ beta * y).sum() - math.log(total), rel_tol=1e-9)
    h = 1e-5
    for i in range(2):
        step = np.eye(2)[i] * h
        up, down = (likelihood.conditional_kernel(x, y, beta + s) for s in (step, -step))
        assert math.isclose(grad[i], (up[0] - down[0]) / (2 * h), rel_tol=1e-5, abs_tol=1e-7)
        assert np.allclose(info[i], -(up[1] - down[1]) / (2 * h), atol=1e-5)
    start, move, rate = np.array([0.4, 0.6]), np.array([[0.8, 0.2], [0.3, 0.7]]), np.array([0.2, 0.7])
    seq = np.array([1, 0, 1, 1])
    from itertools import product

    p = lambda s: start[s[0]] * math.prod(move[a, b] for a, b in zip(s, s[1:], strict=False)) * math.prod(rate[a] if v else 1 - rate[a] for a, v in zip(s, seq, strict=True))
    every = {s: p(s) for s in product((0, 1), repeat=4)}
    value, post, moves = likelihood.forward_backward(seq, start, move, rate)
    assert math.isclose(value, math.log(sum(every.values())))
    assert np.allclose(post[2, 1], sum(v for s, v in every.items() if s[2]) / sum(every.values()))
    assert math.isclose(moves.sum(), 3)
    u = r.integers(0, 60, 3000)
    low = u < 30
    k = spark.createDataFrame([(int(a), int(r.random() < (0.1 if b else 0.6))) for a, b in zip(u, low, strict=True)], "u long, y int").groupBy("u").agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    fit = likelihood.binomial_mixture(k, "n", "k", 2)
    assert np.allclose(fit["rate"], [0.1, 0.6], atol=0.05) and np.allclose(fit["share"], 0.5, atol=0.15)


def test_hidden_states_converge_or_raise(spark):
    r = random.Random(5)
    rows = []
    for u in range(60):
        state = r.random() < 0.5
        for t in range(20):
            state = state if r.random() < 0.85 else not state
            rows.append((u, t, float(r.random() < (0.75 if state else 0.15))))
    df = spark.createDataFrame(rows, "u long, t long, y double")
    fit = likelihood.hidden_states(df, "u", ["t"], "y")
    own = [np.array([y for v, _, y in rows if v == u]) for u in range(60)]
    now = [likelihood.forward_backward(y, fit["start"], fit["move"], fit["rate"]) for y in own]
    assert math.isclose(sum(x[0] for x in now), fit["loglik"], rel_tol=1e-10)  # of the numbers returned
    start, move = sum(x[1][0] for x in now), sum(x[2] for x in now)
    rate = sum((x[1] * y[:, None]).sum(0) for x, y in zip(now, own, strict=True)) / sum(x[1].sum(0) for x in now)
    more = sum(likelihood.forward_backward(y, start / start.sum(), move / move.sum(1, keepdims=True), rate)[0] for y in own)
    assert 0 <= more - fit["loglik"] <= 1e-6 * abs(more)  # another round gains nothing
    with pytest.raises(ArithmeticError):
        likelihood.hidden_states(df, "u", ["t"], "y", 5)


def test_hidden_states_query_is_converged(spark):
    import __spark_entry__ as entry

    got = {x.term: x.value for x in entry.queries()["hmm_states"](spark, "/root/testdata/sf0.001").collect()}
    assert abs(got["loglik"] + 472.645) < 0.01  # -473.0 or less after five rounds


def test_random_intercept_of_many_cells(spark, monkeypatch):
    cells = spark.range(100_200).select((F.col("id").cast("int") / 300 + 300).cast("long").alias("n"), (F.col("id") % 300).alias("k"))
    far = likelihood.random_intercept(cells, "n", "k", 3)
    monkeypatch.setattr(likelihood, "DRIVER_CELLS", 1_000_000)
    here = likelihood.random_intercept(cells, "n", "k", 3)
    assert all(math.isclose(far[x], here[x], rel_tol=1e-6) for x in here)


def test_fits_converge_or_raise(spark):
    apart = spark.createDataFrame([(x, 10, 10 if x > 0 else 0) for x in (-2.0, -1.0, 1.0, 2.0)], "x double, n long, k long")
    with pytest.raises(ArithmeticError):
        likelihood.logit(apart, "n", "k", ["x"], most=8)
    one = spark.createDataFrame([(1, 2.0, 0.5), (1, 3.0, 1.5), (2, 1.0, 0.2), (2, 9.0, 1.1)], "u long, k double, x double")
    with pytest.raises(ArithmeticError):
        likelihood.effect_poisson(one, "u", "k", ["x"], most=1)
    with pytest.raises(ArithmeticError):
        likelihood.binomial_mixture(spark.createDataFrame([(10, i % 11) for i in range(60)], "n long, k long"), "n", "k", 2, rounds=2)
    with pytest.raises(ArithmeticError):
        likelihood.conditional_logit(one.withColumn("y", (F.col("k") > 2.5).cast("double")), "u", "y", ["x"], most=1)
    with pytest.raises(ArithmeticError):
        likelihood.calibrate(one.withColumn("y", F.lit(1.0)), "u", "x", "y", most=1)
    got = {r.u: (r.n, r.intercept) for r in likelihood.calibrate(one.withColumn("y", (F.col("k") > 2.5).cast("double")), "u", "x", "y").collect()}
    for u, xs, k in ((1, (0.5, 1.5), 1), (2, (0.2, 1.1), 1)):
        p = [1 / (1 + math.exp(-(x + got[u][1]))) for x in (*xs, 0.0, 0.0)]
        assert got[u][0] == 2 and math.isclose(sum(p), k + 1, abs_tol=1e-8)
    a, b = {"rate": np.array([0.1, 0.6]), "share": np.array([0.7, 0.3])}, {"rate": np.array([0.62, 0.12]), "share": np.array([0.3, 0.7])}
    assert likelihood.aligned(a, b) == [1, 0]


def test_clustered_errors_of_matching_and_surfaces(spark):
    r = random.Random(11)
    rows = [(u, r.random() < 0.5, r.choice("ab"), r.gauss(0, 1), r.random()) for u in range(30) for _ in range(r.choice([1, 4]))]
    df = spark.createDataFrame(rows, "u long, t boolean, s string, z double, y double")
    mean = {(s, t): np.mean([y for _, t2, s2, _, y in rows if (s2, t2) == (s, t)]) for s in "ab" for t in (True, False)}
    size = {k: sum((s2, t2) == k for _, t2, s2, *_ in rows) for k in mean}
    out = scores.matched_effect(df, "t", ["s"], "y", "u").first()
    treated = size["a", True] + size["b", True]
    part = {u: sum((y - mean[s, True]) if t else -size[s, True] / size[s, False] * (y - mean[s, False]) for v, t, s, _, y in rows if v == u) for u in range(30)}
    assert math.isclose(out.se, math.sqrt(sum(x * x for x in part.values())) / treated, rel_tol=1e-9)
    fits = {x.s: x for x in scores.surface_fits(df.withColumn("q", F.col("z") ** 2), ["s"], ["z", "q"], "y").collect()}
    at = np.array([1, np.mean([z for *_, z, _ in rows]), np.mean([z * z for *_, z, _ in rows])])
    for s in "ab":
        z, y = (np.array([x[i] for x in rows if x[2] == s]) for i in (3, 4))
        beta = np.linalg.lstsq(np.stack([np.ones(len(z)), z, z * z], 1), y, rcond=None)[0]
        assert np.allclose(fits[s].coefficients, beta) and math.isclose(fits[s].standardized, beta @ at, rel_tol=1e-7)
    flat = scores.surface_fits(df.withColumn("z", F.lit(1.0)), ["s"], ["z"], "y").collect()
    assert all(x.coefficients is None and x.standardized is None for x in flat)


def test_grouped_sums_cross_batches(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("g"), "id", F.lit(1.0).alias("x"))
    rows = likelihood.Grouped(df, "g", ["id"], ["x"])
    assert rows.total(lambda v: np.array([len(v) ** 2, 1.0]), 2).tolist() == [sum(len(range(k, 5000, 7)) ** 2 for k in range(7)), 7.0]
    rows.close()


def test_scores(spark):
    df = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0), (1, 3, 1.0), (4, 2, 1.0)], "u long, v long, y double")
    assert {(x.u, x.v): (x.n, x.score) for x in scores.pair_excluded_score(df, "u", "v", "y").collect()} == {(1, 2): (2, 0.5), (1, 3): (1, 1.0), (4, 2): (0, None)}
    a, b = (sorted(map(tuple, scores.bootstrap(d, "u", "y", 5).collect())) for d in (df, df.repartition(3)))
    assert a == b and len(a) == 5
    big = spark.range(400).select("id", (F.col("id") % 2 == 0).alias("t"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1).alias("c"))
    assert {(x.pairs, x.effect) for x in scores.rematch(big, ["c"], "id", "t", "y", 3).collect()} == {(200, -1.0)}
    filled = scores.imputed(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", float("nan"))], "c string, v double"), ["c"], ["v"])
    assert sorted((x.c, x.v_filled, x.v_missing) for x in filled.where("v_filled is not null").collect()) == [("a", 1.0, False), ("a", 2.0, True), ("a", 3.0, False)]


def number(unit, draw):
    """The draw number by its definition."""
    digest = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % (2**31 - 1)
    a, b, c, d = (digest(f"1|{draw}|{j}") for j in range(4))
    x = digest(str(unit))
    return (a * x**3 + b * x**2 + c * x + d) % (2**31 - 1)


def test_crossfit_scores_equal_rows_one_by_one(spark):
    r = random.Random(12)
    fold = lambda x: int(hashlib.md5(str(x).encode()).hexdigest()[:8], 16) % 4
    h = [(r.choice([*range(12), None]), r.choice([*range(20, 32), None]), r.randrange(40), r.choice("xy"), r.choice([0.0, 1.0, None])) for _ in range(300)]
    q = [(j, i) for j in range(14) for i in range(20, 33)] + [(None, 20), (1, 20)]
    got = scores.crossfit_scores(spark.createDataFrame(h, "j long, i long, t long, c string, y double"), spark.createDataFrame(q, "j long, i long"), "j", "i", "t", "c", "y", 30).collect()
    past = [x for x in h if x[2] < 30 and None not in x]
    assert len(got) == len({x for x in q if None not in x})
    for x in got:
        own = [z for z in past if z[0] == x.j and z[1] != x.i]
        assert (x.n, x.pair_removed, x.counterparts) == (len(own), sum(z[0] == x.j and z[1] == x.i for z in past), len({z[1] for z in own}))
        if not own:
            assert x.raw is None and x.adjusted is None
            continue
        out = {fold(x.j), fold(x.i)}
        clean = [z for z in past if fold(z[0]) not in out and fold(z[1]) not in out]
        p = (sum(z[4] for z in clean) + 0.5) / (len(clean) + 1)
        rate = {c: (sum(z[4] for z in clean if z[3] == c) + 50 * p) / (sum(z[3] == c for z in clean) + 50) for c in "xy"}
        assert math.isclose(x.raw, np.mean([z[4] for z in own])) and math.isclose(x.expected, np.mean([rate[z[3]] for z in own]), rel_tol=1e-9)


def test_rematch_in_order_of_hash(spark):
    r = random.Random(7)
    rows = [(r.choice("abc"), i, r.random() < 0.4, r.random()) for i in range(120)]
    df = spark.createDataFrame(rows, "c string, id long, t boolean, y double")
    for k in (1, 2):
        got = {x.draw: (x.pairs, x.effect) for x in scores.rematch(df, ["c"], "id", "t", "y", 12, k).collect()}
        assert sorted(got) == list(range(1, 13))
        for draw in got:
            gaps = []
            for cell in "abc":
                own = sorted((number(i, draw), t, y) for c, i, t, y in rows if c == cell)
                case, control = ([y for _, t, y in own if t == side] for side in (True, False))
                gaps += [a - sum(b) / len(b) for a, b in zip(case, (control[j : j + k] for j in range(0, len(control), k)), strict=False)]
            assert got[draw][0] == len(gaps) and math.isclose(got[draw][1], sum(gaps) / len(gaps), rel_tol=1e-9)


def test_randomized_in_order_of_hash(spark):
    r = random.Random(8)
    rows = [(u, i, r.random() < 0.3, r.random()) for u in range(9) for i in range(r.choice([1, 4, 30, 300]))]
    df = spark.createDataFrame(rows, "u long, i long, y boolean, x double").repartition(3)
    got = {x.draw: x.statistic for x in scores.randomized(df, "u", "y", "x", "i", 12).collect()}
    want = {0: sum(x for _, _, y, x in rows if y)}
    for d in range(1, 13):
        own = [sorted((number(i, d), str(i), x) for v, i, _, x in rows if v == u)[: sum(y for v, _, y, _ in rows if v == u)] for u in range(9)]
        want[d] = sum(x for o in own for *_, x in o)
    assert sorted(got) == sorted(want) and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_resampling_queries_make_100_draws(spark):
    import __spark_entry__ as entry

    found = {q: sorted(x.draw for x in entry.queries()[q](spark, "/root/testdata/sf0.001").collect()) for q in ("rematch_draws", "randomization_law")}
    assert found == {"rematch_draws": list(range(1, 101)), "randomization_law": list(range(101))}


# Contracts and sources ------------------------------------------------------------


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k long, s string")
    with pytest.raises(contracts.ContractError):
        contracts.ensure_unique(df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.checked_join(df, df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.require_schema(df, {"k": "int"})
    with pytest.raises(contracts.ContractError):
        contracts.aliased(df.withColumn("K2", F.lit(1)), {"key": ["k", "K2"]})
    assert contracts.aliased(df, {"key": ["k", "kk"], "x": ["x"]}, {"x": "double"}).columns == ["key", "x"]
    assert contracts.same_rows(df, df.repartition(3)) and not contracts.same_rows(df, df.unionAll(df))
    assert [tuple(x) for x in contracts.flow(df, {"one": F.col("k") == 1, "named": F.col("s") == "a"}).collect()] == [(0, "all", 3), (1, "one", 2), (2, "named", 1)]
    assert contracts.coverage(df, df.where("k = 1"), ["k"]).collect()[0].asDict() == {"k": 2, "side": "left"}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k long, s string")
    tables.publish(df, f"{tmp_path}/p")
    with pytest.raises(FileExistsError):
        tables.publish(df, f"{tmp_path}/p")
    assert tables.read_parquet(spark, f"{tmp_path}/p", columns=["s"]).count() == 3
    tables.write_parquet(df, f"{tmp_path}/q", ["s"])
    assert contracts.same_rows(tables.read_parquet(spark, f"{tmp_path}/q").select("k", "s"), df)
    tables.append([f"{tmp_path}/p"], spark, f"{tmp_path}/all")
    tables.append([f"{tmp_path}/p"], spark, f"{tmp_path}/all")
    assert spark.read.parquet(f"{tmp_path}/all").count() == 6
    feet = tables.footers(spark, f"{tmp_path}/p").where("column = 'k'").collect()
    assert sum(x.rows for x in feet) == 3 and min(int(x.low) for x in feet if x.low) == df.agg(F.min("k")).first()[0]
    plan = tables.read_parquet(spark, f"{tmp_path}/p").where("k = 1").select("s")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(k), EqualTo(k,1)]" in plan and "ReadSchema: struct<k:bigint,s:string>" in plan
    made = tables.write_archives(df.coalesce(1), f"{tmp_path}/z", "npz").collect()
    with np.load(f"{tmp_path}/z/{made[0].file}") as z:
        assert sorted(z["k"].tolist()) == sorted(x.k for x in df.collect())
    assert [x.rows for x in tables.write_archives(df.coalesce(1), f"{tmp_path}/z", "zip").collect()] == [3]
    tables.compact(spark, f"{tmp_path}/p", f"{tmp_path}/small")
    assert contracts.same_rows(spark.read.parquet(f"{tmp_path}/small"), df) and len(tables.data_files(spark, f"{tmp_path}/small")) == 1
    with pytest.raises(contracts.ContractError):
        contracts.conserved(df, f"{tmp_path}/lost", lambda d, to: d.limit(1).write.parquet(to))
    tables.write_csv(df, f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", "k long, s string").count() == 3
    (tmp_path / "n.json").write_text('{"k": 1}\nnot json\n')
    assert sorted(map(str, tables.read_ndjson(spark, f"{tmp_path}/n.json", "k long").collect())) == ["Row(k=1, _corrupt=None)", "Row(k=None, _corrupt='not json')"]
    (tmp_path / "g.txt").write_text('[Event "a"]\n[White "x"]\n\n1. e4\n\n[Event "b"]\n1. d4\n')
    got = tables.read_records(spark, f"{tmp_path}/g.txt", "[Event", {"event": r'\[Event "(.*?)"', "white": r'\[White "(.*?)"'}).select("event", "white").collect()
    assert sorted(map(tuple, got)) == [("a", "x"), ("b", None)]
    for begin, text in (("[Event ", '[Event "a"]\n[White "x"]\n\n1. e4\n\n[Event "b"]\n1. d4\n'), ("\n[Event ", '[Event "a"]\n[White "x"]\n\n1. e4\n\n[Event "b"]\n1. d4\n')):
        (tmp_path / "h.txt").write_text(text)
        got = tables.read_records(spark, f"{tmp_path}/h.txt", begin, {"event": r'^\[Event "(.*?)"', "white": r'\[White "(.*?)"'}).select("event", "white").collect()
        assert sorted(map(tuple, got)) == [("a", "x"), ("b", None)]
    stages, made = tables.Stages(spark, f"{tmp_path}/s"), []

    def make():
        made.append(1)
        return df

    for settings in ({"v": 1}, {"v": 1}, {"v": 2}):
        stages.run("one", make, [f"{tmp_path}/p"], settings)
    assert len(made) == 2
    tables.append([f"{tmp_path}/q"], spark, f"{tmp_path}/p")
    stages.run("one", make, [f"{tmp_path}/p"], {"v": 2})
    assert len(made) == 3, "the input changed"
    assert tables.scored_by_process(df, "k long, s string", lambda: lambda b: b).count() == 3


def test_stream_equals_batch_in_several_triggers(spark, tmp_path):
    rows = [(i, i % 5, 1_700_000_000_000 + i * 400_000) for i in range(200)]
    spark.createDataFrame(rows, "id long, u long, ms long").repartitionByRange(4, "ms").write.parquet(f"{tmp_path}/e")
    stream = lambda: streams.timed(streams.stream_parquet(spark, f"{tmp_path}/e"), "ms", "30 days")
    counts = streams.closed(streams.window_counts(stream(), ["u"], "1 hour"), "complete")
    want = spark.read.parquet(f"{tmp_path}/e").groupBy("u", F.window(F.timestamp_millis("ms"), "1 hour")).count()
    assert counts.count() == want.count() and counts.agg(F.sum("n")).first()[0] == 200


def test_stream_orders_late_events_and_drops_idle_state(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, i % 3, 1_700_000_000_000 + r.randrange(60) * 60_000 + (i // 40) * 7_200_000) for i in range(160)]
    arrive = sorted(rows, key=lambda x: x[2] + r.randrange(1_800_000))
    for k in range(0, 160, 20):
        spark.createDataFrame(arrive[k : k + 20], "id long, u long, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    spark.createDataFrame([(-1, -1, 3_000_000_000_000)], "id long, u long, ms long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    stream = streams.timed(streams.stream_parquet(spark, f"{tmp_path}/e"), "ms", "40 minutes")
    got = {x.id: x.n_before for x in streams.closed(streams.session_positions(stream, "u", "ms", "id", 3_600_000), "append").collect() if x.u >= 0}
    want = {}
    for u in range(3):
        n, last = 0, None
        for i, _, t in sorted((x for x in rows if x[1] == u), key=lambda x: (x[2], x[0])):
            n = 0 if last is None or t - last >= 3_600_000 else n
            want[i], n, last = n, n + 1, t
    assert got == want


def test_stream_distinct_in_several_triggers(spark, tmp_path, monkeypatch):
    from ledgerwake.plans import streamed

    whole = streams.stream_parquet
    monkeypatch.setattr(streams, "stream_parquet", lambda spark, folder, _: whole(spark, folder, 1))
    for day in (1, 9, 2, 20, 1, 20, 5):  # files out of order, a repeat days apart
        rows = [(day, 7, "a", 86_400 * day), (1000, 7, "a", 86_400 * day)]
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, s long").select("event_id", "user_id", "event_type", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    got = sorted(x.event_id for x in streamed.stream_distinct(spark, str(tmp_path)).collect())
    assert got == [1, 2, 5, 9, 20, 1000]
