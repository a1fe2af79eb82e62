"""The problems' general operators against brute force, with the dirty cases their docstrings define."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerwake.operators import copydiff
from ledgerwake.operators.copydiff import Field, compare_copies
from ledgerwake.operators.intervals import periods, periods_and_gaps
from ledgerwake.operators.rolling import every_day, trailing_totals
from ledgerwake.operators import skew
from ledgerwake.operators.skew import key_profile, row_ids, running_labels
from ledgerwake.operators.versions import attributes_at


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Intervals ------------------------------------------------------------------------

SPANS = "e long, a long, b long, prior string, label long"


def merged(spans):
    own = defaultdict(list)
    for e, a, b in spans:
        if None not in (e, a, b) and b >= a:
            own[e].append((a, b))
    out = []
    for e, xs in own.items():
        at = None
        for a, b in sorted(xs):
            if at and a <= at[1]:
                at[1] = max(at[1], b)
            else:
                at = [a, b]
                out.append((e, at))
    return sorted((e, a, b) for e, (a, b) in out)


@pytest.mark.parametrize("target", [3, 40, 10_000])
def test_periods_equal_brute_force_at_any_split(spark, target):
    r = random.Random(target)
    spans = [(r.choice([1, 1, 1, 2, 3, None]), x := r.randrange(400), x + r.choice([0, 0, 1, 5, 30, -2])) for _ in range(300)]
    spans += spans[:20] + [(1, None, 5), (1, 5, None)]
    df = spark.createDataFrame([(*s, "x", 1) for s in spans], SPANS)
    found = periods(df, "e", "a", "b", target)
    assert sorted(tuple(x) for x in found.select("e", "from_at", "to_at").collect()) == merged(spans)
    numbers = found.groupBy("e").agg(F.sort_array(F.collect_list("period_no"))).collect()
    assert all(r[1] == list(range(1, len(r[1]) + 1)) for r in numbers)


def test_touching_nested_and_zero_length(spark):
    df = spark.createDataFrame([(1, 0, 10, "", 0), (1, 10, 10, "", 0), (1, 2, 3, "", 0), (1, 20, 20, "", 0), (1, 21, 22, "", 0)], SPANS)
    assert rows(periods_and_gaps(df, "e", "a", "b", 5)) == [(1, "gap", 20, 21), (1, "period", 0, 10), (1, "period", 20, 20), (1, "period", 21, 22)]
    assert (1, "gap", 10, 20) in rows(periods_and_gaps(df, "e", "a", "b"))
    assert rows(periods_and_gaps(df.limit(0), "e", "a", "b")) == []


@pytest.mark.parametrize("shape", ["outlier", "one moment", "even"])
def test_chunks_of_hot_keys_are_even(spark, shape):
    at = {"outlier": F.when(F.col("id") == 0, 10**15).otherwise(F.col("id") % 50), "one moment": F.lit(7), "even": F.col("id") * 3}[shape].cast("long")
    df = spark.range(40_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("k"), at.alias("at"), F.col("id").alias("i"))
    hot = skew.hot_keys(df, "k", 2_000)
    assert [r.k for r in hot.keys.collect()] == [99] and hot.rows == 36_000
    laid = skew.chunked(df.join(hot.keys, "k", "left_semi"), "k", ["at", "i"], hot.rows, 2_000)
    sizes = [r["count"] for r in laid.groupBy("k", "__chunk").count().collect()]
    assert sum(sizes) == 36_000 and max(sizes) <= 2 * 2_000 and len(sizes) > 10
    got = running_labels(df, "k", "at", "i", lambda p: F.lit(True), ["i"], 2_000, label="no", second=("two", lambda p: p))
    want = running_labels(df, "k", "at", "i", lambda p: F.lit(True), ["i"], 10**9, label="no", second=("two", lambda p: p))
    assert got.exceptAll(want.select(*got.columns)).isEmpty() and want.select(*got.columns).exceptAll(got).isEmpty()


def test_many_hot_keys_and_open_intervals_are_joined(spark, monkeypatch):
    monkeypatch.setattr(skew, "LISTED", 2)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 1)
    monkeypatch.setattr(skew, "MOST_CHUNKS", 40)
    df = spark.range(3_000).select((F.col("id") % 6).alias("k"), F.col("id").alias("at"), (F.col("id") * 7919 % 1000).cast("double").alias("v"))
    got, want = (running_labels(df, "k", "at", "v", lambda p: p.isNull() | (F.col("v") > p), [], n).orderBy("at").collect() for n in (100, 10**9))
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
    wanted = df.groupBy("k").agg(F.lit(250).cast("long").alias("rank"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    for n in (100, 10**9):
        own = {r.k: r.result for r in skew.order_statistics(df, "k", "v", wanted, 8, n).collect()}
        assert own == {k: sorted(float(i * 7919 % 1000) for i in range(k, 3000, 6))[250] for k in range(6)}


def test_order_statistics_of_a_long_tail(spark):
    values = [float(i) for i in range(200)] + [10.0**e for e in range(3, 300, 7)] + [-(10.0**e) for e in range(3, 300, 11)]
    df = spark.createDataFrame([(1, v) for v in values], "k int, v double")
    wanted = df.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(values) - 1).cast("long"), F.lit(9).cast("long"))).alias("rank"), "lo", "hi")
    got = {r["rank"]: r.result for r in skew.order_statistics(df, "k", "v", wanted, 16).collect()}
    assert all(got[i] == sorted(values)[i] for i in got) and len(got) > 20


def test_running_labels_equal_without_and_with_chunks(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(r.choice("aab"), r.randrange(50), i, r.choice([None, r.randrange(9)])) for i in range(400)], "k string, t long, i long, v int")
    out = [rows(running_labels(df, "k", "t", "v", lambda p: p.isNull() | (F.col("v") > p), ["i"], n)) for n in (10, 100_000)]
    assert out[0] == out[1] and len(out[0]) == 400


# Skewed keys ----------------------------------------------------------------------


@pytest.mark.parametrize("target", [20, 100_000])
def test_profile_is_exact_with_nulls_ties_and_a_hot_key(spark, target):
    r = random.Random(5)
    data = [(7 if r.random() < 0.4 else r.randrange(-1, 30), f"r{i}", r.choice([None, float("nan"), 1.0, 2.5, r.gauss(0, 1e6), r.random()])) for i in range(800)]
    data += data[:50] + [(None, "n1", 1.0), (7, None, 2.0)]
    df = spark.createDataFrame([(*x, 0) for x in data], "u long, id string, v double, lo int")
    got = {x.u: x for x in key_profile(df, "u", "id", "v", (0.1, 0.5, 0.9), 0.1, 4, target).collect()}
    own = defaultdict(dict)
    for u, i, v in data:
        if i is not None:
            own[u][i] = v
    total = len({i for _, i, _ in data if i is not None})
    assert set(got) == {u for u in own if u is not None and u >= 0}
    for u, x in got.items():
        vs = [v for v in own[u].values() if v is not None and not math.isnan(v)]
        assert (x.n_records, x.n_values, x.heavy) == (len(own[u]), len(vs), len(own[u]) >= 0.1 * total)
        for p, q in ((0.1, x.q10), (0.5, x.q50), (0.9, x.q90)):
            assert q is None if not vs else math.isclose(q, np.quantile(vs, p), rel_tol=1e-9, abs_tol=1e-9)
    assert key_profile(df.limit(0), "u", "id", "v").collect() == []


def test_profile_with_infinite_and_extreme_values(spark):
    inf = float("inf")
    data = [(1, i, v) for i, v in enumerate([-inf, 1.0, 2.0, inf, inf])] + [(2, i, v) for i, v in enumerate([-1.7e308, 1.7e308, 5e-324, 0.0, -0.0])]
    df = spark.createDataFrame(data, "u long, id long, v double")
    assert {x.u: (x.q25, x.q50, x.q75) for x in key_profile(df, "u", "id", "v", (0.25, 0.5, 0.75)).collect()} == {1: (1.0, 2.0, inf), 2: (0.0, 0.0, 5e-324)}


def test_row_ids(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "v long")
    assert {x.v: x.row_no for x in row_ids(df, ["v"], partitions=5).collect()} == {v: v + 1 for v in range(50)}
    assert row_ids(df.limit(0), ["v"]).count() == 0


# Copies ---------------------------------------------------------------------------

COPY = "k long, rev int, s string, x double, bucket int, h int"
FIELDS = [("s", None), ("x", 1e-9)]


def fields():
    return [Field(n, F.col(n), F.col(n), t) for n, t in FIELDS]


def differences(a, b):
    def top(data):
        out = {}
        for k, rev, s, x in data:
            if k is not None and (k not in out or (rev or -1) > (out[k][0] or -1)):
                out[k] = (rev, s, x)
        return out

    a, b, out = top(a), top(b), []
    for k in set(a) | set(b):
        if k not in a or k not in b:
            out.append((k, "only_main" if k in a else "only_copy"))
            continue
        (_, s, x), (_, t, y) = a[k], b[k]
        if s != t:
            out.append((k, "s"))
        nulls = (x is None) != (y is None)
        if nulls or x is not None and y is not None and (math.isnan(x) != math.isnan(y) or abs(x - y) > 1e-9):
            out.append((k, "x"))
    return sorted(out, key=str)


@pytest.mark.parametrize(("cells", "per_bucket"), [(240, 500), (30, 40), (3, 500)])
def test_copies_whatever_the_table_size(spark, cells, per_bucket):
    """Three cells can't peel: all keys are then compared, and nothing is lost."""
    r = random.Random(cells)
    values = [None, float("nan"), 0.0, -0.0, 1e300, float("inf"), 0.123]
    main = [(i, 1, r.choice(["a", "b", None]), r.choice(values)) for i in range(300)]
    copy = [(i, v, r.choice([s, s, s, s, "c"]), r.choice([x, x, x, x + 1e-12 if x else x, x + 1e-6 if x else 5.0])) for i, v, s, x in main if r.random() > 0.03]
    copy += [(1000 + i, 1, "new", 1.0) for i in range(9)]
    main += main[:10] + [(3, 5, "later", 1.0), (None, 1, "z", 1.0)]
    copy += copy[:10] + [(4, None, "older", 9.0)]
    a, b = (spark.createDataFrame([(*x, 0, 0) for x in d], COPY) for d in (main, copy))
    got = compare_copies(a, b, ["k"], fields(), "rev", per_bucket, cells)
    assert rows(got.select("k", "diff")) == differences(main, copy)
    assert compare_copies(a, a, ["k"], fields(), "rev").collect() == []
    with pytest.raises(TypeError):
        compare_copies(a, a, ["k"], [Field("k", F.col("k"), F.col("k").cast("string"))], "rev")
    assert rows(compare_copies(a.limit(0), b, ["k"], fields(), "rev").select("diff").distinct()) == [("only_copy",)]


def test_element_hash_is_sparks(spark):
    df = spark.createDataFrame([(5, -7), (2**62, -(2**63))], "a long, b long")
    for a, b, x, y in df.select("a", "b", F.xxhash64("a", "b"), F.xxhash64("a", "b", F.lit(3).cast("long"))).collect():
        assert copydiff._element_hash(a, b, 3) == (x & copydiff.MASK, y & copydiff.MASK)


# Attributes at event time -----------------------------------------------------------


@pytest.mark.parametrize("target", [15, 100_000])
def test_attributes_at(spark, target):
    r = random.Random(target)
    h = [(r.choice([1, 1, 2, None]), r.choice([None, *range(40)]), r.choice([None, *range(50)]), i, r.randrange(9)) for i in range(200)]
    h += h[:30]
    e = [(i, r.choice([1, 2, 3, None]), r.choice([None, *range(60)]), "c") for i in range(120)]
    hist = spark.createDataFrame(h, "p long, valid long, known long, no long, elo int")
    events = spark.createDataFrame(e, "id long, p long, t long, elo string")

    def best(p, t):
        own = [(v, n, x) for q, v, k, n, x in h if q == p and None not in (p, t, v, k) and v <= t and k <= t]
        return max(own, default=None)

    got = {x.id: (x.then_valid, x.then_no, x.then_elo) if x.then_no is not None else None for x in attributes_at(events, hist, "p", "t", "valid", "known", "no", ["elo"], True, target).collect()}
    assert got == {i: best(p, t) for i, p, t, _ in e}
    inner = attributes_at(events, hist, "p", "t", "valid", "known", "no", ["elo"], False, target)
    assert inner.count() == sum(x is not None for x in got.values()) and inner.columns[:4] == events.columns
    assert attributes_at(events, hist.limit(0), "p", "t", "valid", "known", "no", ["elo"]).count() == 0
    assert attributes_at(events.limit(0), hist, "p", "t", "valid", "known", "no", ["elo"]).count() == 0


# Trailing totals --------------------------------------------------------------------


def test_trailing_totals_with_records_of_several_days(spark):
    r = random.Random(2)
    acts = [(r.choice([1, 2, None]), r.choice([f"g{r.randrange(60)}", None]), r.choice([None, *range(90)])) for _ in range(500)]
    acts += acts[:50]
    days = [(u, d) for u in (1, 2, 3) for d in range(-2, 100, 3)] + [(1, 1), (1, 1), (None, 4), (1, None)]
    a = spark.createDataFrame([(*x, 1) for x in acts], "u long, g string, d int, n int")
    c = spark.createDataFrame(days, "u long, d int")
    got = {(x.u, x.d): (x.n_7d, x.n_30d, x.mean_30d) for x in trailing_totals(a, c, "u", "g", "d").collect()}
    count = lambda u, d, w: len({g for v, g, x in acts if v == u and g is not None and x is not None and d - w <= x < d})
    assert got == {(u, d): (count(u, d, 7), count(u, d, 30), count(u, d, 30) / 30) for u, d in days if u is not None and d is not None}
    assert trailing_totals(a, c.limit(0), "u", "g", "d").count() == 0
    assert {x.n_7d for x in trailing_totals(a.limit(0), c, "u", "g", "d").collect()} == {0}
    assert every_day(a.where("u = 1 and d between 3 and 5"), "u", "d", 2).count() in range(3, 6)
