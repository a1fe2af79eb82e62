"""Work by key when a few keys hold most of the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.session import materialize, release

#: Key lists, chunk summaries and intervals of up to so many rows are broadcast; more are joined.
BROADCAST_ROWS = 200_000
#: One row of so many is counted to find the hot keys.
SAMPLED = 16
#: Hot keys of up to this number pass through the driver.
LISTED = 10_000
#: Chunks of the hot rows: so many at most, each then holding more rows than ``target_rows``.
MOST_CHUNKS = 20_000


@dataclass(frozen=True)
class Hot:
    """The hot keys as a table of one column, their number and about how many rows they have."""

    keys: DataFrame
    number: int
    rows: int


def hot_keys(df: DataFrame, key: str, target_rows: int) -> Hot | None:
    """The keys of more than about ``target_rows`` rows; None if there are none.

    Hot or not only decides how a key is computed, never what comes out. So
    one row of ``SAMPLED`` is counted, which keeps the shuffle of the counts small.
    """
    share = SAMPLED if target_rows >= 64 * SAMPLED else 1
    rows = df.select(F.col(key).alias("k"))
    rows = rows.sample(1 / share, 1) if share > 1 else rows
    found = rows.where("k is not null").groupBy("k").agg((F.count("*") * share).alias("n")).where(F.col("n") > target_rows)
    listed = found.limit(LISTED + 1).collect()
    if not listed:
        return None
    if len(listed) <= LISTED:
        keys = df.sparkSession.createDataFrame([(r.k,) for r in listed], T.StructType([T.StructField(key, df.schema[key].dataType)]))
        return Hot(F.broadcast(keys), len(listed), sum(r.n for r in listed))
    found = materialize(found, "hot-keys")
    number, total = found.agg(F.count("*"), F.sum("n")).first()
    keys = found.select(F.col("k").alias(key))
    return Hot(F.broadcast(keys) if number <= BROADCAST_ROWS else keys, number, total)


def chunked(df: DataFrame, key: str, order: Sequence[str], rows: int, target_rows: int) -> DataFrame:
    """``df`` laid out by (key, order) in ranges of about equal counts, written once, with ``__chunk`` and ``__seq``.

    Chunks follow the order of the rows, ties are cut as well (``__seq`` tells
    equal rows apart), so neither an outlier nor a single moment that holds
    all rows makes a large chunk.
    """
    n = max(2, min(-(-3 * rows // target_rows), MOST_CHUNKS))
    laid = df.withColumn("__seq", F.monotonically_increasing_id()).repartitionByRange(n, key, *order, "__seq")
    return materialize(laid.withColumn("__chunk", F.spark_partition_id()), "chunks")


def running_labels(
    df: DataFrame,
    key: str,
    at: str,
    value: str,
    starts: Callable[[Column], Column] | None,
    ties: Sequence[str] = (),
    target_rows: int = 100_000,
    prior: str = "prior",
    label: str = "label",
    least: bool = False,
    second: tuple[str, Callable[[Column], Column]] | None = None,
) -> DataFrame:
    """Number the runs of each key in the order of (``at``, ``ties``).

    Adds ``prior``, the maximum (the minimum if ``least``) of ``value`` over the
    key's earlier rows (null where there is none), and ``label``, the running
    count of the rows at which ``starts(prior)`` holds; without ``starts`` there is
    no label. ``second`` = (name, f) adds the same maximum of ``f(prior)`` over the
    earlier rows. Rows with a null in key or ``at`` are left out.

    Keys of more than ``target_rows`` rows are cut into chunks of equal counts (see
    ``chunked``); a chunk takes its running maximum and its count from the
    summaries of the chunks before it, so no task gets a whole hot key. There
    is no bound on the number of hot keys: their list and the chunk summaries
    are broadcast while they are few (BROADCAST_ROWS) and joined otherwise.
    """
    pick, of = (F.min, F.least) if least else (F.max, F.greatest)
    first = Window.unboundedPreceding
    df = df.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    hot = hot_keys(df, key, target_rows)

    def opened(part: DataFrame) -> DataFrame:
        return part.withColumn("__starts", F.coalesce(starts(F.col(prior)), F.lit(False)).cast("int"))

    def plain(part: DataFrame) -> DataFrame:
        w = Window.partitionBy(key).orderBy(at, *ties)
        part = part.withColumn(prior, pick(value).over(w.rowsBetween(first, -1)))
        if second:
            part = part.withColumn("__add", second[1](F.col(prior))).withColumn(second[0], pick("__add").over(w.rowsBetween(first, -1))).drop("__add")
        if starts:
            part = opened(part).withColumn(label, F.sum("__starts").over(w.rowsBetween(first, 0))).drop("__starts")
        return part

    if hot is None:
        return plain(df)
    part = chunked(df.join(hot.keys, key, "left_semi"), key, [at, *ties], hot.rows, target_rows)
    # one summary a chunk, and one more for each key that begins within a chunk
    few = hot.number + MOST_CHUNKS <= BROADCAST_ROWS
    near = F.broadcast if few else lambda summaries: summaries
    w = Window.partitionBy(key, "__chunk").orderBy(at, *ties, "__seq")
    along = Window.partitionBy(key).orderBy("__chunk").rowsBetween(first, -1)

    def carried(part: DataFrame, source: str, into: str) -> DataFrame:
        """Adds the running pick of ``source`` over all earlier rows of the key."""
        seen = part.groupBy(key, "__chunk").agg(pick(source).alias("__one")).select(key, "__chunk", pick("__one").over(along).alias("__before"))
        part = part.withColumn("__local", pick(source).over(w.rowsBetween(first, -1)))
        return part.join(near(seen), [key, "__chunk"], "left").withColumn(into, of("__local", "__before")).drop("__local", "__before")

    part = carried(part, value, prior)
    if second:
        part = carried(part.withColumn("__add", second[1](F.col(prior))), "__add", second[0]).drop("__add")
    if starts:
        part = opened(part)
        counted = part.groupBy(key, "__chunk").agg(F.sum("__starts").alias("__n")).select(key, "__chunk", F.sum("__n").over(along).alias("__count"))
        part = part.withColumn("__run", F.sum("__starts").over(w.rowsBetween(first, 0))).join(near(counted), [key, "__chunk"], "left")
        part = part.withColumn(label, F.col("__run") + F.coalesce("__count", F.lit(0))).drop("__starts", "__run", "__count")
    cold = plain(df.join(hot.keys, key, "left_anti"))
    return cold.unionByName(part.select(*cold.columns))


def _bin(v: Column, lo: Column, hi: Column, bins: int, no: int) -> Column:
    """The bin of lo <= v <= hi: 0 for lo, the last for hi; one bin between infinite ends.

    Bins are of equal width (halved against overflow); after three rounds, where
    a long tail has left them crowded, they also grow by equal factors from one end.
    """
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    if no > 3 and no % 3 != 0:
        x = share if no % 3 == 1 else 1 - share
        x = F.log1p(x * 1e15) / math.log1p(1e15)
        share = x if no % 3 == 1 else 1 - x
    endless = (lo == float("-inf")) | (hi == float("inf"))
    return F.when(v == lo, 0).when(v == hi, bins - 1).when(endless, bins // 2).otherwise(F.greatest(F.lit(0), F.least(F.floor(share * bins).cast("int"), F.lit(bins - 1))))


def order_statistics(df: DataFrame, key: str, value: str, wanted: DataFrame, bins: int = 256, target_rows: int = 100_000) -> DataFrame:
    """The ``rank``-th smallest ``value`` (from 0) of each key, exactly.

    ``df`` holds (key, value), ``wanted`` holds distinct (key, rank, lo, hi) where lo
    and hi are the key's least and greatest value. Returns (key, rank, result).
    Each round counts the values of every open interval in ``bins`` bins with
    mergeable counts, and goes on inside the bin that holds the rank, from its
    least to its greatest value, until these are equal. The ends of an interval
    always fall into different bins, so every round narrows it. No round
    gathers the values of a key; only counts per bin are shuffled. The open
    intervals are broadcast while they are few (BROADCAST_ROWS), so the rows stay
    where they are; more are joined, those of hot keys still by broadcast.

    Null keys and null or NaN values must have been left out of ``df``.
    """
    start = wanted.select(key, "rank", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), F.lit(0).cast("long").alias("below"))
    state = materialize(start, "ranks")
    done, used = [], [state]
    hot, counted_hot = None, False
    rows, inside = df.select(key, F.col(value).cast("double").alias("__v")), None
    for no in count(1):
        done.append(state.where("lo = hi").select(key, "rank", F.col("lo").alias("result")))
        todo = state.where("lo < hi")
        n_open = todo.limit(BROADCAST_ROWS + 1).count()
        if not n_open:
            break
        spans = todo.select(key, "lo", "hi", "below").distinct()
        if n_open <= BROADCAST_ROWS:
            near = rows.join(F.broadcast(spans), key)
        else:
            if not counted_hot:
                hot, counted_hot = hot_keys(df, key, target_rows), True
            if hot is None:
                near = rows.join(spans, key)
            else:
                # of hot keys that are few, all intervals fit a broadcast: at most one a rank
                mine = spans.join(hot.keys, key, "left_semi")
                near = rows.join(hot.keys, key, "left_anti").join(spans.join(hot.keys, key, "left_anti"), key)
                near = near.unionByName(rows.join(F.broadcast(mine) if hot.number <= LISTED else mine, key))
        near = near.where("__v >= lo and __v <= hi")
        if no > 1:
            # The open intervals of a key are disjoint and lie within those of the
            # round before: the rows inside them are all that later rounds read.
            near = materialize(near, "inside")
            release(inside)
            inside, rows = near, near.select(key, "__v")
        bins_of = near.withColumn("bin", _bin(F.col("__v"), F.col("lo"), F.col("hi"), bins, no))
        counts = bins_of.groupBy(key, "lo", "hi", "below", "bin").agg(F.count("*").alias("n"), F.min("__v").alias("b_lo"), F.max("__v").alias("b_hi"))
        # at most ``bins`` rows to each (key, interval)
        w = Window.partitionBy(key, "lo", "hi", "below").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.col("below") + F.sum("n").over(w))
        state = todo.join(counts, [key, "lo", "hi", "below"]).where("rank < upto and rank >= upto - n").select(key, "rank", F.col("b_lo").alias("lo"), F.col("b_hi").alias("hi"), (F.col("upto") - F.col("n")).alias("below"))
        state = materialize(state, "ranks")
        used.append(state)
    release(inside)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    out = materialize(out, "order-statistics")
    release(*used)
    return out


def exact_quantiles(df: DataFrame, key: str, value: str, probs: Mapping[str, float], bins: int = 256, target_rows: int = 100_000) -> DataFrame:
    """(key, n, a column for each of ``probs``): exact quantiles, linear between the two order statistics.

    No task holds a key's values, whatever their number (see order_statistics). Null
    keys are a key of their own; null and NaN values count nothing, keys without any other
    get no row.
    """
    c = F.col(value).cast("double")
    rows = df.select(F.struct(F.col(key).alias("k")).alias("__key"), F.when(~F.isnan(c), c).alias("__v")).where("__v is not null")
    rows = rows.select(F.to_json("__key").alias("__key"), F.col("__key.k").alias("__own"), "__v")
    stats = rows.groupBy("__key").agg(F.first("__own").alias("__own"), F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    return _quantiles(rows.select("__key", F.col("__v").alias("__value")), materialize(stats, "quantile-keys"), "n", probs, bins, target_rows).drop("__key", "lo", "hi").withColumnRenamed("__own", key)


def _quantiles(rows: DataFrame, stats: DataFrame, n: str, probs: Mapping[str, float], bins: int, target_rows: int) -> DataFrame:
    """``stats`` (__key, n, lo, hi and others) with a column for each of ``probs`` over the values of ``rows`` (__key, __value)."""
    ranks = F.array_distinct(F.array(*[f((F.col(n) - 1) * F.lit(float(p))).cast("long") for p in probs.values() for f in (F.floor, F.ceil)]))
    wanted = stats.where(f"{n} > 0").select("__key", F.explode(ranks).alias("rank"), "lo", "hi")
    found = order_statistics(rows, "__key", "__value", wanted, bins, target_rows)
    by_rank = found.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("rank", "result"))).alias("__at"))  # at most 2 ranks for each of probs
    out = stats.join(by_rank, "__key", "left")
    columns = []
    for name, p in probs.items():
        x = (F.col(n) - 1) * F.lit(float(p))
        low, high = F.col("__at")[F.floor(x).cast("long")], F.col("__at")[F.ceil(x).cast("long")]
        columns.append(F.when(low == high, low).otherwise(low + (high - low) * (x - F.floor(x))).alias(name))
    return out.select(*stats.columns, *columns)


def key_profile(
    df: DataFrame,
    key: str,
    record: str,
    value: str,
    probs: Sequence[float] = (0.5, 0.9),
    heavy_share: float = 0.02,
    bins: int = 256,
    target_rows: int = 100_000,
    user: Callable[[Column], Column] = lambda c: c >= 0,
) -> DataFrame:
    """Counts, mean and exact quantiles for every key, whatever share of the rows it holds.

    A record counts once for a key: of repeated rows the greatest ``value`` is
    kept. Columns of the result: key, n_records, n_values, mean_value, one
    ``q<percent>`` for each of ``probs`` (linear between the two order
    statistics), share (of all distinct records, those without a key included)
    and heavy (share >= ``heavy_share``).

    Null records are left out, keys for which ``user`` does not hold get no
    row, null and NaN values enter n_records only (mean and quantiles are null
    if a key has no other). An empty table gives an empty result. Other columns
    are not read.
    """
    c = F.col(value).cast("double")
    rows = df.where(F.col(record).isNotNull()).select(F.col(key).alias("__key"), F.col(record).alias("__record"), F.when(~F.isnan(c), c).alias("__value"))
    rows = materialize(rows.groupBy("__key", "__record").agg(F.max("__value").alias("__value")), "records")
    total = rows.agg(F.count_distinct("__record")).first()[0]
    rows = rows.where(user(F.col("__key"))).select("__key", "__value")
    stats = materialize(
        rows.groupBy("__key").agg(F.count("*").alias("n_records"), F.count("__value").alias("n_values"), F.avg("__value").alias("mean_value"), F.min("__value").alias("lo"), F.max("__value").alias("hi")),
        "profile",
    )
    names = {f"q{100 * p:g}".replace(".", "_"): p for p in probs}
    out = _quantiles(rows.where("__value is not null"), stats, "n_values", names, bins, target_rows)
    share = F.col("n_records") / F.lit(max(total, 1))
    return out.select(F.col("__key").alias(key), "n_records", "n_values", "mean_value", *names, share.alias("share"), (F.col("n_records") >= F.lit(heavy_share) * F.lit(total)).alias("heavy"))


def row_ids(df: DataFrame, order: Sequence[str], name: str = "row_no", partitions: int | None = None) -> DataFrame:
    """Adds ``name``: 1, 2, ... over all rows in ``order`` (nulls first), without a single-task window.

    Rows are laid out by range and written once, so that the ranges stay what
    they are; each range numbers its own rows after those of the ranges before.
    ``order`` should tell rows apart, else equal rows share a range.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "row-ids")
    sizes = {r[0]: r[1] for r in laid.groupBy("__part").count().collect()}  # one row a partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets += [F.lit(part), F.lit(before)]
        before += sizes[part]
    no = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    shift = F.create_map(*offsets)[F.col("__part")] if offsets else F.lit(0)
    return laid.withColumn(name, (no + shift).cast("long")).drop("__part")
