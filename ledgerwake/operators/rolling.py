"""Totals over trailing days, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def day_number(ms: Column | str) -> Column:
    """Days since 1970-01-01 (UTC) of epoch milliseconds; negative times round down."""
    c = F.col(ms) if isinstance(ms, str) else ms
    return F.floor(c / F.lit(DAY_MS)).cast("int")


def daily_totals(activity: DataFrame, entity: str, record: str, day: str, windows: Sequence[int], record_days_vary: bool = True) -> DataFrame:
    """Sparse (__entity, __day, n, f0, f1, ...): distinct records of the day, and steps of what windows count twice.

    A record seen on the days ``before`` and ``day`` counts twice in a window of W
    days that ends before q, for day < q <= before + W: the step of W is +1 at
    day + 1 and -1 at before + W + 1. All of it comes from one aggregation by entity
    and record (a record's distinct days are few or as many as the calendar
    has), summed by day with map-side combine.
    """
    rows = activity.select(F.col(entity).alias("__entity"), F.col(record).alias("__record"), F.col(day).alias("__day")).where("__entity is not null and __record is not null and __day is not null")
    fixes = [f"f{i}" for i in range(len(windows))]

    def item(at: Column, n: int, *f: Column) -> Column:
        return F.struct(at.cast("int").alias("__day"), F.lit(n).alias("n"), *[x.cast("int").alias(name) for x, name in zip(f, fixes, strict=True)])

    if record_days_vary:
        days = rows.groupBy("__entity", "__record").agg(F.sort_array(F.collect_set("__day")).alias("d"))
        near = lambda a, b, w: F.when(b - a < w, 1).otherwise(0)

        def steps(a: Column, b: Column) -> Column:
            ends = [item(a + w + 1, 0, *[-near(a, b, w) if j == i else F.lit(0) for j in range(len(windows))]) for i, w in enumerate(windows)]
            return F.array(item(b + 1, 0, *[near(a, b, w) for w in windows]), *ends)

        pairs = F.flatten(F.zip_with(F.slice("d", 1, F.size("d") - 1), F.slice("d", 2, F.size("d") - 1), steps))
        all_items = F.concat(F.transform("d", lambda x: item(x, 1, *[F.lit(0)] * len(windows))), F.filter(pairs, lambda x: sum((F.abs(x[f]) for f in fixes), F.lit(0)) > 0))
        flat = days.select("__entity", F.inline(all_items))
    else:
        flat = rows.groupBy("__entity", "__record").agg(F.min("__day").alias("__day")).select("__entity", "__day", F.lit(1).alias("n"), *[F.lit(0).alias(f) for f in fixes])
    return flat.groupBy("__entity", "__day").agg(*[F.sum(c).alias(c) for c in ("n", *fixes)])


def trailing_totals(
    activity: DataFrame,
    calendar: DataFrame | None,
    entity: str,
    record: str,
    day: str,
    windows: Sequence[int] = (7, 30),
    record_days_vary: bool = True,
    tail: int = 30,
) -> DataFrame:
    """For each (entity, day) of ``calendar``, distinct records of the trailing days.

    For each W of ``windows`` the result has ``n_<W>d``, the number of distinct
    records of the entity on days day-W to day-1 (the day itself is not part),
    and ``mean_<W>d``, that number divided by W whatever days had activity.

    ``calendar`` rows stand for days with and without activity alike; repeated
    and null ones are dropped, and entities without activity get zeros. Without a
    ``calendar`` the result has all days from an entity's first to its last
    + ``tail``; these are made where the entity's sparse totals lie, so only
    sparse rows are shuffled. Activity rows with a null entity, record or day
    are left out. Sparse daily totals and calendar rows of total 0 are summed
    by range frames over the day number, so a task gets at most one row per
    calendar day of an entity and its sparse ones. A record seen on several days
    counts once in a window that holds several of them; ``record_days_vary=False``
    says that no record has more than one day and saves that step.
    """
    totals = daily_totals(activity, entity, record, day, windows, record_days_vary)
    fixes = [f"f{i}" for i in range(len(windows))]
    frame = Window.partitionBy("__entity").orderBy("__day")
    until_now = frame.rangeBetween(Window.unboundedPreceding, 0)
    if calendar is None:
        # A day's n enters every window at the next day and leaves that of W days at day + W + 1: sums of such
        # steps cost the same for every dense row, however long the window.
        zero = F.lit(0).cast("long")

        def steps(x: Column) -> Column:
            leave = [F.struct((x["__day"] + w + 1).alias("__day"), *[(-x["n"] if g == f else zero).alias(g) for g in fixes], F.lit(0).alias("__asked")) for w, f in zip(windows, fixes, strict=True)]
            return F.array(F.struct((x["__day"] + 1).alias("__day"), *[x["n"].alias(f) for f in fixes], F.lit(0).alias("__asked")), F.struct(x["__day"].alias("__day"), *[(-x[f]).alias(f) for f in fixes], F.lit(0).alias("__asked")), *leave)

        active = F.when(F.col("n") > 0, F.col("__day"))
        lists = totals.groupBy("__entity").agg(F.collect_list(F.struct("__day", "n", *fixes)).alias("own"), F.min(active).alias("lo"), F.max(active).alias("hi"))  # at most one a calendar day, and the steps
        moved = F.filter(F.flatten(F.transform("own", steps)), lambda x: sum((F.abs(x[f]) for f in fixes), zero) > 0)
        dense = F.transform(F.sequence("lo", F.col("hi") + tail), lambda x: F.struct(x.alias("__day"), *[zero.alias(f) for f in fixes], F.lit(1).alias("__asked")))
        rows = lists.select("__entity", F.inline(F.concat(moved, dense)))
        counts = [(w, F.sum(f).over(until_now)) for w, f in zip(windows, fixes, strict=True)]
    else:
        asked = calendar.select(F.col(entity).alias("__entity"), F.col(day).alias("__day")).where("__entity is not null and __day is not null")
        none = [F.lit(0).cast("long").alias(c) for c in ("n", *fixes)]
        rows = totals.select("*", F.lit(0).alias("__asked")).unionByName(asked.select("__entity", "__day", *none, F.lit(1).alias("__asked")))
        rows = rows.groupBy("__entity", "__day").agg(*[F.sum(c).alias(c) for c in ("n", *fixes)], F.max("__asked").alias("__asked"))
        counts = []
        for w, f in zip(windows, fixes, strict=True):
            n = F.coalesce(F.sum("n").over(frame.rangeBetween(-w, -1)), F.lit(0))
            counts.append((w, n - F.sum(f).over(until_now) if record_days_vary else n))
    rows = rows.select("__entity", "__day", "__asked", *[n.alias(f"n_{w}d") for w, n in counts]).where("__asked = 1")
    out = [F.col("__entity").alias(entity), F.col("__day").alias(day)]
    for w in windows:
        out += [F.col(f"n_{w}d"), (F.col(f"n_{w}d") / F.lit(float(w))).alias(f"mean_{w}d")]
    return rows.select(*out)


def every_day(activity: DataFrame, entity: str, day: str, tail: int = 30) -> DataFrame:
    """Calendar (entity, day): all days from an entity's first to its last + ``tail``."""
    ends = activity.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(entity).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    return ends.select(entity, F.explode(F.sequence("__lo", F.col("__hi") + tail)).alias(day))
