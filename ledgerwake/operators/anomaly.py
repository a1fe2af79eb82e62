"""Counts on a time grid against the same slots of other days."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days at which a slot has its references, in the usual setting (fixed values).
WEEKS = (-28, -21, -14, -7, 7, 14, 21, 28)


@dataclass(frozen=True)
class Baseline:
    """How a slot is judged; the defaults are those of a grid of minutes."""

    offsets: Sequence[int] = tuple(1440 * d for d in WEEKS)
    traffic: tuple[int, int] = (60, 10)  # sums of traffic over the slots from t - 60 to before t - 10
    least_traffic: float = 100.0
    ratio: tuple[float, float] = (0.25, 4.0)
    least_references: int = 4


def observed_grid(counts: DataFrame, covered: DataFrame, by: str, slot: str) -> DataFrame:
    """(by, slot, n): 0 where a covered slot has no count; slots that are not covered are missing.

    ``counts`` holds (by, slot, n), ``covered`` the slots that were observed. Counts of uncovered slots are dropped.
    """
    slots = covered.select(slot).where(F.col(slot).isNotNull()).distinct()
    ends = slots.agg(F.min(slot).alias("lo"), F.max(slot).alias("hi"))
    names = counts.select(by).distinct()
    grid = names.crossJoin(F.broadcast(ends)).select(by, F.explode(F.sequence("lo", "hi")).alias(slot))  # one row of ends
    return grid.join(slots, slot, "left_semi").join(counts.select(by, slot, "n"), [by, slot], "left").select(by, slot, F.coalesce("n", F.lit(0)).alias("n"))


def traffic_before(traffic: DataFrame, slot: str, start: int, stop: int) -> DataFrame:
    """(slot, traffic): the sum over slots from slot - start to before slot - stop, where all of them were observed."""
    ahead = traffic.where(F.col("n").isNotNull()).select((F.explode(F.sequence(F.col(slot) + stop + 1, F.col(slot) + start))).alias(slot), "n")
    return ahead.groupBy(slot).agg(F.sum("n").alias("traffic"), F.count("*").alias("k")).where(F.col("k") == start - stop).select(slot, "traffic")


def seasonal_scores(grid: DataFrame, by: str, slot: str, law: Baseline, traffic: DataFrame | None = None) -> DataFrame:
    """(by, slot, n, refs, expected, mad, score, ratio, excess): every slot against the slots ``law.offsets`` away.

    References are scaled by the ratio of the traffic before both slots, and dropped where either is below
    ``least_traffic`` or the ratio outside ``law.ratio``. expected is their median, mad their median absolute deviation;
    the score divides the excess by the greater of sqrt(expected + 1) and 1.4826 mad, ratio by expected, 5 at least.
    score and ratio are null with fewer than ``least_references``. These are no p-values.

    ``grid`` is that of observed_grid: missing slots neither give nor get a reference. A slot has one row for each offset at most, so
    joins are on (by, slot) and grow linearly.
    """
    rows = grid
    if traffic is not None:
        rows = rows.join(traffic_before(traffic, slot, *law.traffic), slot, "left")
    else:
        rows = rows.withColumn("traffic", F.lit(None).cast("double"))
    away = rows.select(by, F.col("n").alias("__n"), F.col("traffic").alias("__t"), slot, F.explode(F.array(*[F.lit(o) for o in law.offsets])).alias("__o"))
    away = away.select(by, (F.col(slot) - F.col("__o")).alias(slot), "__n", "__t")
    near = rows.join(away, [by, slot], "left")
    value = F.col("__n").cast("double")
    if traffic is not None:
        scale = F.col("traffic") / F.col("__t")
        good = (F.col("__t") >= law.least_traffic) & (F.col("traffic") >= law.least_traffic) & (scale >= law.ratio[0]) & (scale <= law.ratio[1])
        value = F.when(good, F.col("__n") * scale)
    refs = near.groupBy(by, slot, "n").agg(F.sort_array(F.collect_list(value)).alias("r"))  # at most one a offset

    def middle(c: str) -> F.Column:
        half = F.size(c)
        return F.when(half > 0, (F.get(c, F.floor((half - 1) / 2).cast("int")) + F.get(c, F.floor(half / 2).cast("int"))) / 2)

    out = refs.withColumn("expected", middle("r")).withColumn("d", F.sort_array(F.transform("r", lambda x: F.abs(x - F.col("expected"))))).withColumn("mad", middle("d"))
    enough = F.size("r") >= law.least_references
    spread = F.greatest(F.sqrt(F.greatest("expected", F.lit(0.0)) + 1), 1.4826 * F.col("mad"))
    return out.select(by, slot, "n", F.size("r").alias("refs"), "expected", "mad", F.when(enough, (F.col("n") - F.col("expected")) / spread).alias("score"), F.when(enough, F.col("n") / F.greatest("expected", F.lit(5.0))).alias("ratio"), (F.col("n") - F.col("expected")).alias("excess"))
