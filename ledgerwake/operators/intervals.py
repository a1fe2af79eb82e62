"""Overlapping and gapped intervals of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.operators.skew import running_labels


def periods(df: DataFrame, entity: str, start: str, end: str, target_rows: int = 100_000) -> DataFrame:
    """Join the closed intervals of each entity into continuous periods.

    Intervals that overlap, nest or share an end point fall into one period.
    Returns (entity, period_no, from_at, to_at, n_starts, previous_to); the
    stretch from previous_to to from_at is the gap before the period, null for
    an entity's first period. n_starts counts the distinct starts.

    Rows with a null entity or end point, or with end < start, are left out; an
    interval of length zero is an interval; repeated rows change nothing; an
    empty table gives no periods. Only the three columns are read.

    Starts are sorted per entity, each compared with the running maximum of the
    earlier ends, and the islands numbered cumulatively; entities of more than
    ``target_rows`` distinct starts are split (see running_labels).
    """
    spans = (
        df.select(F.col(entity).alias("__entity"), F.col(start).alias("__start"), F.col(end).alias("__end"))
        .where("__entity is not null and __start is not null and __end >= __start")
        .groupBy("__entity", "__start")
        .agg(F.max("__end").alias("__end"))
    )
    opens = lambda prior: prior.isNull() | (F.col("__start") > prior)
    runs = running_labels(spans, "__entity", "__start", "__end", opens, target_rows=target_rows, prior="__prior", label="period_no")
    out = runs.groupBy("__entity", "period_no").agg(
        F.min("__start").alias("from_at"),
        F.max("__end").alias("to_at"),
        F.count("*").alias("n_starts"),
        F.min_by("__prior", "__start").alias("previous_to"),
    )
    return out.withColumnRenamed("__entity", entity)


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, max_gap: int | None = None, target_rows: int = 100_000) -> DataFrame:
    """(entity, kind, from_ms, to_ms) with kind ``period`` or ``gap``; see periods.

    Gaps longer than ``max_gap`` are left out where it is given.
    """
    found = periods(df, entity, start, end, target_rows)
    near = F.col("previous_to").isNotNull()
    if max_gap is not None:
        near &= F.col("from_at") - F.col("previous_to") <= max_gap
    cases = F.array(
        F.struct(F.lit("period").alias("kind"), F.col("from_at").alias("from_ms"), F.col("to_at").alias("to_ms")),
        F.when(near, F.struct(F.lit("gap").alias("kind"), F.col("previous_to").alias("from_ms"), F.col("from_at").alias("to_ms"))),
    )
    return found.select(entity, F.explode(cases).alias("x")).where("x is not null").select(entity, "x.*")
