"""Attributes as they stood, and were known, at the time of an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.operators.skew import running_labels


def attributes_at(
    events: DataFrame,
    history: DataFrame,
    entity: str,
    at: str,
    valid_from: str,
    known_from: str,
    ordinal: str,
    attributes: Sequence[str],
    keep_unmatched: bool = False,
    target_rows: int = 100_000,
) -> DataFrame:
    """Join each event with the attributes valid and known at its time.

    Of the records of ``history`` with the event's ``entity`` whose
    ``valid_from`` and ``known_from`` are both <= ``at``, the one of greatest
    ``valid_from``, then greatest ``ordinal`` counts. Returns the columns of
    ``events`` and then valid_from, ordinal and ``attributes`` of that record,
    prefixed with ``then_`` so that they cannot clash with the events' own.

    A record becomes visible at the later of its two times. Over narrow rows
    (entity, time, rank) a record starts a new version when it ranks above all
    visible before it; the running count of versions numbers each asked (entity,
    time), the wide attributes are joined to the numbers by entity and
    number, and the events, which move only once, take them by entity and time. Entities of more
    than ``target_rows`` rows are split (see running_labels); events of an entity with few
    versions or times are split by AQE's skew join.

    Events with null entity or time, and events before the first visible
    record, have no version: they are left out, or kept with nulls if
    ``keep_unmatched``. Records with a null entity, time or ordinal never count.
    A record known at the event's very time counts. Repeated records count once;
    of records alike in entity, both times and ordinal, the one of greatest
    attributes. Repeated events stay repeated. Empty tables are allowed.
    """
    known = [F.col(c).isNotNull() for c in (entity, valid_from, known_from, ordinal)]
    records = history.where(known[0] & known[1] & known[2] & known[3]).select(
        F.col(entity).alias("__entity"),
        F.greatest(valid_from, known_from).alias("__at"),
        F.struct(F.col(valid_from).alias("v"), F.col(ordinal).alias("o")).alias("__rank"),
        *([F.struct(*[F.col(c) for c in attributes]).alias("__wide")] if attributes else []),
    )
    on = [events[entity].alias("__entity"), events[at].alias("__at")]
    asked = events.select(*on).where("__entity is not null and __at is not null").distinct()
    narrow = records.select("__entity", "__at", "__rank", F.lit(0).alias("__kind"))
    none = F.lit(None)
    narrow = narrow.unionByName(asked.select("__entity", "__at", none.cast(narrow.schema["__rank"].dataType).alias("__rank"), F.lit(1).alias("__kind")))
    newer = lambda prior: F.col("__rank").isNotNull() & (prior.isNull() | (F.col("__rank") > prior))
    # Records that become visible together are ordered by rank and so numbered alike in every run.
    runs = running_labels(narrow, "__entity", "__at", "__rank", newer, ["__kind", "__rank"], target_rows, "__prior", "__version")
    versions = runs.where((F.col("__kind") == 0) & newer(F.col("__prior"))).select("__entity", "__version", "__at", "__rank")
    if attributes:
        chosen = records.groupBy("__entity", "__at", "__rank").agg(F.max("__wide").alias("__wide"))
        versions = versions.join(chosen, ["__entity", "__at", "__rank"])
    numbered = runs.where("__kind = 1").select("__entity", "__at", "__version")
    then = [F.col("__rank.v").alias(f"then_{valid_from}"), F.col("__rank.o").alias(f"then_{ordinal}"), *[F.col(f"__wide.{c}").alias(f"then_{c}") for c in attributes]]
    found = numbered.join(versions.drop("__at"), ["__entity", "__version"]).select("__entity", "__at", F.struct(*then).alias("__then"))
    out = events.withColumns({"__entity": F.col(entity), "__at": F.col(at)}).join(found, ["__entity", "__at"], "left" if keep_unmatched else "inner")
    return out.select(*[F.col(c) for c in events.columns], *[F.col("__then")[f.name].alias(f.name) for f in found.schema["__then"].dataType.fields])
