"""Structured Streaming forms of the incremental operators; closed input gives the batch results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerwake.session import new_path


def stream_parquet(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    reader = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files_per_trigger)
    if path.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(folder)
    return reader.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def timed(df: DataFrame, ms: str, delay: str) -> DataFrame:
    """Adds event_time from epoch milliseconds, with a watermark."""
    return df.withColumn("event_time", F.timestamp_millis(F.col(ms))).withWatermark("event_time", delay)


def window_counts(df: DataFrame, by: Sequence[str], size: str, slide: str | None = None) -> DataFrame:
    """Counts per group in tumbling or sliding windows of event_time."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    return df.groupBy(w, *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def sessions(df: DataFrame, by: Sequence[str], gap: str) -> DataFrame:
    """(by, start, last, n) of sessions that ``gap`` without events ends."""
    s = df.groupBy(F.session_window("event_time", gap), *by).agg(F.count("*").alias("n"), F.max("event_time").alias("last"))
    return s.select(*by, F.col("session_window.start").alias("start"), "last", "n")


def without_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once within the watermark."""
    return df.dropDuplicatesWithinWatermark(list(keys))


def session_positions(df: DataFrame, by: str, at: str, no: str, gap_ms: int) -> DataFrame:
    """(by, at, no, n_before): of each event the number of the entity's earlier events in its session.

    A session ends where an entity is idle for ``gap_ms`` or more. Events count
    in the order of (``at``, ``no``), whatever the order of their arrival: they
    wait in the state until the watermark of ``event_time`` has passed them, and come out then.
    The state of an entity that has been idle for the gap is dropped. ``at`` (milliseconds) and
    ``no`` are longs. Events that come later than the watermark are dropped by it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last, waiting = state.get if state.exists else (0, None, [])
        todo = [tuple(map(int, x.split("|"))) for x in waiting]
        for b in batches:
            todo += zip(b[at].tolist(), b[no].tolist(), strict=True)
        now = state.getCurrentWatermarkMs()
        ready, todo = sorted(x for x in todo if x[0] <= now), sorted(x for x in todo if x[0] > now)
        out = []
        for t, i in ready:
            n = 0 if last is None or t - last >= gap_ms else n
            out.append((key[0], t, i, n))
            n, last = n + 1, t
        if not todo and (last is None or now - last >= gap_ms):
            if state.exists:
                state.remove()
        else:
            state.update((n, last, [f"{t}|{i}" for t, i in todo]))
            state.setTimeoutTimestamp(max(now + 1, todo[0][0] if todo else last + gap_ms))
        yield pd.DataFrame(out, columns=[by, at, no, "n_before"])

    kind = df.schema[by].dataType.simpleString()
    return df.groupBy(by).applyInPandasWithState(step, f"{by} {kind}, {at} long, {no} long, n_before long", "n long, last long, waiting array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def closed(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there now; its result as a table in the shared folder.

    In mode ``complete`` each batch replaces the one before, in ``append`` all batches count.
    """
    spark = df.sparkSession
    root = new_path(spark, "stream")
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{number}")
        last.append(number)

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}-state").trigger(availableNow=True).foreachBatch(write)
    writer.start().awaitTermination()
    if not last:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*[f"{root}/{n}" for n in (last[-1:] if mode == "complete" else last)])
