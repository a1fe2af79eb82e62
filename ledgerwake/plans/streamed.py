"""Streaming queries over events that arrive in several files and out of order; their SQL is the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.session import new_path, table
from ledgerwake.streaming import streams

#: Files that the events come in, one a trigger, and how late an event may be.
FILES, LATE_MS = 5, 12 * 3_600_000
#: An event of no user in the last file, after all others, whose watermark closes what is open.
END_MS = 4_000_000_000_000


def _arriving(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a stream of FILES files: each comes up to LATE_MS after its time, so files overlap in time."""
    path = new_path(spark, "arriving")
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    arrival = F.col("ms") + F.pmod(F.xxhash64("event_id"), F.lit(LATE_MS))
    rows = rows.withColumn("arrival", arrival)
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    width = ((high or 0) - (low or 0)) // FILES + 1
    for k in range(FILES):  # one after another, so that they are read in this order
        own = rows.where((F.col("arrival") >= (low or 0) + k * width) & (F.col("arrival") < (low or 0) + (k + 1) * width)).drop("arrival")
        own.coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(-1, -1, "end", END_MS)], "event_id long, user_id long, event_type string, ms long").withColumn("ts", F.timestamp_millis("ms").cast("timestamp_ntz")).select(*rows.drop("arrival").columns).coalesce(1).write.mode("append").parquet(path)
    stream = streams.stream_parquet(spark, path, 1).withColumn("event_time", F.col("ts").cast("timestamp"))
    return stream.withWatermark("event_time", f"{LATE_MS} milliseconds")


def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.closed(streams.window_counts(_arriving(spark, sf), ["event_type"], "1 hour"), "append")
    return out.select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.closed(streams.window_counts(_arriving(spark, sf), ["event_type"], "1 day", "12 hours"), "append")
    return out.select(F.unix_millis("start").alias("start_ms"), "event_type", "n")


def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    out = streams.closed(streams.sessions(_arriving(spark, sf), ["user_id"], "30 minutes"), "append")
    return out.select("user_id", F.unix_millis("start").alias("start_ms"), F.unix_millis("last").alias("last_ms"), "n")


def stream_distinct(spark: SparkSession, sf: str) -> DataFrame:
    rows = streams.stream_parquet(spark, f"{sf}/events.parquet", 100).select("event_id", "user_id", "event_type")  # without event_time no row is late
    return streams.closed(rows.dropDuplicates(), "append")


def stream_running_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's number in its session of six hours, in the order of event time."""
    rows = _arriving(spark, sf).select("event_id", "user_id", "ms", "event_time")
    return streams.closed(streams.session_positions(rows, "user_id", "ms", "event_id", 6 * 3_600_000), "append").where("user_id >= 0")


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_distinct, stream_running_counts)}

SQL = {
    "stream_tumbling": "SELECT epoch_ms(ts) // 3600000 * 3600000 AS start_ms, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_sliding": """SELECT (epoch_ms(ts) // 43200000 - k) * 43200000 AS start_ms, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL""",
    "stream_sessions": """WITH f AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM f)
      SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, epoch_us(max(ts)) // 1000 AS last_ms, count(*) AS n FROM s GROUP BY user_id, k""",
    "stream_distinct": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_running_counts": """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms FROM events),
      f AS (SELECT *, coalesce(ms - lag(ms) OVER w >= 21600000, true) AS opens FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)),
      s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
      SELECT user_id, ms, event_id, row_number() OVER (PARTITION BY user_id, k ORDER BY ms, event_id) - 1 AS n_before FROM s""",
}
