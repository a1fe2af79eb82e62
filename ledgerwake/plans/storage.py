"""Sources, sinks and contracts: what is written is read back and returned."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.operators import contracts
from ledgerwake.session import new_path, table
from ledgerwake.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf):
    path = new_path(spark, "csv")
    tables.write_csv(table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path)
    return tables.read_csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("SELECT gid, chooser, t, fair, cohort, count(*) AS n FROM decisions GROUP BY ALL")
def ndjson_round_trip(spark, sf):
    path = new_path(spark, "ndjson")
    tables.write_json(table(spark, sf, "decisions").select("gid", "chooser", "t", "fair", "cohort"), path)
    rows = tables.read_ndjson(spark, path, "gid string, chooser long, t long, fair boolean, cohort string")
    return rows.where("_corrupt is null").groupBy("gid", "chooser", "t", "fair", "cohort").agg(F.count("*").alias("n"))


@query("SELECT month, api_speed, count(*) AS n, CAST(sum(ply_count) AS BIGINT) AS plies FROM analysis_panel WHERE month >= '2024-01' AND month IS NOT NULL GROUP BY 1, 2")
def partitioned_round_trip(spark, sf):
    """Folders by month; only those asked for are listed and read."""
    path = new_path(spark, "months")
    tables.write_parquet(table(spark, sf, "analysis_panel").where("month is not null").select("month", "api_speed", "ply_count"), path, ["month"], rows_per_file=1_000_000)
    rows = tables.read_parquet(spark, path, base=path, schema="api_speed string, ply_count long, month string").where("month >= '2024-01'")
    return rows.groupBy("month", "api_speed").agg(F.count("*").alias("n"), F.sum("ply_count").alias("plies"))


@query("SELECT row_id, rev, n_all_time, NULL::TIMESTAMP AS anchor_at FROM scores_main UNION ALL SELECT row_id, rev, NULL, anchor_at FROM scores_copy")
def merged_schemas(spark, sf):
    """Files of different columns in one scan."""
    path = new_path(spark, "schemas")
    tables.write_parquet(table(spark, sf, "scores_main").select("row_id", "rev", "n_all_time"), f"{path}/a")
    tables.write_parquet(table(spark, sf, "scores_copy").select("row_id", "rev", "anchor_at"), f"{path}/b")
    return tables.read_parquet(spark, f"{path}/a", f"{path}/b", merge=True, columns=["row_id", "rev", "n_all_time", "anchor_at"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1500")
def pruned_scan(spark, sf):
    """Row groups sorted by key: the pushed filter skips all others."""
    path = new_path(spark, "sorted")
    table(spark, sf, "orders").repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.option("parquet.block.size", 1 << 16).parquet(path)
    return tables.read_parquet(spark, path, columns=["o_orderkey", "o_totalprice"]).where("o_orderkey between 1000 and 1500")


@query("SELECT CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, count(*) FILTER (WHERE o_orderkey IS NULL)::BIGINT AS nulls FROM orders")
def footer_stats(spark, sf):
    """Rows and bounds without reading a row."""
    f = tables.footers(spark, f"{sf}/orders.parquet").where("column = 'o_orderkey'")
    return f.agg(F.sum("rows").alias("n"), F.min(F.col("low").cast("long")).alias("low"), F.max(F.col("high").cast("long")).alias("high"), F.sum("nulls").alias("nulls"))


@query("SELECT * FROM (VALUES (1, 'a', 0.5::DOUBLE), (2, 'b', NULL), (3, NULL, 1.5)) v(k, name, w)")
def memory_table(spark, sf):
    return tables.from_memory(spark, pa.table({"k": pa.array([1, 2, 3], pa.int32()), "name": ["a", "b", None], "w": [0.5, None, 1.5]}))


@query("SELECT p_partkey, p_size * 2 + 1 AS score FROM part")
def helper_scores(spark, sf):
    """Rows scored batch by batch by a helper that is set up once a task."""

    def start():
        factor, shift = 2, 1
        return lambda b: pd.DataFrame({"p_partkey": b["p_partkey"], "score": b["p_size"] * factor + shift})

    return tables.scored_by_process(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey long, score int", start)


@query("SELECT row_id, rev, speed, NULL::BIGINT AS n_all_time FROM scores_copy UNION ALL SELECT row_id, rev, NULL, n_all_time FROM scores_main")
def typed_append(spark, sf):
    """Files appended one after another: columns by name, absent ones null."""
    path = new_path(spark, "append")
    tables.write_parquet(table(spark, sf, "scores_copy").select("row_id", "rev", "speed"), f"{path}/a")
    tables.write_parquet(table(spark, sf, "scores_main").select("n_all_time", "row_id", "rev"), f"{path}/b")
    tables.append([f"{path}/a", f"{path}/b"], spark, f"{path}/all")
    return spark.read.parquet(f"{path}/all").select("row_id", "rev", "speed", "n_all_time")


@query("SELECT c_custkey, c_mktsegment, 1 AS files FROM customer")
def compacted(spark, sf):
    """Sixteen shards rewritten as one file, published by a rename."""
    path = new_path(spark, "shards")
    table(spark, sf, "customer").select("c_custkey", "c_mktsegment").repartition(16).write.parquet(f"{path}/many")
    tables.compact(spark, f"{path}/many", f"{path}/few")
    return spark.read.parquet(f"{path}/few").withColumn("files", F.lit(len(tables.data_files(spark, f"{path}/few"))))


@query("SELECT 'npz' AS kind, count(*) AS n FROM part UNION ALL SELECT 'zip', count(*) FROM part")
def archived(spark, sf):
    path, part = new_path(spark, "archives"), table(spark, sf, "part").select("p_partkey", "p_name", "p_size").repartition(3)
    counts = [tables.write_archives(part, f"{path}/{k}", k).agg(F.lit(k).alias("kind"), F.sum("rows").alias("n")) for k in ("npz", "zip")]
    return counts[0].unionByName(counts[1])


@query("SELECT n_nationkey, n_name, 'refused' AS again FROM nation")
def published(spark, sf):
    """All or nothing: a second publication to the same place is refused."""
    path, nation = new_path(spark, "published"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    tables.publish(nation, path)
    try:
        tables.publish(nation.limit(1), path)
        again = "replaced"
    except FileExistsError:
        again = "refused"
    return spark.read.parquet(path).withColumn("again", F.lit(again))


@query("SELECT c_nationkey, count(*) AS n, 1 AS made FROM customer GROUP BY 1")
def staged(spark, sf):
    """A stage that is asked for twice is made once, as long as its inputs, settings and code stay."""
    stages, made = tables.Stages(spark, new_path(spark, "stages")), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))

    for _ in range(2):
        out = stages.run("by-nation", make, [f"{sf}/customer.parquet"], {"version": 1})
    return out.withColumn("made", F.lit(len(made)))


@query("SELECT month, count(*) AS n FROM analysis_panel GROUP BY month")
def conserved_write(spark, sf):
    """A write that is compared row by row with what was to be written."""
    rows = table(spark, sf, "analysis_panel").select("game_id", "chooser_user_id", "utc_ms", "month")
    back = contracts.conserved(rows, new_path(spark, "conserved"), lambda df, path: tables.write_parquet(df, path, ["month"]))
    return back.groupBy("month").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS key, s_name AS name, n_name AS place FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def record_file(spark, sf):
    """Records of several lines in a text file, split by the reader."""
    path = new_path(spark, "records")
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))  # 25 nations
    s.select(F.format_string('[Key "%d"]\n[Name "%s"]\n[Site "%s"]\n\n1. e4 e5\n', "s_suppkey", "s_name", "n_name").alias("value")).repartition(3).write.text(path)
    read = tables.read_records(spark, path, "\n[Key ", {"key": r'^\[Key "([^"]*)"\]', "name": r'\[Name "([^"]*)"\]', "place": r'\[Site "([^"]*)"\]'})
    return read.select("key", "name", "place")


@query("SELECT o_orderkey, o_custkey, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def validated_merge(spark, sf):
    """A join whose cardinality is checked first."""
    orders, customers = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf, "customer")
    return contracts.checked_join(orders, customers, ["c_custkey"], "inner", "many_to_one").select("o_orderkey", F.col("c_custkey").alias("o_custkey"), "c_mktsegment")


@query("SELECT column_name AS name, lower(column_type) AS kind FROM (DESCRIBE exposures)")
def schema_probe(spark, sf):
    """Names and types without reading a row."""
    kinds = {"string": "varchar"}
    fields = table(spark, sf, "exposures").schema.fields
    return spark.createDataFrame([(f.name, kinds.get(f.dataType.simpleString(), f.dataType.simpleString())) for f in fields], "name string, kind string")


@query("SELECT gid, chooser, start_ms, t FROM decisions WHERE NOT coalesce(t >= start_ms AND chooser >= 0, false)")
def rule_violations(spark, sf):
    """Rows that break a rule; ensure_empty raises on them."""
    bad = contracts.violations(table(spark, sf, "decisions"), F.expr("t >= start_ms and chooser >= 0"))
    contracts.ensure_empty(bad.where("t >= start_ms and chooser >= 0"), "rows that keep the rule are no violations")
    return bad.select("gid", "chooser", "start_ms", "t")
