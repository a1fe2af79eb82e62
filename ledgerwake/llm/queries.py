"""Queries p2, p4, p8, p9 and p10 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.llm.bpe import encode_texts
from ledgerwake.llm.langid import document_languages, sample, segment_languages, train
from ledgerwake.llm.leakage import leaks, without_leaks
from ledgerwake.llm.sampling import frozen_sample, sampled_rows
from ledgerwake.llm.splits import grouped_splits, linked
from ledgerwake.session import materialize, table

RATE = 0.2
SPLITS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))


def _choosers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "decisions").where("chooser >= 0")


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    return frozen_sample(_choosers(spark, sf), "chooser", "load_no", RATE)


def p2_rows(spark: SparkSession, sf: str) -> DataFrame:
    return sampled_rows(_choosers(spark, sf).select("gid", "chooser", "start_ms", "t", "ord", "load_no"), "chooser", "load_no", RATE)


_NO_COHORT = ("", "unknown", "n/a")


def _cohort() -> F.Column:
    name = F.lower(F.trim("cohort"))
    return F.when(~name.isin(*_NO_COHORT), name)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = linked(_choosers(spark, sf).select("chooser", _cohort().alias("cohort")), "chooser", "cohort")
    return groups.where("chooser != group").select(F.col("group").alias("chooser_a"), F.col("chooser").alias("chooser_b"))


def p4_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of decisions with its split.

    A row without chooser goes with its cohort, one without either by its gid.
    """
    rows = table(spark, sf, "decisions").select("gid", F.when(F.col("chooser") >= 0, F.col("chooser")).alias("chooser"), "start_ms", "t", "ord", "y", "fair", _cohort().alias("cohort"))
    node = F.coalesce(F.concat(F.lit("u"), F.col("chooser").cast("string")), F.concat(F.lit("c"), F.col("cohort")), F.concat(F.lit("g"), F.col("gid")), F.lit("none"))
    rows = rows.withColumn("node", node)
    groups = linked(rows, "node", "cohort")
    rows = rows.join(groups, "node")  # one row a node; a chooser's many rows are split by AQE's skew join
    split = grouped_splits(rows, "group", [F.col("y"), F.col("fair")], SPLITS)
    return rows.join(split, "group").select("gid", "chooser", "start_ms", "t", "ord", "y", "fair", "cohort", "split")


def p4_balance(spark: SparkSession, sf: str) -> DataFrame:
    """Of each split its rows, their share, and how far the rates of its labels are off those of all rows."""
    rows = materialize(p4_splits(spark, sf).select("y", "fair", "split"), "split-rows")
    by = rows.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.coalesce("y", F.lit(False)).cast("double")).alias("y"), F.avg(F.coalesce("fair", F.lit(False)).cast("double")).alias("fair"))
    whole = by.agg(F.sum("n").alias("total"), (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("all_y"), (F.sum(F.col("fair") * F.col("n")) / F.sum("n")).alias("all_fair"))
    joined = by.crossJoin(F.broadcast(whole))  # one row of totals, three of splits
    return joined.select("split", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round(F.col("y") - F.col("all_y"), 6).alias("y_off"), F.round(F.col("fair") - F.col("all_fair"), 6).alias("fair_off"))


def p4_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the splits, choosers and cohorts that lie in several splits, and whether every share holds.

    As groups stay whole, a share holds if it is off by no more than a hundredth of the rows
    or, on small tables, the rows of the largest chooser.
    """
    rows = materialize(p4_splits(spark, sf).select("chooser", "cohort", "split"), "split-rows")
    torn = [rows.where(F.col(c).isNotNull()).groupBy(c).agg((F.min("split") != F.max("split")).alias("torn")).agg(F.count_if("torn").alias(f"torn_{c}s")) for c in ("chooser", "cohort")]
    largest = rows.where("chooser is not null").groupBy("chooser").count().agg(F.max("count")).first()[0] or 0
    counts = rows.groupBy("split").count()
    total = counts.agg(F.sum("count")).first()[0] or 0
    wanted = spark.createDataFrame(list(SPLITS), "split string, wanted double")
    off = F.abs(F.col("count") - F.col("wanted") * total)
    near = counts.join(F.broadcast(wanted), "split").agg(F.sum("count").alias("n"), F.count("*").alias("splits"), F.bool_and(off <= max(0.01 * total, largest)).alias("shares_hold"))
    return near.crossJoin(torn[0]).crossJoin(torn[1])  # one row each


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(table(spark, sf, "documents"), "doc_id", "text")


def p8_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Of each document whether it has no ids, which holds for null and empty texts only."""
    return p8_ids(spark, sf).select("doc_id", (F.size("ids") == 0).alias("empty"))


def _texts(spark: SparkSession, sf: str) -> tuple:
    return table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "text"


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(*_texts(spark, sf))


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every test item with the number of documents that it leaked into."""
    items = table(spark, sf, "eval_items").select("item_id", "task").distinct()
    counts = p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("n"))
    return items.join(counts, "item_id", "left").select("item_id", "task", F.coalesce("n", F.lit(0)).alias("n_documents"))


def p9_clean(spark: SparkSession, sf: str) -> DataFrame:
    return without_leaks(*_texts(spark, sf))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    codes = table(spark, sf, "lang_codes").select(F.col("label").alias("lang"), F.col("code")).distinct()
    return table(spark, sf, "documents").join(codes, "lang", "left").select("doc_id", "text", "code")


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    model = train(sample(_labelled(spark, sf), "doc_id", "text", "code"))
    return segment_languages(table(spark, sf, "documents"), "doc_id", "text", model)


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    return document_languages(table(spark, sf, "documents"), p10_segments(spark, sf), "doc_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    found, labels = p10_segments(spark, sf), _labelled(spark, sf).select("doc_id", "code").distinct()
    return found.where("lang is not null").join(labels, "doc_id").where("code is null or code != lang").select("doc_id", "seg_no", "lang").distinct()


QUERIES = {f.__name__: f for f in (p2_sample, p2_rows, p4_found, p4_splits, p4_balance, p4_integrity, p8_ids, p8_shape, p9_found, p9_items, p9_clean, p10_found, p10_segments, p10_documents)}

_P2 = f"""
  WITH f AS (SELECT chooser, min(load_no) AS load_no FROM decisions WHERE chooser >= 0 AND load_no IS NOT NULL GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY load_no ORDER BY substr(md5('frozen-1:' || chooser), 1, 15), chooser) AS k, count(*) OVER (PARTITION BY load_no) AS n FROM f)
  SELECT chooser, load_no FROM r WHERE k <= ceil({RATE}::DOUBLE * n)"""

_P4 = """
  WITH RECURSIVE d AS (SELECT DISTINCT chooser, lower(trim(cohort)) AS c FROM decisions WHERE chooser >= 0),
  e AS (SELECT * FROM d WHERE c IS NOT NULL AND c NOT IN ('', 'unknown', 'n/a')),
  low AS (SELECT c, min(chooser) AS m FROM e GROUP BY c),
  link AS (SELECT DISTINCT chooser AS a, m AS b FROM e JOIN low USING (c) WHERE chooser <> m),
  both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
  reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
  root AS (SELECT a AS chooser, min(b) AS r FROM reach GROUP BY a)
  SELECT r AS chooser_a, chooser AS chooser_b FROM root WHERE r < chooser"""

SQL = {
    "p2_sample": _P2,
    "p4_found": _P4,
    "p8_shape": "SELECT doc_id, coalesce(text, '') = '' AS empty FROM documents",
    "p4_integrity": "SELECT count(*) AS n, 3 AS splits, true AS shares_hold, 0 AS torn_choosers, 0 AS torn_cohorts FROM decisions",
    "p2_rows": f"SELECT gid, chooser, start_ms, t, ord, load_no FROM decisions SEMI JOIN ({_P2}) USING (chooser)",
}
