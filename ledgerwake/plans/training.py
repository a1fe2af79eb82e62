"""Queries p1, p3, p5, p6 and p7 over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.operators.copydiff import Field, compare_copies
from ledgerwake.operators.intervals import periods, periods_and_gaps
from ledgerwake.operators.rolling import day_number, trailing_totals
from ledgerwake.operators.skew import key_profile
from ledgerwake.operators.versions import attributes_at
from ledgerwake.session import table

FORTNIGHT_MS = 14 * 86_400_000


def _decisions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "decisions").where("chooser >= 0")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return periods_and_gaps(_decisions(spark, sf), "chooser", "start_ms", "t", FORTNIGHT_MS)


def p1_periods(spark: SparkSession, sf: str) -> DataFrame:
    return periods(_decisions(spark, sf), "chooser", "start_ms", "t").select("chooser", F.col("period_no").cast("long").alias("period_no"), "from_at", "to_at", "n_starts", F.coalesce(F.col("from_at") - F.col("previous_to"), F.lit(0)).alias("gap_before_ms"))


def _exposures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exposures")


def p3_choosers(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(key_profile(table(spark, sf, "analysis_panel"), "chooser_user_id", "game_id", "engine_eval_cp_disconnected"))


def p3_opponents(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(key_profile(_exposures(spark, sf), "opponent_id", "row_id", "pre_games_30d"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("mean_value", "q50", "q90", "share")})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    panel = key_profile(table(spark, sf, "analysis_panel"), "chooser_user_id", "game_id", "engine_eval_cp_disconnected")
    exposed = key_profile(_exposures(spark, sf), "opponent_id", "row_id", "pre_games_30d")
    named = [d.where("heavy").select(F.lit(c).alias("field"), F.col(c).alias("user_id")) for d, c in ((panel, "chooser_user_id"), (exposed, "opponent_id"))]
    return named[0].unionByName(named[1])


def _utc_ms(c: str) -> F.Column:
    """Epoch milliseconds of a timestamp without zone, read as UTC."""
    day = F.unix_date(F.to_date(c)).cast("long") * 86_400_000
    return (day + F.hour(c) * 3_600_000 + F.minute(c) * 60_000 + F.floor(F.expr(f"extract(SECOND FROM {c})") * 1000)).cast("long")


def score_fields() -> list[Field]:
    plain = ("month_code", "speed", "n_all_time", "counterparts_all_time")
    near = ("expected_all_time", "adjusted_all_time")
    return [
        *(Field(c, F.col(c), F.col(c)) for c in plain),
        *(Field(c, F.col(c), F.col(c), 1e-9) for c in near),
        Field("anchor_ms", F.col("anchor_ms"), _utc_ms("anchor_at")),
    ]


def _differences(spark: SparkSession, sf: str) -> DataFrame:
    return compare_copies(table(spark, sf, "scores_main"), table(spark, sf, "scores_copy"), ["row_id"], score_fields(), "rev")


def p5_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Every difference with both values: numbers rounded to 9 digits, and as texts where they are not numbers."""
    d = _differences(spark, sf)
    number = lambda c: F.round(F.nullif(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(float("nan"))), 9)
    text = lambda c: F.when(F.expr(f"try_cast({c} AS DOUBLE)").isNull() | F.isnan(F.expr(f"try_cast({c} AS DOUBLE)")), F.col(c))
    return d.select("row_id", "diff", *[f(f"{side}_value").alias(f"{side}_{n}") for side in ("main", "copy") for n, f in (("number", number), ("text", text))])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _differences(spark, sf).select("row_id", "diff")


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    """One row per game record and player."""
    side = lambda c: F.struct(F.col(f"{c}_id").alias("recipient_id"), F.col(f"{c}_elo").alias("elo"), F.lit(c).alias("side"))
    games = table(spark, sf, "chronology").select("game_id", "utc_ms", "archive_ordinal", "recorded_ms", F.explode(F.array(side("white"), side("black"))).alias("x"))
    return games.select("game_id", "utc_ms", "archive_ordinal", "recorded_ms", "x.*").where("recipient_id is not null")


def p6_ratings(spark: SparkSession, sf: str) -> DataFrame:
    asked = _exposures(spark, sf).select("row_id", "recipient_id", "anchor_ms").distinct()
    rated = _sides(spark, sf).where("elo between 400 and 4000")
    out = attributes_at(asked, rated, "recipient_id", "anchor_ms", "utc_ms", "recorded_ms", "archive_ordinal", ["elo", "side"])
    return out.select("row_id", "recipient_id", "anchor_ms", F.col("then_archive_ordinal").alias("archive_ordinal"), F.col("then_utc_ms").alias("rated_ms"), F.col("then_elo").alias("elo"), F.col("then_side").alias("side"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """The ordinal is part of the version's rank, so no further attribute is joined."""
    asked = _exposures(spark, sf).select("row_id", "recipient_id", "anchor_ms").distinct()
    rated = _sides(spark, sf).where("elo between 400 and 4000")
    out = attributes_at(asked, rated, "recipient_id", "anchor_ms", "utc_ms", "recorded_ms", "archive_ordinal", [])
    return out.select("row_id", F.col("then_archive_ordinal").alias("archive_ordinal")).distinct()


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    stored = _exposures(spark, sf).where("recipient_id is not null and archive_start_ms is not null").select("row_id", "recipient_id", day_number("archive_start_ms").alias("day"), F.col("n_7d").alias("s_7"), F.col("pre_games_30d").alias("s_30"), F.col("pre_mean_30d").alias("s_mean")).distinct()
    played = _sides(spark, sf).where("utc_ms is not null").select("recipient_id", "game_id", day_number("utc_ms").alias("day"))
    right = trailing_totals(played, stored, "recipient_id", "game_id", "day")
    off = F.col("s_mean").isNull() | F.isnan("s_mean") | (F.abs(F.col("s_mean") - F.col("mean_30d")) > 0.0005)
    wrong = F.array_compact(F.array(
        F.when(~F.col("s_7").eqNullSafe(F.col("n_7d")), F.lit("n_7d")),
        F.when(~F.col("s_30").eqNullSafe(F.col("n_30d")), F.lit("pre_games_30d")),
        F.when(off, F.lit("pre_mean_30d")),
    ))
    return stored.join(right, ["recipient_id", "day"]).select("row_id", F.explode(wrong).alias("field")).distinct()


def p7_daily(spark: SparkSession, sf: str) -> DataFrame:
    """All recipients of exposures and all their days, from the first game to 30 days after the last."""
    recipients = _exposures(spark, sf).where("recipient_id is not null").select("recipient_id").distinct()
    played = _sides(spark, sf).where("utc_ms is not null").join(recipients, "recipient_id", "left_semi").select("recipient_id", "game_id", day_number("utc_ms").alias("day"))
    out = trailing_totals(played, None, "recipient_id", "game_id", "day")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_7d", "mean_30d")})


QUERIES = {f.__name__: f for f in (p1_found, p1_periods, p3_found, p3_choosers, p3_opponents, p5_found, p5_differences, p6_found, p6_ratings, p7_found, p7_daily)}

_SPANS = """
  spans AS (SELECT DISTINCT chooser, start_ms, t FROM decisions WHERE chooser >= 0 AND start_ms IS NOT NULL AND t >= start_ms),
  marked AS (SELECT *, max(t) OVER (PARTITION BY chooser ORDER BY start_ms, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM spans),
  islands AS (SELECT *, sum(CASE WHEN prior IS NULL OR start_ms > prior THEN 1 ELSE 0 END) OVER (PARTITION BY chooser ORDER BY start_ms, t ROWS UNBOUNDED PRECEDING) AS no FROM marked),
  joined AS (SELECT chooser, no, min(start_ms) AS from_at, max(t) AS to_at, count(DISTINCT start_ms) AS n_starts FROM islands GROUP BY chooser, no),
  gaps AS (SELECT *, lag(to_at) OVER (PARTITION BY chooser ORDER BY no) AS previous_to FROM joined)
"""


def _profile_sql(name: str, key: str, record: str, value: str) -> str:
    return f"""
    WITH r AS (SELECT {key} AS k, {record} AS rec, max(CASE WHEN NOT isnan({value}::DOUBLE) THEN {value}::DOUBLE END) AS v FROM {name} WHERE {record} IS NOT NULL GROUP BY 1, 2),
    n AS (SELECT count(DISTINCT rec) AS total FROM r)
    SELECT k AS {key}, count(*) AS n_records, count(v) AS n_values, round(avg(v), 6) AS mean_value,
      round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90,
      round(count(*) / any_value(total), 6) AS share, count(*) >= 0.02 * any_value(total) AS heavy
    FROM r, n WHERE k >= 0 GROUP BY k"""


_FIELDS_SQL = {
    **{c: f"m.{c} IS DISTINCT FROM c.{c}" for c in ("month_code", "speed", "n_all_time", "counterparts_all_time")},
    **{
        c: f"""CASE WHEN m.{c} IS NULL OR c.{c} IS NULL THEN (m.{c} IS NULL) <> (c.{c} IS NULL)
          WHEN isnan(m.{c}) OR isnan(c.{c}) THEN isnan(m.{c}) <> isnan(c.{c}) ELSE abs(m.{c} - c.{c}) > 1e-9 END"""
        for c in ("expected_all_time", "adjusted_all_time")
    },
    "anchor_ms": "m.anchor_ms IS DISTINCT FROM epoch_ms(c.anchor_at)",
}

_P5 = f"""
  WITH a AS (SELECT DISTINCT * FROM scores_main WHERE row_id IS NOT NULL), b AS (SELECT DISTINCT * FROM scores_copy WHERE row_id IS NOT NULL),
  m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rev DESC NULLS LAST) = 1),
  c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rev DESC NULLS LAST) = 1)
  SELECT row_id, 'only_main' AS diff FROM m ANTI JOIN c USING (row_id)
  UNION ALL SELECT row_id, 'only_copy' FROM c ANTI JOIN m USING (row_id)
  {"".join(f" UNION ALL SELECT m.row_id, '{k}' FROM m JOIN c USING (row_id) WHERE {v}" for k, v in _FIELDS_SQL.items())}"""

_NEWEST = """
  WITH a AS (SELECT DISTINCT * FROM scores_main WHERE row_id IS NOT NULL), b AS (SELECT DISTINCT * FROM scores_copy WHERE row_id IS NOT NULL),
  m AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rev DESC NULLS LAST) = 1),
  c AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY rev DESC NULLS LAST) = 1)"""


def _values_sql(k: str) -> str:
    a, b = f"m.{k}", "epoch_ms(c.anchor_at)" if k == "anchor_ms" else f"c.{k}"
    if k == "speed":
        own = f"NULL::DOUBLE, {a}, NULL::DOUBLE, {b}"
    else:
        own = ", ".join(f"CASE WHEN NOT isnan({x}::DOUBLE) THEN round({x}::DOUBLE, 9) END, CASE WHEN isnan({x}::DOUBLE) THEN 'NaN' END" for x in (a, b))
    return f" UNION ALL SELECT m.row_id, '{k}', {own} FROM m JOIN c USING (row_id) WHERE {_FIELDS_SQL[k]}"


_P5_VALUES = f"""{_NEWEST} SELECT row_id, 'only_main' AS diff, NULL::DOUBLE AS main_number, NULL::VARCHAR AS main_text, NULL::DOUBLE AS copy_number, NULL::VARCHAR AS copy_text FROM m ANTI JOIN c USING (row_id)
  UNION ALL SELECT row_id, 'only_copy', NULL, NULL, NULL, NULL FROM c ANTI JOIN m USING (row_id){"".join(map(_values_sql, _FIELDS_SQL))}"""

_SIDES = """sides AS (
    SELECT game_id, utc_ms, archive_ordinal, recorded_ms, white_id AS recipient_id, white_elo AS elo, 'white' AS side FROM chronology
    UNION SELECT game_id, utc_ms, archive_ordinal, recorded_ms, black_id, black_elo, 'black' FROM chronology)"""

_P6 = f"""
  WITH {_SIDES}, e AS (SELECT DISTINCT row_id, recipient_id, anchor_ms FROM exposures)
  SELECT e.row_id, e.recipient_id, e.anchor_ms, s.archive_ordinal, s.utc_ms AS rated_ms, s.elo, s.side
  FROM e JOIN sides s ON s.recipient_id = e.recipient_id AND s.utc_ms <= e.anchor_ms AND s.recorded_ms <= e.anchor_ms AND s.elo BETWEEN 400 AND 4000
  QUALIFY row_number() OVER (PARTITION BY e.row_id, e.recipient_id, e.anchor_ms ORDER BY s.utc_ms DESC, s.archive_ordinal DESC) = 1"""

_P7 = f"""
  WITH {_SIDES}, e AS (SELECT DISTINCT row_id, recipient_id, archive_start_ms // 86400000 AS d, n_7d, pre_games_30d, pre_mean_30d FROM exposures WHERE recipient_id IS NOT NULL AND archive_start_ms IS NOT NULL),
  g AS (SELECT DISTINCT recipient_id, game_id, utc_ms // 86400000 AS d FROM sides WHERE utc_ms IS NOT NULL),
  c AS (SELECT e.row_id, e.d, e.n_7d AS s7, e.pre_games_30d AS s30, e.pre_mean_30d AS sm, count(DISTINCT CASE WHEN g.d >= e.d - 7 THEN g.game_id END) AS n7, count(DISTINCT g.game_id) AS n30
    FROM e LEFT JOIN g ON g.recipient_id = e.recipient_id AND g.d BETWEEN e.d - 30 AND e.d - 1 GROUP BY ALL)
  SELECT DISTINCT row_id, 'n_7d' AS field FROM c WHERE s7 IS DISTINCT FROM n7
  UNION SELECT row_id, 'pre_games_30d' FROM c WHERE s30 IS DISTINCT FROM n30
  UNION SELECT row_id, 'pre_mean_30d' FROM c WHERE sm IS NULL OR isnan(sm) OR abs(sm - n30 / 30.0) > 0.0005"""

_P7_DAILY = f"""
  WITH {_SIDES}, g AS (SELECT DISTINCT recipient_id, game_id, (utc_ms // 86400000)::INTEGER AS day FROM sides SEMI JOIN exposures USING (recipient_id) WHERE utc_ms IS NOT NULL),
  days AS (SELECT recipient_id, unnest(range(min(day), max(day) + 31))::INTEGER AS day FROM g GROUP BY 1),
  n AS (SELECT recipient_id, day, count(*) AS n FROM g GROUP BY 1, 2),
  filled AS (SELECT recipient_id, day, coalesce(n, 0) AS n FROM days LEFT JOIN n USING (recipient_id, day)),
  w AS (SELECT recipient_id, day,
    coalesce(sum(n) OVER (PARTITION BY recipient_id ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_7d,
    coalesce(sum(n) OVER (PARTITION BY recipient_id ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS n_30d FROM filled)
  SELECT recipient_id, day, n_7d, round(n_7d / 7.0, 6) AS mean_7d, n_30d, round(n_30d / 30.0, 6) AS mean_30d FROM w"""

SQL = {
    "p1_found": f"""WITH {_SPANS} SELECT chooser, 'period' AS kind, from_at AS from_ms, to_at AS to_ms FROM joined
      UNION ALL SELECT chooser, 'gap', previous_to, from_at FROM gaps WHERE from_at - previous_to <= {FORTNIGHT_MS}""",
    "p1_periods": f"WITH {_SPANS} SELECT chooser, no::BIGINT AS period_no, from_at, to_at, n_starts, coalesce(from_at - previous_to, 0) AS gap_before_ms FROM gaps",
    "p3_found": """
      WITH a AS (SELECT chooser_user_id AS u, count(DISTINCT game_id) AS n FROM analysis_panel GROUP BY 1),
      b AS (SELECT opponent_id AS u, count(DISTINCT row_id) AS n FROM exposures GROUP BY 1)
      SELECT 'chooser_user_id' AS field, u AS user_id FROM a WHERE u >= 0 AND n >= 0.02 * (SELECT count(DISTINCT game_id) FROM analysis_panel)
      UNION ALL SELECT 'opponent_id', u FROM b WHERE u >= 0 AND n >= 0.02 * (SELECT count(DISTINCT row_id) FROM exposures)""",
    "p3_choosers": _profile_sql("analysis_panel", "chooser_user_id", "game_id", "engine_eval_cp_disconnected"),
    "p3_opponents": _profile_sql("exposures", "opponent_id", "row_id", "pre_games_30d"),
    "p5_found": _P5,
    "p5_differences": _P5_VALUES,
    "p6_found": f"SELECT DISTINCT row_id, archive_ordinal FROM ({_P6})",
    "p6_ratings": _P6,
    "p7_found": _P7,
    "p7_daily": _P7_DAILY,
}
