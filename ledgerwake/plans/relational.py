"""Scans, projections, joins, aggregates, windows, sorts, sets and scalar functions.

Each query is a text in the common part of both dialects; where they differ,
the oracle has a text of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerwake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_TABLE = re.compile(r"\{(\w+)\}")


def query(name: str, text: str, oracle: str | None = None) -> None:
    """Register ``text``, in which {table} names a table of the data folder."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, sf, t) for t in set(_TABLE.findall(text))})

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = _TABLE.sub(r"\1", oracle or text)


# Projection and filters -------------------------------------------------------

query("scan_project_bins", """
  SELECT game_id, utc_ms, CAST(50 * floor(chooser_elo / 50.0) AS BIGINT) AS elo_bin, abs(chooser_elo - disconnected_elo) AS gap,
    CASE WHEN ply_count IS NULL THEN 'missing' WHEN ply_count <= 10 THEN 'opening' WHEN ply_count <= 60 THEN 'middle' ELSE 'late' END AS phase
  FROM {analysis_panel} WHERE utc_ms IS NOT NULL""")
query("case_disposition", """
  SELECT disposition, count(*) AS n, count(DISTINCT game_id) AS games FROM (
    SELECT game_id, CASE WHEN chooser_user_id IS NULL THEN 'no chooser' WHEN chooser_user_id < 0 THEN 'not a user'
      WHEN engine_eval_cp_disconnected IS NULL THEN 'not evaluated' WHEN ply_count IS NULL THEN 'no plies' WHEN ply_count < 10 THEN 'too short'
      WHEN abs(engine_eval_cp_disconnected) > 600 THEN 'decided' ELSE 'kept' END AS disposition FROM {analysis_panel}) x
  GROUP BY disposition""")
query("finite_filter", """
  SELECT speed, count(*) AS n, round(avg(adjusted_all_time), 6) AS mean FROM {scores_main}
  WHERE adjusted_all_time IS NOT NULL AND NOT isnan(adjusted_all_time) AND abs(adjusted_all_time) < 1e300 GROUP BY speed""")
query("null_safe_compare", """
  SELECT a.row_id, CAST(sum(CASE WHEN a.speed IS DISTINCT FROM b.speed THEN 1 ELSE 0 END) AS BIGINT) AS speed_differs,
    CAST(sum(CASE WHEN a.n_all_time IS NOT DISTINCT FROM b.n_all_time THEN 1 ELSE 0 END) AS BIGINT) AS n_same
  FROM {scores_main} a JOIN {scores_copy} b ON a.row_id = b.row_id AND a.rev = b.rev GROUP BY a.row_id""")
query("star_except_replace", """
  SELECT * FROM (SELECT * EXCEPT (o_totalprice, o_orderdate), round(o_totalprice / 1000, 3) AS price_k, CAST(o_orderdate AS DATE) AS order_day FROM {orders}) x""",
  "SELECT * EXCLUDE (o_totalprice, o_orderdate), round(o_totalprice / 1000, 3) AS price_k, o_orderdate::DATE AS order_day FROM orders")
query("bitmask_presence", """
  SELECT CAST(m & 1 AS BIGINT) AS early, CAST(m & 2 AS BIGINT) AS middle, CAST(m & 4 AS BIGINT) AS late, count(*) AS users FROM (
    SELECT chooser_user_id, bit_or(CASE WHEN month < '2023-09' THEN 1 WHEN month < '2024-05' THEN 2 ELSE 4 END) AS m
    FROM {analysis_panel} WHERE chooser_user_id >= 0 GROUP BY chooser_user_id) x GROUP BY 1, 2, 3""")
query("safe_ratio_clamp", """
  SELECT row_id, month_code, round(counterparts_all_time / nullif(n_all_time, 0), 6) AS ratio,
    greatest(-0.2D, least(0.2D, adjusted_all_time)) AS clamped FROM {scores_main} WHERE adjusted_all_time IS NOT NULL AND NOT isnan(adjusted_all_time)""",
  """SELECT row_id, month_code, round(counterparts_all_time / nullif(n_all_time, 0), 6) AS ratio,
    greatest(-0.2::DOUBLE, least(0.2::DOUBLE, adjusted_all_time)) AS clamped FROM scores_main WHERE adjusted_all_time IS NOT NULL AND NOT isnan(adjusted_all_time)""")
query("filter_forms", """
  SELECT game_id, lower(trim(api_status)) AS status, api_speed, ply_count FROM {analysis_panel}
  WHERE ply_count BETWEEN 10 AND 40 AND api_speed IN ('blitz', 'rapid') AND lower(trim(api_status)) LIKE '%time%' AND month NOT IN ('2023-01', '2024-12')
    AND (outcome_kind_draw OR outcome_kind_draw IS NULL)""")
# Joins ----------------------------------------------------------------------------

query("join_inner_multi", """
  SELECT n.n_name, s.s_suppkey, count(*) AS n, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue
  FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
    JOIN {supplier} s ON l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey
  GROUP BY n.n_name, s.s_suppkey""")
query("join_left_chain", """
  SELECT e.row_id, e.recipient_id, m.adjusted_all_time AS main_value, c.adjusted_all_time AS copy_value
  FROM (SELECT DISTINCT row_id, recipient_id FROM {exposures}) e
    LEFT JOIN (SELECT row_id, max(adjusted_all_time) AS adjusted_all_time FROM {scores_main} WHERE NOT isnan(adjusted_all_time) GROUP BY row_id) m USING (row_id)
    LEFT JOIN (SELECT row_id, max(adjusted_all_time) AS adjusted_all_time FROM {scores_copy} WHERE NOT isnan(adjusted_all_time) GROUP BY row_id) c USING (row_id)""")
query("join_full_coverage", """
  SELECT a.row_id AS main_id, b.row_id AS copy_id FROM (SELECT DISTINCT row_id FROM {scores_main} WHERE row_id IS NOT NULL) a
    FULL OUTER JOIN (SELECT DISTINCT row_id FROM {scores_copy} WHERE row_id IS NOT NULL) b ON a.row_id = b.row_id WHERE a.row_id IS NULL OR b.row_id IS NULL""")
query("semi_users", "SELECT u.user_id, count(*) AS n FROM {events} u SEMI JOIN (SELECT user_id FROM {events} WHERE event_type = 'purchase') p ON u.user_id = p.user_id GROUP BY u.user_id")
query("anti_orders", "SELECT c.c_custkey, c.c_nationkey FROM {customer} c ANTI JOIN {orders} o ON c.c_custkey = o.o_custkey")
query("in_or_in", """
  SELECT game_id, archive_ordinal FROM {chronology} WHERE white_id IN (SELECT recipient_id FROM {exposures} WHERE n_7d > 5)
    OR black_id IN (SELECT recipient_id FROM {exposures} WHERE n_7d > 5)""")
query("exists_corr", """
  SELECT o.o_orderpriority, count(*) AS n FROM {orders} o WHERE EXISTS (
    SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o.o_orderpriority""")
# NOT EXISTS over an OR is split in two, so that each side is an equi-join
query("not_exists_or", """
  SELECT DISTINCT e.game_id FROM {exposures} e WHERE NOT EXISTS (SELECT 1 FROM {chronology} c WHERE c.white_id = e.opponent_id) AND NOT EXISTS (SELECT 1 FROM {chronology} c WHERE c.black_id = e.opponent_id)""",
  "SELECT DISTINCT e.game_id FROM exposures e WHERE NOT EXISTS (SELECT 1 FROM chronology c WHERE c.white_id = e.opponent_id OR c.black_id = e.opponent_id)")
query("cross_scenarios", """
  SELECT s.name, api_speed, count(*) AS n, round(avg(CASE WHEN outcome_kind_draw THEN 1e0 ELSE 0e0 END), 6) AS rate
  FROM {analysis_panel} CROSS JOIN (VALUES ('fair', -100, 100000), ('close', -100, 100), ('worse', -100000, -300)) AS s(name, lo, hi)
  WHERE engine_eval_cp_disconnected BETWEEN s.lo AND s.hi GROUP BY s.name, api_speed""")
query("unpivot_sides", """
  SELECT player, side, count(*) AS n, CAST(sum(elo) AS BIGINT) AS total FROM (
    SELECT stack(2, white_id, 'white', white_elo, black_id, 'black', black_elo) AS (player, side, elo) FROM {chronology}) x GROUP BY player, side""",
  """SELECT player, side, count(*) AS n, CAST(sum(elo) AS BIGINT) AS total FROM (
    SELECT white_id AS player, 'white' AS side, white_elo AS elo FROM chronology UNION ALL SELECT black_id, 'black', black_elo FROM chronology) x GROUP BY player, side""")
query("role_self_join", """
  WITH r AS (SELECT DISTINCT game_id, utc_ms, white_id AS p, white_elo AS elo, 0 AS role FROM {chronology} UNION SELECT DISTINCT game_id, utc_ms, black_id, black_elo, 1 FROM {chronology})
  SELECT a.game_id, a.p AS white, b.p AS black, max(a.elo - b.elo) AS gap FROM r a LEFT JOIN r b ON a.game_id = b.game_id AND b.role = 1 WHERE a.role = 0 GROUP BY a.game_id, a.p, b.p""")
query("lookup_absent", """
  SELECT e.row_id, max(s.n_all_time) AS n_all_time, max(CASE WHEN s.row_id IS NULL THEN 1 ELSE 0 END) AS absent FROM {exposures} e LEFT JOIN {scores_copy} s ON s.row_id = e.row_id GROUP BY e.row_id""")
query("update_from", """
  SELECT m.row_id, m.rev, coalesce(c.speed, m.speed) AS speed, c.row_id IS NOT NULL AS updated FROM (SELECT DISTINCT row_id, rev, speed FROM {scores_main} WHERE row_id IS NOT NULL) m
    LEFT JOIN (SELECT row_id, rev, max(speed) AS speed FROM {scores_copy} GROUP BY row_id, rev) c ON c.row_id = m.row_id AND c.rev = m.rev""")
# Aggregates -----------------------------------------------------------------------

query("agg_basic", """
  SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS lo, max(l_discount) AS hi
  FROM {lineitem} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
query("agg_filter", """
  SELECT month, count(*) FILTER (WHERE outcome_kind_draw) AS draws, count(*) FILTER (WHERE NOT outcome_kind_draw) AS wins, count(*) AS n FROM {analysis_panel} GROUP BY month""")
query("having_switchers", """
  SELECT chooser, count(*) AS n FROM {decisions} WHERE chooser >= 0 AND y IS NOT NULL GROUP BY chooser HAVING min(CASE WHEN y THEN 1 ELSE 0 END) = 0 AND max(CASE WHEN y THEN 1 ELSE 0 END) = 1""")
query("distinct_tuple", """
  SELECT month, count(DISTINCT game_id) AS games, count(DISTINCT game_id, chooser_user_id) AS pairs FROM {analysis_panel} GROUP BY month""",
  "SELECT month, count(DISTINCT game_id) AS games, count(DISTINCT (game_id, chooser_user_id)) FILTER (WHERE game_id IS NOT NULL AND chooser_user_id IS NOT NULL) AS pairs FROM analysis_panel GROUP BY month")
query("select_distinct", "SELECT DISTINCT api_speed, lower(trim(api_status)) AS status FROM {analysis_panel}")
query("quantile_approx", """
  WITH a AS (SELECT o_orderpriority, approx_percentile(o_totalprice, 0.5, 1000) AS q FROM {orders} GROUP BY o_orderpriority)
  SELECT o.o_orderpriority, count(*) AS n, count_if(o_totalprice < q) <= 0.501 * count(*) + 1 AND count_if(o_totalprice <= q) >= 0.499 * count(*) - 1 AS within
  FROM {orders} o JOIN a ON a.o_orderpriority = o.o_orderpriority GROUP BY o.o_orderpriority""",
  "SELECT o_orderpriority, count(*) AS n, true AS within FROM orders GROUP BY o_orderpriority")
query("argmin_struct", """
  SELECT chooser, s.gid AS gid, s.t AS t FROM (SELECT chooser, min_by(named_struct('gid', gid, 't', t), named_struct('t', t, 'ord', ord, 'gid', gid)) FILTER (WHERE fair AND t IS NOT NULL) AS s FROM {decisions} WHERE chooser >= 0 GROUP BY chooser) x WHERE s IS NOT NULL""",
  """SELECT chooser, s.gid AS gid, s.t AS t FROM (SELECT chooser, arg_min({'gid': gid, 't': t}, {'t': t, 'ord': ord, 'gid': gid}) FILTER (WHERE fair AND t IS NOT NULL) AS s FROM decisions WHERE chooser >= 0 GROUP BY chooser) x WHERE s IS NOT NULL""")
query("any_and_or", "SELECT chooser, bool_or(y) AS any_y, bool_and(fair) AS all_fair, min(cohort) AS one_cohort FROM {decisions} WHERE chooser >= 0 GROUP BY chooser")
query("string_agg_sorted", """
  SELECT month, listagg(DISTINCT api_speed, ',') WITHIN GROUP (ORDER BY api_speed) AS speeds FROM {analysis_panel} GROUP BY month""",
  "SELECT month, string_agg(DISTINCT api_speed, ',' ORDER BY api_speed) AS speeds FROM analysis_panel GROUP BY month")
query("relation_checksum", """
  SELECT count(*) AS n, CAST(sum(h) AS BIGINT) AS additive, bit_xor(h) AS mixed FROM (SELECT CAST(conv(substr(md5(concat_ws('|', game_id, CAST(utc_ms AS STRING))), 1, 10), 16, 10) AS BIGINT) AS h FROM {analysis_panel}) x""",
  "SELECT count(*) AS n, sum(h)::BIGINT AS additive, bit_xor(h) AS mixed FROM (SELECT ('0x' || substr(md5(concat_ws('|', game_id, utc_ms)), 1, 10))::BIGINT AS h FROM analysis_panel) x")
query("corr_filtered", """
  SELECT api_speed, round(corr(CAST(chooser_elo AS DOUBLE), CAST(disconnected_elo AS DOUBLE)) FILTER (WHERE ply_count > 20), 6) AS r FROM {analysis_panel} GROUP BY api_speed""")
query("var_se", """
  SELECT speed, round(stddev_samp(expected_all_time), 6) AS sd, round(var_pop(expected_all_time), 6) AS v, round(stddev_samp(expected_all_time) / sqrt(count(expected_all_time)), 6) AS se
  FROM {scores_main} WHERE NOT isnan(expected_all_time) GROUP BY speed""")
query("merge_partials", """
  WITH p AS (SELECT chooser_user_id, month, count(*) AS n, min(utc_ms) AS lo, max(utc_ms) AS hi FROM {analysis_panel} WHERE chooser_user_id >= 0 GROUP BY chooser_user_id, month)
  SELECT chooser_user_id, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi FROM p GROUP BY chooser_user_id""")
query("hist_median", """
  SELECT speed, round(percentile(v, 0.5, n), 6) AS q50 FROM (SELECT speed, CAST(n_all_time AS DOUBLE) AS v, count(*) AS n FROM {scores_main} WHERE n_all_time IS NOT NULL GROUP BY speed, n_all_time) h GROUP BY speed""",
  "SELECT speed, round(median(n_all_time::DOUBLE), 6) AS q50 FROM scores_main WHERE n_all_time IS NOT NULL GROUP BY speed")
query("share_of_group", """
  SELECT api_speed, month, n, round(1e2 * n / sum(n) OVER (PARTITION BY api_speed), 6) AS pct FROM (SELECT api_speed, month, count(*) AS n FROM {analysis_panel} GROUP BY api_speed, month) x""")
query("concentration", """
  WITH u AS (SELECT month, chooser_user_id, count(*) AS n FROM {analysis_panel} WHERE chooser_user_id >= 0 GROUP BY month, chooser_user_id)
  SELECT month, count(*) AS users, max(n) AS largest, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_share, round(sum(n * n) / CAST(sum(n) * sum(n) AS DOUBLE), 6) AS herfindahl FROM u GROUP BY month""")
query("pivot_monthly", """
  SELECT * FROM (SELECT month, api_speed FROM {analysis_panel}) PIVOT (count(*) FOR api_speed IN ('bullet' AS bullet, 'blitz' AS blitz, 'rapid' AS rapid))""",
  "SELECT month, nullif(count(*) FILTER (WHERE api_speed = 'bullet'), 0) AS bullet, nullif(count(*) FILTER (WHERE api_speed = 'blitz'), 0) AS blitz, nullif(count(*) FILTER (WHERE api_speed = 'rapid'), 0) AS rapid FROM analysis_panel GROUP BY month")
query("grouping_sets", """
  SELECT coalesce(api_speed, '*') AS speed, coalesce(month, '*') AS month, count(*) AS n FROM {analysis_panel} WHERE api_speed IS NOT NULL GROUP BY GROUPING SETS ((api_speed, month), (api_speed), ())""",
  "SELECT coalesce(api_speed, '*') AS speed, coalesce(analysis_panel.month, '*') AS month, count(*) AS n FROM analysis_panel WHERE api_speed IS NOT NULL GROUP BY GROUPING SETS ((api_speed, analysis_panel.month), (api_speed), ())")
query("exact_sum", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 4))) * 10000 AS BIGINT) AS units FROM {lineitem} GROUP BY l_returnflag")
query("latest_snapshot", """
  SELECT player, x.utc_ms AS utc_ms, x.elo AS elo, x.ratings AS ratings FROM (
    SELECT player, max_by(named_struct('utc_ms', utc_ms, 'elo', elo, 'ratings', ratings), utc_ms) AS x FROM (
      SELECT player, utc_ms, max(elo) AS elo, count(DISTINCT elo) AS ratings FROM (
        SELECT stack(2, white_id, white_elo, black_id, black_elo) AS (player, elo), utc_ms FROM {chronology} WHERE utc_ms IS NOT NULL) s GROUP BY player, utc_ms) g GROUP BY player) m WHERE player IS NOT NULL""",
  """WITH g AS (SELECT white_id AS player, utc_ms, white_elo AS elo FROM chronology WHERE utc_ms IS NOT NULL UNION ALL SELECT black_id, utc_ms, black_elo FROM chronology WHERE utc_ms IS NOT NULL),
  m AS (SELECT player, max(utc_ms) AS utc_ms FROM g GROUP BY player)
  SELECT m.player, m.utc_ms, max(g.elo) AS elo, count(DISTINCT g.elo) AS ratings FROM m JOIN g ON g.player = m.player AND g.utc_ms = m.utc_ms GROUP BY m.player, m.utc_ms""")
# Windows --------------------------------------------------------------------------
_GAMES = "(SELECT DISTINCT gid, chooser, t, ord, y FROM {decisions} WHERE chooser >= 0 AND t IS NOT NULL)"

query("first_per_entity", f"SELECT chooser, gid, t FROM (SELECT *, row_number() OVER (PARTITION BY chooser ORDER BY t, ord, gid) AS rn FROM {_GAMES} g) x WHERE rn = 1",
  f"SELECT chooser, gid, t FROM {_GAMES} g QUALIFY row_number() OVER (PARTITION BY chooser ORDER BY t, ord, gid) = 1")
query("range_interval_7d", """
  SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS BIGINT) AS before,
    CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAYS FOLLOWING) AS BIGINT) AS after
  FROM (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day, count(*) AS n FROM {events} GROUP BY 1, 2) x""",
  """SELECT user_id, day, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAY PRECEDING) AS BIGINT) AS before,
    CAST(sum(n) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN CURRENT ROW AND INTERVAL 6 DAYS FOLLOWING) AS BIGINT) AS after
  FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY 1, 2) x""")
query("dense_rank_code", "SELECT c_custkey, c_mktsegment, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS stratum FROM {customer}")
# Sorts, samples and sets ----------------------------------------------------------

query("topn_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) x WHERE r <= 3")
query("hash_sample_md5", "SELECT game_id, md5(concat(game_id, '#7')) AS h FROM (SELECT DISTINCT game_id FROM {analysis_panel}) x ORDER BY h, game_id LIMIT 100")
query("disjoint_cohorts", """
  WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('c', CAST(o_custkey AS STRING))), o_custkey) AS k, o_orderpriority FROM (SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM {orders} GROUP BY o_custkey) x)
  SELECT o_custkey, o_orderpriority, CASE WHEN k <= 20 THEN 'dev' ELSE 'eval' END AS cohort FROM r WHERE k <= 60""",
  """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('c', o_custkey)), o_custkey) AS k, o_orderpriority FROM (SELECT o_custkey, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey) x)
  SELECT o_custkey, o_orderpriority, CASE WHEN k <= 20 THEN 'dev' ELSE 'eval' END AS cohort FROM r WHERE k <= 60""")
query("fold_md5", """
  SELECT chooser, CAST(conv(substr(md5(CAST(chooser AS STRING)), 1, 8), 16, 10) AS BIGINT) % 5 AS fold, count(*) AS n FROM {decisions} WHERE chooser >= 0 GROUP BY chooser""",
  "SELECT chooser, ('0x' || substr(md5(chooser::VARCHAR), 1, 8))::BIGINT % 5 AS fold, count(*) AS n FROM decisions WHERE chooser >= 0 GROUP BY chooser")
query("union_by_name", "SELECT row_id, speed, CAST(NULL AS TIMESTAMP_NTZ) AS anchor_at FROM {scores_main} UNION ALL SELECT row_id, speed, anchor_at FROM {scores_copy}",
  "SELECT row_id, speed FROM scores_main UNION ALL BY NAME SELECT row_id, speed, anchor_at FROM scores_copy")
query("union_distinct", "SELECT white_id AS player FROM {chronology} UNION SELECT black_id FROM {chronology}")
query("intersect_users", "SELECT chooser_user_id AS u FROM {analysis_panel} INTERSECT SELECT disconnected_user_id FROM {analysis_panel}")
query("except_users", "SELECT chooser_user_id AS u FROM {analysis_panel} EXCEPT SELECT chooser FROM {decisions}")
query("multiset_equal", """
  SELECT (SELECT count(*) FROM (SELECT row_id, speed, rev FROM {scores_main} EXCEPT ALL SELECT row_id, speed, rev FROM {scores_copy}) x) AS only_main,
    (SELECT count(*) FROM (SELECT row_id, speed, rev FROM {scores_copy} EXCEPT ALL SELECT row_id, speed, rev FROM {scores_main}) y) AS only_copy""")
query("duplicate_rows", "SELECT gid, chooser, t, ord, count(*) AS copies FROM {decisions} GROUP BY gid, chooser, t, ord HAVING count(*) > 1")
# Scalar functions -----------------------------------------------------------------

query("string_funcs", """
  SELECT p_partkey, lower(p_name) AS l, upper(trim(p_brand)) AS b, split_part(p_type, ' ', 1) AS kind, length(p_name) - length(replace(p_name, 'a', '')) AS a_count,
    substr(p_name, 2, 3) AS part, instr(p_name, 'e') AS first_e, concat_ws('-', p_brand, p_type) AS joined, lpad(CAST(p_size AS STRING), 4, '0') AS padded FROM {part}""",
  """SELECT p_partkey, lower(p_name) AS l, upper(trim(p_brand)) AS b, split_part(p_type, ' ', 1) AS kind, length(p_name) - length(replace(p_name, 'a', '')) AS a_count,
    substr(p_name, 2, 3) AS part, strpos(p_name, 'e') AS first_e, concat_ws('-', p_brand, p_type) AS joined, lpad(p_size::VARCHAR, 4, '0') AS padded FROM part""")
query("regex_validate", """
  SELECT game_id, game_id RLIKE '^(?:[A-Z][a-z0-9]+)$' AS whole, game_id RLIKE '[0-9][0-9]' AS two_digits FROM (SELECT DISTINCT game_id FROM {analysis_panel}) x""",
  "SELECT game_id, regexp_full_match(game_id, '[A-Z][a-z0-9]+') AS whole, regexp_matches(game_id, '[0-9][0-9]') AS two_digits FROM (SELECT DISTINCT game_id FROM analysis_panel) x")
query("date_funcs", """
  SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, weekday(o_orderdate) + 1 AS isodow, CAST(date_trunc('week', o_orderdate) AS DATE) AS week,
    (year(o_orderdate) - 1992) * 12 + month(o_orderdate) - 1 AS months, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS days, date_format(o_orderdate, 'yyyy-MM') AS ym FROM {orders}""",
  """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, isodow(o_orderdate) AS isodow, date_trunc('week', o_orderdate)::DATE AS week,
    date_diff('month', TIMESTAMP '1992-01-01', o_orderdate) AS months, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days, strftime(o_orderdate, '%Y-%m') AS ym FROM orders""")
query("epoch_funcs", """
  SELECT game_id, utc_ms, unix_millis(timestamp_millis(utc_ms)) AS back, utc_ms div 60000 AS minute, hour(timestamp_millis(utc_ms)) AS hour, pmod(utc_ms, 1000) AS ms FROM {analysis_panel} WHERE utc_ms IS NOT NULL""",
  "SELECT game_id, utc_ms, epoch_ms(epoch_ms(utc_ms)) AS back, utc_ms // 60000 AS minute, hour(epoch_ms(utc_ms)) AS hour, utc_ms % 1000 AS ms FROM analysis_panel WHERE utc_ms IS NOT NULL")
query("math_funcs", """
  SELECT game_id, round(1 / (1 + exp(-greatest(-30, least(30, (chooser_elo - disconnected_elo) / 1.737e2)))), 9) AS expected, round(ln(1 + abs(chooser_elo)), 9) AS lg, round(pow(chooser_elo / 1e3, 2), 6) AS sq,
    CAST(sign(chooser_elo - disconnected_elo) AS BIGINT) AS s, round(sign(engine_eval_cp_disconnected) * ln(1 + abs(engine_eval_cp_disconnected)), 6) AS slog, round(sin(chooser_elo) + cos(pi()), 6) AS trig
  FROM {analysis_panel} WHERE chooser_elo IS NOT NULL AND disconnected_elo IS NOT NULL AND engine_eval_cp_disconnected IS NOT NULL AND NOT isnan(engine_eval_cp_disconnected)""")
query("array_hof", "SELECT vec_id, size(embedding) AS n, round(array_max(embedding), 5) AS hi, round(array_min(embedding), 5) AS lo, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * x), 0D, (a, x) -> a + x), 4) AS norm2 FROM {embeddings}",
  "SELECT vec_id, len(embedding) AS n, round(list_max(embedding), 5) AS hi, round(list_min(embedding), 5) AS lo, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 4) AS norm2 FROM embeddings")
query("zip_unnest", """
  SELECT game_id, x.`0` AS player, x.`1` AS elo FROM (SELECT explode(arrays_zip(array(white_id, black_id), array(white_elo, black_elo))) AS x, game_id
    FROM (SELECT DISTINCT game_id, archive_ordinal, white_id, black_id, white_elo, black_elo FROM {chronology}) c) y""",
  """SELECT game_id, unnest([white_id, black_id]) AS player, unnest([white_elo, black_elo]) AS elo
    FROM (SELECT DISTINCT game_id, archive_ordinal, white_id, black_id, white_elo, black_elo FROM chronology) c""")
query("json_extract", "SELECT event_id, get_json_object(props, '$.k') AS k, try_parse_json(props) IS NOT NULL AS valid FROM {events}",
  "SELECT event_id, json_extract_string(props, '$.k') AS k, TRY_CAST(props AS JSON) IS NOT NULL AS valid FROM events")
query("json_keys", "SELECT k, count(*) AS n FROM (SELECT explode(json_object_keys(props)) AS k FROM {events}) x GROUP BY k",
  "SELECT k, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS k FROM events) x GROUP BY k")
query("struct_hash", "SELECT DISTINCT row_id, sha2(concat_ws('|', CAST(row_id AS STRING), speed, CAST(rev AS STRING)), 256) AS h FROM {scores_main}",
  "SELECT DISTINCT row_id, sha256(concat_ws('|', row_id::VARCHAR, speed, rev::VARCHAR)) AS h FROM scores_main")
query("try_cast_forms", "SELECT event_id, try_cast(get_json_object(props, '$.k') AS BIGINT) AS k, CAST(value > 50 AS INT) AS big, nullif(event_type, 'view') AS kind FROM {events}",
  "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, (value > 50)::INT AS big, nullif(event_type, 'view') AS kind FROM events")
query("series_values", "SELECT k.id AS j, v.c, k.id * v.w AS weighted FROM range(4) k CROSS JOIN (VALUES ('a', 2), ('b', 5)) AS v(c, w)",
  "SELECT k.j, v.c, k.j * v.w AS weighted FROM range(4) k(j) CROSS JOIN (VALUES ('a', 2), ('b', 5)) AS v(c, w)")
query("scalar_subquery", "SELECT p_partkey, p_retailprice FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) * 1.2 FROM {part})")
query("format_funcs", "SELECT s_suppkey, format_string('%.2f|%05d', s_acctbal, s_suppkey) AS text FROM {supplier}", "SELECT s_suppkey, printf('%.2f|%05d', s_acctbal, s_suppkey) AS text FROM supplier")
query("hash_forms", """
  SELECT DISTINCT row_id, rev, sha2(to_json(named_struct('row_id', row_id, 'speed', speed), map('ignoreNullFields', 'false')), 256) AS sha,
    conv(regexp_replace(substr(md5(speed), 17), '(..)(..)(..)(..)(..)(..)(..)(..)', '$8$7$6$5$4$3$2$1'), 16, 10) AS low FROM {scores_main}""",
  "SELECT DISTINCT row_id, rev, sha256(to_json({'row_id': row_id, 'speed': speed})::VARCHAR) AS sha, md5_number_lower(speed)::VARCHAR AS low FROM scores_main")
query("zone_funcs", """
  SELECT event_id, unix_micros(from_utc_timestamp(ts, 'America/New_York')) AS local_us, extract(DAYOFWEEK_ISO FROM ts) * 24 - 24 + hour(ts) AS hour_of_week,
    CAST(try_to_timestamp(concat('2024-', CAST(event_id % 15 AS STRING), '-07'), 'yyyy-M-dd') AS DATE) AS parsed, current_timezone() IS NOT NULL AS zoned, unix_seconds(timestamp_seconds(event_id)) AS seconds FROM {events}""",
  """SELECT event_id, epoch_us(timezone('America/New_York', timezone('UTC', ts))) AS local_us, isodow(ts) * 24 - 24 + hour(ts) AS hour_of_week,
    try_strptime(concat('2024-', (event_id % 15)::VARCHAR, '-07'), '%Y-%m-%d')::DATE AS parsed, current_setting('TimeZone') IS NOT NULL AS zoned, epoch(make_timestamp(event_id * 1000000))::BIGINT AS seconds FROM events""")
query("json_kinds", """
  SELECT event_id, CASE schema_of_variant(parse_json(props):k) WHEN 'BIGINT' THEN 'number' WHEN 'STRING' THEN 'text' ELSE 'other' END AS kind, get_json_object(props, '$.k') IS NOT NULL AS has_k, get_json_object(props, '$.a.b') IS NOT NULL AS has_path,
    get_json_object(concat('{{"a":{{"b":[1,', event_id, ']}}}}'), '$.a.b[1]') AS nested FROM {events}""",
  """SELECT event_id, CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'number' WHEN 'BIGINT' THEN 'number' WHEN 'VARCHAR' THEN 'text' ELSE 'other' END AS kind, json_exists(props, '$.k') AS has_k, json_exists(props, '$.a.b') AS has_path,
    json_extract_string(concat('{"a":{"b":[1,', event_id, ']}}'), '$.a.b[1]') AS nested FROM events""")
query("table_edits", """
  WITH kept AS (SELECT row_id, rev, speed FROM {scores_main} m WHERE row_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {scores_copy} c WHERE c.row_id = m.row_id AND c.rev > m.rev)),
  added AS (SELECT row_id, rev, speed FROM {scores_copy} c WHERE rev > 1 AND row_id IS NOT NULL)
  SELECT row_id, rev, speed, CAST(NULL AS STRING) AS note, count(*) AS copies FROM (SELECT * FROM kept UNION ALL SELECT * FROM added) x GROUP BY row_id, rev, speed""")
query("multi_key_sort", """
  SELECT row_id, speed, n_all_time, rev FROM {scores_main} ORDER BY speed DESC NULLS LAST, n_all_time ASC NULLS FIRST, row_id ASC NULLS LAST, rev DESC NULLS LAST LIMIT 50""",
  "SELECT row_id, speed, n_all_time, rev FROM scores_main ORDER BY speed DESC NULLS LAST, n_all_time ASC NULLS FIRST, row_id ASC NULLS LAST, rev DESC NULLS LAST LIMIT 50")
