"""Queries of the statistics layer and of the data contracts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.operators import contracts
from ledgerwake.operators.temporal import window_counts
from ledgerwake.session import table
from ledgerwake.stats import effects, likelihood, moments, scores

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    """Opportunities once each, with users, an outcome and an evaluation."""
    p = table(spark, sf, "analysis_panel").where("chooser_user_id >= 0 and disconnected_user_id >= 0 and outcome_kind_draw is not null and not isnan(engine_eval_cp_disconnected) and engine_eval_cp_disconnected is not null and chooser_elo is not null and disconnected_elo is not null and utc_ms is not null")
    cp = F.col("engine_eval_cp_disconnected")
    return p.select("game_id", "month", "utc_ms", F.col("chooser_user_id").alias("u"), F.col("disconnected_user_id").alias("v"), F.col("outcome_kind_draw").cast("double").alias("y"), (cp / 100).alias("cp"), ((F.col("chooser_elo") - F.col("disconnected_elo")) / 100.0).alias("gap"), F.coalesce("api_speed", F.lit("none")).alias("speed"), (cp >= -100).alias("fair")).distinct()


_PANEL = """p AS (SELECT DISTINCT game_id, month, utc_ms, chooser_user_id AS u, disconnected_user_id AS v, outcome_kind_draw::INT::DOUBLE AS y, engine_eval_cp_disconnected / 100 AS cp,
  (chooser_elo - disconnected_elo) / 100::DOUBLE AS gap, coalesce(api_speed, 'none') AS speed, engine_eval_cp_disconnected >= -100 AS fair FROM analysis_panel
  WHERE chooser_user_id >= 0 AND disconnected_user_id >= 0 AND outcome_kind_draw IS NOT NULL AND NOT isnan(engine_eval_cp_disconnected) AND engine_eval_cp_disconnected IS NOT NULL AND chooser_elo IS NOT NULL AND disconnected_elo IS NOT NULL AND utc_ms IS NOT NULL)"""


@query(f"WITH {_PANEL} SELECT speed, count(*) AS n, round(avg(y), 6) AS rate, round(sqrt(avg(y) * (1 - avg(y)) / count(*)), 6) AS se FROM p GROUP BY speed")
def rate_table_ci(spark, sf):
    return _panel(spark, sf).groupBy("speed").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"), F.round(F.sqrt(F.avg("y") * (1 - F.avg("y")) / F.count("*")), 6).alias("se"))


def _rounded(spark: SparkSession, rows: list[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(a, round(float(b), 5)) for a, b in rows], "term string, value double")


@query(f"""WITH {_PANEL}, d AS (SELECT u, y - avg(y) OVER g AS y, cp - avg(cp) OVER g AS x FROM p WINDOW g AS (PARTITION BY u)),
  b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(*) AS n, count(DISTINCT u) AS g FROM d),
  s AS (SELECT u, sum(x * (y - b * x)) AS s FROM d, b GROUP BY u)
  SELECT 'coef' AS term, round(b, 5) AS value FROM b UNION ALL SELECT 'se', round(sqrt(sum(s * s) * any_value(g) / (any_value(g) - 1) * (any_value(n) - 1) / (any_value(n) - 1)) / any_value(xx), 5) FROM s, b""")
def ols_fe_within(spark, sf):
    fit = moments.within_ols(_panel(spark, sf), "y", ["cp"], "u")
    return _rounded(spark, [("coef", fit["coef"][0]), ("se", fit["se"][0])])


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    p = _panel(spark, sf)
    mean = p.agg(F.avg("y")).first()[0] or 0.0
    return p.select("u", "v", "month", F.floor(F.col("utc_ms") / 86_400_000).alias("day"), (F.col("y") - mean).alias("s"))


_SCORED = f"{_PANEL}, s AS (SELECT u, v, month, utc_ms // 86400000 AS day, y - avg(y) OVER () AS s FROM p)"


@query(f"""WITH {_SCORED}, f(by_u, v) AS (SELECT 'user', sum(x * x) FROM (SELECT sum(s) AS x FROM s GROUP BY u) UNION ALL SELECT 'month', sum(x * x) FROM (SELECT sum(s) AS x FROM s GROUP BY month) UNION ALL SELECT 'both', sum(x * x) FROM (SELECT sum(s) AS x FROM s GROUP BY u, month))
  SELECT 'user' AS term, round(max(v) FILTER (WHERE by_u = 'user'), 5) AS value FROM f UNION ALL SELECT 'user or month', round(max(v) FILTER (WHERE by_u = 'user') + max(v) FILTER (WHERE by_u = 'month') - max(v) FILTER (WHERE by_u = 'both'), 5) FROM f""")
def cluster_cov(spark, sf):
    s = _scored(spark, sf)
    return _rounded(spark, [("user", moments.cluster_meat(s, ["s"], "u")[0, 0]), ("user or month", moments.cluster_meat(s, ["s"], "u", "month")[0, 0])])


@query(f"""WITH {_SCORED}, r AS (SELECT row_number() OVER () AS i, * FROM s), a AS (SELECT i, u AS p, day, s FROM r UNION SELECT i, v, day, s FROM r),
  q AS (SELECT (SELECT sum(x * x) FROM (SELECT sum(s) x FROM a GROUP BY p)) AS va, (SELECT sum(x * x) FROM (SELECT sum(s) x FROM r WHERE u <> v GROUP BY least(u, v), greatest(u, v))) AS vp,
  (SELECT sum(x * x) FROM (SELECT sum(s) x FROM r GROUP BY day)) AS vd, (SELECT sum(x * x) FROM (SELECT sum(s) x FROM a GROUP BY p, day)) AS vad, (SELECT sum(x * x) FROM (SELECT sum(s) x FROM r WHERE u <> v GROUP BY least(u, v), greatest(u, v), day)) AS vpd)
  SELECT 'account' AS term, round(va - vp, 5) AS value FROM q UNION ALL SELECT 'account or day', round(va - vp + vd - vad + vpd, 5) FROM q""")
def dyadic_cov(spark, sf):
    s = _scored(spark, sf)
    return _rounded(spark, [("account", moments.dyadic_meat(s, "s", "u", "v")), ("account or day", moments.dyadic_meat(s, "s", "u", "v", "day"))])


@query(f"""WITH {_PANEL} SELECT 'first' AS term, round(covar_pop(gap, cp) / var_pop(gap), 5) AS value FROM p UNION ALL SELECT 'reduced', round(covar_pop(gap, y) / var_pop(gap), 5) FROM p""")
def iv_moments(spark, sf):
    fit = moments.iv(_panel(spark, sf), "y", "cp", "gap")
    return _rounded(spark, [("first", fit["first"]), ("reduced", fit["reduced"])])


@query(f"""WITH {_PANEL}, m AS (SELECT avg(gap) AS mz, avg(cp) AS md, avg(y) AS my FROM p), r AS (SELECT u, gap - mz AS z, cp - md AS d, y - my AS y FROM p, m),
  s AS (SELECT sum(z * z) AS zz, sum(z * d) AS zd, sum(z * y) AS zy FROM r), g AS (SELECT u, sum(z * (y - zy / zz * z)) AS a, sum(z * (d - zd / zz * z)) AS b FROM r, s GROUP BY u),
  v AS (SELECT sum(a * a) AS v00, sum(a * b) AS v01, sum(b * b) AS v11 FROM g), q AS (SELECT *, zy / zd AS iv, zd * zd - 3.841458820694124 * v11 AS qa, 2 * (3.841458820694124 * v01 - zy * zd) AS qb, zy * zy - 3.841458820694124 * v00 AS qc FROM s, v)
  SELECT unnest(['first', 'first_se', 'reduced', 'reduced_se', 'iv', 'iv_se', 'pieces', 'low', 'high']) AS term, unnest([round(zd / zz, 5), round(sqrt(v11) / zz, 5), round(zy / zz, 5), round(sqrt(v00) / zz, 5), round(iv, 5), round(sqrt(v00 - 2 * iv * v01 + iv * iv * v11) / abs(zd), 5),
    CASE WHEN qb * qb < 4 * qa * qc THEN CASE WHEN qa > 0 THEN 0 ELSE 1 END WHEN qa > 0 THEN 1 ELSE 2 END, round(least((-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)), 5), round(greatest((-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa), (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)), 5)]) AS value FROM q""")
def iv_weak_set(spark, sf):
    """Clustered standard errors and the Anderson-Rubin set: its number of pieces and finite ends."""
    fit = moments.iv(_panel(spark, sf), "y", "cp", "gap", cluster="u")
    ends = [x for piece in fit["set"] for x in piece if abs(x) != float("inf")]
    terms = [(t, fit[t]) for t in ("first", "first_se", "reduced", "reduced_se", "iv", "iv_se")]
    return _rounded(spark, [*terms, ("pieces", len(fit["set"])), ("low", min(ends, default=float("nan"))), ("high", max(ends, default=float("nan")))])


@query(f"""WITH {_PANEL} SELECT u, v, (sum(count(*)) OVER (PARTITION BY u) - count(*))::BIGINT AS n, round((sum(sum(y)) OVER (PARTITION BY u) - sum(y)) / nullif(sum(count(*)) OVER (PARTITION BY u) - count(*), 0), 6) AS score FROM p GROUP BY u, v""")
def leave_pair_out(spark, sf):
    return scores.pair_excluded_score(_panel(spark, sf), "u", "v", "y").withColumn("score", F.round("score", 6))


_FOLD = lambda c: f"(('0x' || substr(md5({c}::VARCHAR), 1, 8))::BIGINT % 4)::INT"
_FOLDS = "folds AS (SELECT a.f::INT AS jf, b.f::INT AS rf FROM range(4) a(f), range(4) b(f))"


@query(f"""WITH {_PANEL}, {_FOLDS}, b AS (SELECT speed, month, {_FOLD("u")} AS f1, {_FOLD("v")} AS f2, count(*) AS n, sum(y) AS s FROM p GROUP BY ALL),
  o AS (SELECT b.speed, t.month, jf, rf, sum(n) AS n, sum(s) AS s FROM (SELECT DISTINCT month FROM b) t, folds, b WHERE b.month < t.month AND f1 NOT IN (jf, rf) AND f2 NOT IN (jf, rf) GROUP BY ALL),
  w AS (SELECT month, jf, rf, (sum(s) + 0.5) / (sum(n) + 1) AS p FROM o GROUP BY ALL)
  SELECT c.speed, w.month, w.jf, w.rf, round((coalesce(o.s, 0) + 50 * w.p) / (coalesce(o.n, 0) + 50), 6) AS reference FROM w CROSS JOIN (SELECT DISTINCT speed FROM b) c LEFT JOIN o ON o.speed = c.speed AND o.month = w.month AND o.jf = w.jf AND o.rf = w.rf""")
def expanding_reference(spark, sf):
    return scores.expanding_reference(_panel(spark, sf), "u", "v", "speed", "month", "y").withColumn("reference", F.round("reference", 6))


_CUTOFF = 1_717_200_000_000  # June 2024


@query(f"""WITH {_PANEL}, {_FOLDS}, h AS (SELECT u, v, speed || fair::INT::VARCHAR AS c, y, {_FOLD("u")} AS f1, {_FOLD("v")} AS f2 FROM p WHERE utc_ms < {_CUTOFF}),
  o AS (SELECT c, jf, rf, count(*) AS n, sum(y) AS s FROM h, folds WHERE f1 NOT IN (jf, rf) AND f2 NOT IN (jf, rf) GROUP BY ALL), w AS (SELECT jf, rf, (sum(s) + 0.5) / (sum(n) + 1) AS p FROM o GROUP BY ALL),
  m AS (SELECT c.c, w.jf, w.rf, (coalesce(o.s, 0) + 50 * w.p) / (coalesce(o.n, 0) + 50) AS m FROM w CROSS JOIN (SELECT DISTINCT c FROM h) c LEFT JOIN o ON o.c = c.c AND o.jf = w.jf AND o.rf = w.rf),
  q AS (SELECT DISTINCT u, v, {_FOLD("v")} AS rf FROM p WHERE utc_ms >= {_CUTOFF}),
  r AS (SELECT q.u, q.v, count(h.y) FILTER (WHERE h.v <> q.v) AS n, avg(h.y) FILTER (WHERE h.v <> q.v) AS raw, avg(m.m) FILTER (WHERE h.v <> q.v) AS expected, count(DISTINCT h.v) FILTER (WHERE h.v <> q.v) AS counterparts, count(h.y) FILTER (WHERE h.v = q.v) AS pair_removed
    FROM q LEFT JOIN h ON h.u = q.u LEFT JOIN m ON m.c = h.c AND m.jf = h.f1 AND m.rf = q.rf GROUP BY q.u, q.v)
  SELECT u, v, n, round(raw, 6) AS raw, round(expected, 6) AS expected, round(raw - expected, 6) AS adjusted, counterparts, pair_removed FROM r""")
def crossfit_scores(spark, sf):
    """Later pairs scored by what came before the cutoff."""
    p = _panel(spark, sf).withColumn("c", F.concat("speed", F.col("fair").cast("int").cast("string")))
    out = scores.crossfit_scores(p, p.where(F.col("utc_ms") >= _CUTOFF), "u", "v", "utc_ms", "c", "y", _CUTOFF)
    return out.withColumns({c: F.round(c, 6) for c in ("raw", "expected", "adjusted")})


@query(f"""WITH {_PANEL}, c AS (SELECT fair, speed, month, count(*) AS n, avg(y) AS m FROM p GROUP BY ALL), k AS (SELECT speed, month, sum(n) AS w FROM c GROUP BY 1, 2 HAVING min(n) >= 5 AND count(*) = 2),
  j AS (SELECT c.*, k.w FROM c JOIN k USING (speed, month)), r AS (SELECT fair, sum(n)::BIGINT AS n, sum(m * w) / sum(w) AS rate, sum(w) AS total FROM j GROUP BY fair),
  i AS (SELECT p.u, p.fair, sum(j.w / j.n * (p.y - j.m)) AS i FROM p JOIN j USING (fair, speed, month) GROUP BY 1, 2), v AS (SELECT fair, sum(i * i) AS v FROM i GROUP BY 1)
  SELECT fair, r.n, round(rate, 6) AS rate, round(sqrt(v) / total, 6) AS se FROM r JOIN v USING (fair)""")
def standardize_support(spark, sf):
    return scores.standardize(_panel(spark, sf), "fair", ["speed", "month"], "y", "u").withColumns({c: F.round(c, 6) for c in ("rate", "se")})


@query(f"""WITH {_PANEL}, m AS (SELECT speed, count(*) AS n, sum(w) AS w, sum(w * gap) AS x, sum(w * cp) AS y, sum(w * gap * cp) AS xy, sum(w * gap * gap) AS xx, sum(w * cp * cp) AS yy FROM (SELECT *, 1 + y AS w FROM p) t GROUP BY speed)
  SELECT speed, n, round((xy - x * y / w) / sqrt((xx - x * x / w) * (yy - y * y / w)), 5) AS r FROM m""")
def weighted_pearson(spark, sf):
    return _panel(spark, sf).groupBy("speed").agg(F.count("*").alias("n"), F.round(scores.weighted_corr(F.col("gap"), F.col("cp"), 1 + F.col("y")), 5).alias("r"))


@query(f"""WITH {_PANEL}, r AS (SELECT speed, (rank() OVER (PARTITION BY speed ORDER BY gap) + (count(*) OVER (PARTITION BY speed, gap) - 1) / 2.0)::DOUBLE AS a, (rank() OVER (PARTITION BY speed ORDER BY cp) + (count(*) OVER (PARTITION BY speed, cp) - 1) / 2.0)::DOUBLE AS b FROM p)
  SELECT speed, round(corr(a, b), 5) AS rho FROM r GROUP BY speed""")
def spearman(spark, sf):
    p = _panel(spark, sf)
    a, b = (scores.midranks(p, ["speed"], c).withColumnRenamed("rank", f"r_{c}") for c in ("gap", "cp"))
    return p.join(a, ["speed", "gap"]).join(b, ["speed", "cp"]).groupBy("speed").agg(F.round(F.corr("r_gap", "r_cp"), 5).alias("rho"))


@query("""WITH p AS (SELECT DISTINCT game_id, api_speed, ply_count, utc_ms FROM analysis_panel), m AS (SELECT api_speed AS s, median(ply_count) AS m FROM p GROUP BY 1)
  SELECT game_id, utc_ms, round(coalesce(ply_count::DOUBLE, m), 6) AS ply_count_filled, ply_count IS NULL AS ply_count_missing FROM p LEFT JOIN m ON p.api_speed IS NOT DISTINCT FROM m.s""")
def median_impute(spark, sf):
    p = table(spark, sf, "analysis_panel").select("game_id", "api_speed", "ply_count", "utc_ms").distinct()
    return scores.imputed(p, ["api_speed"], ["ply_count"]).select("game_id", "utc_ms", F.round("ply_count_filled", 6).alias("ply_count_filled"), "ply_count_missing")


@query(f"""WITH {_PANEL}, c AS (SELECT speed, month, count(*) FILTER (WHERE fair) AS n1, count(*) FILTER (WHERE NOT fair) AS n0, avg(y) FILTER (WHERE fair) AS m1, avg(y) FILTER (WHERE NOT fair) AS m0 FROM p GROUP BY 1, 2 HAVING n1 > 0 AND n0 > 0),
  i AS (SELECT u, sum(CASE WHEN fair THEN y - m1 ELSE -n1 / n0 * (y - m0) END) AS i FROM p JOIN c USING (speed, month) GROUP BY 1), v AS (SELECT sum(i * i) AS v FROM i)
  SELECT sum(n1)::BIGINT AS n_treated, sum(n0)::BIGINT AS n_control, round(sum((m1 - m0) * n1) / sum(n1), 6) AS effect, round(sqrt(any_value(v)) / sum(n1), 6) AS se, count(*) AS strata FROM c, v""")
def cem_effect(spark, sf):
    return scores.matched_effect(_panel(spark, sf), "fair", ["speed", "month"], "y", "u").withColumns({c: F.round(c, 6) for c in ("effect", "se")})


@query(f"""WITH {_PANEL}, l AS (SELECT fair, 'gap' AS covariate, gap AS v FROM p UNION ALL SELECT fair, 'cp', cp FROM p), m AS (SELECT covariate, avg(v) FILTER (WHERE fair) AS a, avg(v) FILTER (WHERE NOT fair) AS b, sqrt((var_samp(v) FILTER (WHERE fair) + var_samp(v) FILTER (WHERE NOT fair)) / 2) AS sd FROM l GROUP BY 1)
  SELECT covariate, round(a, 5) AS mean_1, round(b, 5) AS mean_0, round((a - b) / sd, 5) AS smd FROM m""")
def balance_smd(spark, sf):
    return scores.balance(_panel(spark, sf), "fair", ["gap", "cp"]).withColumns({c: F.round(c, 5) for c in ("mean_1", "mean_0", "smd")})


@query(f"""WITH {_PANEL} SELECT speed, fair, count(*) AS n, round(sum(gap), 4) AS s_gap, round(sum(y), 4) AS s_y, round(sum(gap * gap), 4) AS s_gap_gap, round(sum(gap * y), 4) AS s_gap_y, round(sum(y * y), 4) AS s_y_y FROM p GROUP BY 1, 2""")
def surface_moments(spark, sf):
    out = scores.surface(_panel(spark, sf), ["speed", "fair"], ["gap"], "y")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.startswith("s_")})


@query(f"""WITH {_PANEL}, t AS (SELECT month, 2 * exp(-abs(avg(y) - 0.23::DOUBLE) / sqrt(0.25::DOUBLE / count(*))) AS p FROM p GROUP BY 1), r AS (SELECT month, p, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, month) + 1) * p) AS q FROM t)
  SELECT month, round(max(q) OVER (ORDER BY p, month ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""")
def holm_adjust(spark, sf):
    rows = _panel(spark, sf).groupBy("month").agg((2 * F.exp(-F.abs(F.avg("y") - 0.23) / F.sqrt(F.lit(0.25) / F.count("*")))).alias("p")).orderBy("p", "month").collect()  # one row a month
    return spark.createDataFrame([(r.month, round(a, 6)) for r, a in zip(rows, moments.holm([r.p for r in rows]), strict=True)], "month string, adjusted double")


_GROW = "(1 / (1 + exp(-(b0 + b1 * cp + b2 * gap))))"


@query(f"""WITH RECURSIVE {_PANEL}, c AS (SELECT round(cp) AS cp, round(gap) AS gap, count(*) AS n, sum(y) AS k FROM p GROUP BY 1, 2),
  it(i, b0, b1, b2, e0, e1, e2) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
    SELECT i + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det, sqrt(c00 / det), sqrt(c11 / det), sqrt(c22 / det) FROM (
      SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (
        SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM (
          SELECT any_value(i) AS i, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(k - n * q) AS g0, sum(cp * (k - n * q)) AS g1, sum(gap * (k - n * q)) AS g2,
            sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * cp) AS h01, sum(n * q * (1 - q) * gap) AS h02, sum(n * q * (1 - q) * cp * cp) AS h11, sum(n * q * (1 - q) * cp * gap) AS h12, sum(n * q * (1 - q) * gap * gap) AS h22
          FROM (SELECT *, {_GROW} AS q FROM it, c WHERE i < 30) x) y) z) w WHERE i IS NOT NULL)
  SELECT unnest(['coef_0', 'coef_1', 'coef_2', 'se_0', 'se_1', 'se_2']) AS term, unnest([round(b0, 5), round(b1, 5), round(b2, 5), round(e0, 5), round(e1, 5), round(e2, 5)]) AS value FROM it WHERE i = 30""")
def logit_cells(spark, sf):
    c = _panel(spark, sf).groupBy(F.round("cp").alias("cp"), F.round("gap").alias("gap")).agg(F.count("*").alias("n"), F.sum("y").alias("k"))
    fit = likelihood.logit(c, "n", "k", ["cp", "gap"])
    return _rounded(spark, [(f"{t}_{i}", x) for t in ("coef", "se") for i, x in enumerate(fit[t])])


@query(f"""WITH RECURSIVE {_PANEL}, a(i, u, month, y, x) AS (SELECT 0, u, month, y, fair::INT::DOUBLE FROM p UNION ALL
    SELECT i + 1, u, month, y - avg(y) OVER (PARTITION BY month), x - avg(x) OVER (PARTITION BY month) FROM (SELECT i, u, month, y - avg(y) OVER (PARTITION BY u) AS y, x - avg(x) OVER (PARTITION BY u) AS x FROM a WHERE i < 40) z)
  SELECT 'coef' AS term, round(sum(x * y) / sum(x * x), 5) AS value FROM a WHERE i = 40""")
def fixed_effects(spark, sf):
    """Outcome on the evaluation with chooser and month effects."""
    p = _panel(spark, sf).withColumn("fair", F.col("fair").cast("double"))
    return _rounded(spark, [("coef", effects.effects_ols(p, "y", ["fair"], ["u", "month"])["coef"][0])])


@query()
def cond_logit(spark, sf):
    p = _panel(spark, sf).withColumn("stratum", F.concat_ws("|", "u", "month"))
    return likelihood.result_frame(spark, likelihood.conditional_logit(p, "stratum", "y", ["cp"]))


_TYPE = lambda t: f"(ln(greatest(s{t}, 1e-300)) + k * ln(r{t}) + (n - k) * ln(1 - r{t}))"


@query(f"""WITH RECURSIVE {_PANEL}, c AS (SELECT n, k, count(*) AS c FROM (SELECT u, count(*) AS n, sum(y) AS k FROM p GROUP BY u) e GROUP BY 1, 2), total AS (SELECT sum(c) AS t FROM c),
  it(s, i, s0, s1, r0, r1, l, stop) AS (SELECT s, 0, 0.5::DOUBLE, 0.5::DOUBLE, greatest(0.02, (0.5 + 0.3 * (s - 1) / 3) / 2)::DOUBLE, ((1.5 + 0.3 * (s - 1) / 3) / 2)::DOUBLE, -1e300::DOUBLE, false FROM (VALUES (0), (1), (2)) v(s) UNION ALL
    SELECT s, i + 1, w0 / t, w1 / t, least(greatest(k0 / n0, 1e-6), 1 - 1e-6), least(greatest(k1 / n1, 1e-6), 1 - 1e-6), ll, ll - l < 1e-8 * abs(ll) FROM (
      SELECT s, any_value(i) AS i, any_value(l) AS l, sum(c * (ln(e0 + e1) + top)) AS ll, sum(c * e0 / (e0 + e1)) AS w0, sum(c * e1 / (e0 + e1)) AS w1, sum(c * e0 / (e0 + e1) * k) AS k0, sum(c * e1 / (e0 + e1) * k) AS k1, sum(c * e0 / (e0 + e1) * n) AS n0, sum(c * e1 / (e0 + e1) * n) AS n1 FROM (
        SELECT *, exp(l0 - top) AS e0, exp(l1 - top) AS e1 FROM (SELECT *, greatest(l0, l1) AS top FROM (SELECT it.*, c.*, {_TYPE(0)} AS l0, {_TYPE(1)} AS l1 FROM it, c WHERE NOT stop AND i < 2000) a) b) d GROUP BY s) f, total),
  best AS (SELECT * FROM it WHERE stop ORDER BY l DESC, s LIMIT 1)
  SELECT unnest(['loglik', 'share_0', 'share_1', 'rate_0', 'rate_1', 'bic']) AS term,
    unnest([round(l, 2), round(CASE WHEN r0 <= r1 THEN s0 ELSE s1 END, 3), round(CASE WHEN r0 <= r1 THEN s1 ELSE s0 END, 3), round(least(r0, r1), 3), round(greatest(r0, r1), 3), round(-2 * l + 3 * ln(t), 2)]) AS value FROM best, total""")
def mixture_em(spark, sf):
    e = _panel(spark, sf).groupBy("u").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("k"))
    fit = likelihood.binomial_mixture(e, "n", "k", 2)
    rows = [("loglik", fit["loglik"], 2), *((f"{t}_{i}", x, 3) for t in ("share", "rate") for i, x in enumerate(fit[t])), ("bic", fit["bic"], 2)]
    return spark.createDataFrame([(t, round(float(x), d)) for t, x, d in rows], "term string, value double")


@query()
def mixture_bootstrap(spark, sf):
    """Ten hashed bootstrap draws of the mixture, their types in the order of the whole fit's, with bic and icl."""
    e = _panel(spark, sf).groupBy("u").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("k"))
    fits = likelihood.bootstrap_mixture(e, "n", "k", "u", 2, 10)
    return spark.createDataFrame([(d, *map(float, (*f["share"], *f["rate"], f["bic"], f["icl"]))) for d, f in enumerate(fits, 1)], "draw int, share_0 double, share_1 double, rate_0 double, rate_1 double, bic double, icl double")


@query()
def random_effects(spark, sf):
    e = _panel(spark, sf).groupBy("u").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("k"))
    return likelihood.result_frame(spark, likelihood.random_intercept(e, "n", "k"))


@query()
def hmm_states(spark, sf):
    return likelihood.result_frame(spark, likelihood.hidden_states(_panel(spark, sf), "u", ["utc_ms", "game_id"], "y"))


_HASH = lambda x: f"((((a * {x} + b) % 2147483647 * {x} + c) % 2147483647 * {x} + d) % 2147483647)"
_NUMBER = lambda x: f"(('0x' || substr(md5({x}::VARCHAR), 1, 15))::BIGINT % 2147483647)"
_LAW = "law AS (SELECT draw::INT AS draw, " + ", ".join(f"('0x' || substr(md5('1|' || draw || '|{j}'), 1, 15))::BIGINT % 2147483647 AS {c}" for j, c in enumerate("abcd")) + " FROM range(1, 101) r(draw))"


@query(f"""WITH RECURSIVE {_PANEL}, c AS (SELECT u, month, sum(y) AS k, avg(gap) AS gap FROM p GROUP BY 1, 2), it(i, b, se) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE UNION ALL
    SELECT i + 1, b + g / h, 1 / sqrt(h) FROM (SELECT any_value(i) AS i, any_value(b) AS b, sum(bb - y * a / w) AS g, sum(y * (hh / w - a * a / w / w)) AS h FROM (
      SELECT u, any_value(i) AS i, any_value(b) AS b, sum(k) AS y, sum(exp(b * gap)) AS w, sum(exp(b * gap) * gap) AS a, sum(k * gap) AS bb, sum(exp(b * gap) * gap * gap) AS hh FROM it, c WHERE i < 25 GROUP BY u HAVING sum(k) > 0) o) z WHERE i IS NOT NULL)
  SELECT unnest(['coef', 'se']) AS term, unnest([round(b, 5), round(se, 5)]) AS value FROM it WHERE i = 25""")
def poisson_effects(spark, sf):
    c = _panel(spark, sf).groupBy("u", "month").agg(F.sum("y").alias("k"), F.avg("gap").alias("gap"))
    fit = likelihood.effect_poisson(c, "u", "k", ["gap"])
    return _rounded(spark, [("coef", fit["coef"][0]), ("se", fit["se"][0])])


@query(f"""WITH RECURSIVE {_PANEL}, it(i, u, a) AS (SELECT DISTINCT 0, u, 0::DOUBLE FROM p UNION ALL
    SELECT i + 1, u, a + greatest(-2, least(2, (s + 1 - g - 2 * q) / (h + 2 * q * (1 - q)))) FROM (SELECT any_value(i) AS i, it.u AS u, any_value(a) AS a, any_value(1 / (1 + exp(-a))) AS q, sum(y) AS s, sum(1 / (1 + exp(-(gap + a)))) AS g, sum(1 / (1 + exp(-(gap + a))) * (1 - 1 / (1 + exp(-(gap + a))))) AS h FROM it JOIN p ON p.u = it.u WHERE i < 30 GROUP BY it.u) z)
  SELECT u, count(*) AS n, round(any_value(a), 6) AS intercept FROM it JOIN p USING (u) WHERE i = 30 GROUP BY u""")
def calibrated(spark, sf):
    return likelihood.calibrate(_panel(spark, sf), "u", "gap", "y").withColumn("intercept", F.round("intercept", 6))


@query(f"""WITH {_PANEL}, {_LAW}, own AS (SELECT u, count(*) AS n, sum(y) AS s, {_NUMBER("u")} AS x FROM p GROUP BY u), w AS (SELECT draw, n, s, ({_HASH("x")} + 0.5::DOUBLE) / 2147483647 AS q FROM own, law),
  v AS (SELECT draw, n, s, {" + ".join(f"(q > {sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))!r})::INT" for k in range(9))} AS w FROM w)
  SELECT draw, round(sum(w * s) / nullif(sum(w * n), 0), 6) AS estimate FROM v GROUP BY draw""")
def bootstrap_draws(spark, sf):
    return scores.bootstrap(_panel(spark, sf), "u", "y", 100).withColumn("estimate", F.round("estimate", 6))


@query(f"""WITH {_PANEL}, {_LAW}, x AS (SELECT speed, month, fair, game_id, y, {_NUMBER("game_id")} AS x FROM p), h AS (SELECT draw, speed, month, fair, game_id, y, {_HASH("x")} AS h FROM x, law),
  o AS (SELECT draw, speed, month, fair, y, row_number() OVER (PARTITION BY draw, speed, month, fair ORDER BY h, game_id, y) AS k FROM h), n AS (SELECT speed, month, least(count(*) FILTER (WHERE fair), count(*) FILTER (WHERE NOT fair)) AS pairs FROM p GROUP BY 1, 2)
  SELECT draw, count(*) FILTER (WHERE fair) AS pairs, round(sum(CASE WHEN fair THEN y ELSE -y END) / count(*) FILTER (WHERE fair), 6) AS effect FROM o JOIN n USING (speed, month) WHERE k <= pairs GROUP BY draw""")
def rematch_draws(spark, sf):
    return scores.rematch(_panel(spark, sf), ["speed", "month"], "game_id", "fair", "y", 100).withColumn("effect", F.round("effect", 6))


@query(f"""WITH {_PANEL}, {_LAW}, x AS (SELECT u, game_id, y, cp, sum(y) OVER (PARTITION BY u) AS most, {_NUMBER("game_id")} AS x FROM p), o AS (SELECT draw, cp, most, row_number() OVER (PARTITION BY draw, u ORDER BY {_HASH("x")}, game_id, cp) AS k FROM x, law)
  SELECT 0 AS draw, round(sum(cp) FILTER (WHERE y = 1), 4) AS statistic FROM p UNION ALL SELECT draw, round(sum(cp) FILTER (WHERE k <= most), 4) FROM o GROUP BY draw""")
def randomization_law(spark, sf):
    return scores.randomized(_panel(spark, sf), "u", "y", "cp", "game_id", 100).withColumn("statistic", F.round("statistic", 4))


@query(f"""WITH {_PANEL}, d AS (SELECT u, y - avg(y) OVER g AS y, cp - avg(cp) OVER g AS a, gap - avg(gap) OVER g AS b FROM p WINDOW g AS (PARTITION BY u)),
  m AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS yb, count(*) AS n, count(DISTINCT u) AS g FROM d), c AS (SELECT *, (bb * ay - ab * yb) / (aa * bb - ab * ab) AS p1, (aa * yb - ab * ay) / (aa * bb - ab * ab) AS p2 FROM m),
  s AS (SELECT u, sum(a * (y - p1 * a - p2 * b)) AS s1, sum(b * (y - p1 * a - p2 * b)) AS s2 FROM d, c GROUP BY u), v AS (SELECT sum(s1 * s1) AS v11, sum(s1 * s2) AS v12, sum(s2 * s2) AS v22 FROM s),
  w AS (SELECT g / (g - 1) * (n - 1) / (n - 2) AS k, p1 * aa + p2 * ab AS t1, p1 * ab + p2 * bb AS t2, * FROM c, v), z AS (SELECT (t1 * (v22 * t1 - v12 * t2) + t2 * (v11 * t2 - v12 * t1)) / (v11 * v22 - v12 * v12) / k AS stat FROM w)
  SELECT unnest(['statistic', 'rank', 'p']) AS term, unnest([round(stat, 3), 2, round(exp(-stat / 2), 5)]) AS value FROM z""")
def joint_wald(spark, sf):
    """Both slopes of a regression with chooser effects tested at once."""
    fit = moments.within_ols(_panel(spark, sf), "y", ["cp", "gap"], "u")
    stat, rank, p = moments.wald(fit["coef"], fit["cov"])
    return spark.createDataFrame([("statistic", round(stat, 3)), ("rank", float(rank)), ("p", round(p, 5))], "term string, value double")


@query(f"""WITH {_PANEL}, d AS (SELECT u, y - avg(y) OVER g AS y, cp - avg(cp) OVER g AS x FROM p WINDOW g AS (PARTITION BY u)), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx, count(DISTINCT u) AS g FROM d),
  s AS (SELECT u, sum(x * (y - b * x)) AS s FROM d, b GROUP BY u), e AS (SELECT any_value(b) AS b, sqrt(sum(s * s) * any_value(g) / (any_value(g) - 1)) / any_value(xx) AS se FROM s, b)
  SELECT abs(b) + 1.6448536269514722 * se < 0.02 AS equivalent, round(2.801585218112969 * se, 6) AS mde FROM e""")
def equivalence_test(spark, sf):
    """Two one-sided tests of the slope within +-0.02, and the least effect found with power 0.8."""
    fit = moments.within_ols(_panel(spark, sf), "y", ["cp"], "u")
    out = moments.equivalence(float(fit["coef"][0]), float(fit["se"][0]), 0.02)
    return spark.createDataFrame([(bool(out["equivalent"]), round(float(out["mde"]), 6))], "equivalent boolean, mde double")


_READINGS = "SELECT DISTINCT m.row_id, m.rev, m.adjusted_all_time AS a, c.adjusted_all_time AS b FROM scores_main m JOIN scores_copy c ON c.row_id = m.row_id AND c.rev = m.rev WHERE NOT isnan(m.adjusted_all_time) AND NOT isnan(c.adjusted_all_time)"


@query(f"WITH r AS ({_READINGS}) SELECT round(2 * covar_samp(a, b) / (var_samp(a) + var_samp(b)), 6) AS reliability FROM r")
def eiv_reliability(spark, sf):
    m, c = (table(spark, sf, t).select("row_id", "rev", F.col("adjusted_all_time").alias(n)).where(f"{n} is not null and not isnan({n})") for t, n in (("scores_main", "a"), ("scores_copy", "b")))
    return spark.createDataFrame([(round(moments.reliability(m.join(c, ["row_id", "rev"]).distinct(), "a", "b"), 6),)], "reliability double")


@query(f"""WITH {_SCORED}, f AS (SELECT *, s * (month < '2024-01')::INT AS early, s * (month >= '2024-01')::INT AS late FROM s), a AS (SELECT u, sum(early) AS x FROM f WHERE month < '2024-01' GROUP BY u), b AS (SELECT u, sum(late) AS x FROM f WHERE month >= '2024-01' GROUP BY u)
  SELECT round(sum(a.x * b.x), 5) AS covariance, count(*) AS shared FROM a JOIN b USING (u)""")
def cross_model_covariance(spark, sf):
    """Covariance of two periods' score sums over the users that both have."""
    s = _scored(spark, sf)
    early, late = s.where("month < '2024-01'"), s.where("month >= '2024-01'")
    shared = early.select("u").distinct().join(late.select("u").distinct(), "u").count()
    return spark.createDataFrame([(round(float(moments.joint_meat(early, late, "u", ["s"], ["s"])[0, 0]), 5), shared)], "covariance double, shared long")


@query(f"""WITH {_PANEL}, m AS (SELECT avg(gap) AS mid FROM p), c AS (SELECT speed, fair, count(*) AS n, regr_slope(y, gap) AS slope, regr_intercept(y, gap) AS base FROM p GROUP BY 1, 2)
  SELECT speed, fair, n, round(base, 5) AS base, round(slope, 5) AS slope, round(base + slope * mid, 5) AS standardized FROM c, m""")
def surface_standardized(spark, sf):
    """Each cell's line over the rating gap, read at the mean gap of all rows."""
    fits = scores.surface_fits(_panel(spark, sf), ["speed", "fair"], ["gap"], "y")
    return fits.select("speed", "fair", "n", F.round(F.col("coefficients")[0], 5).alias("base"), F.round(F.col("coefficients")[1], 5).alias("slope"), F.round("standardized", 5).alias("standardized"))


@query(f"""WITH {_PANEL}, c AS (SELECT speed, regr_slope(y, gap) AS b, regr_intercept(y, gap) - 0.23 AS a FROM p GROUP BY 1)
  SELECT speed, CASE WHEN -a / b BETWEEN -20 AND 20 THEN round(-a / b, 3) END AS root, CASE WHEN -a / b BETWEEN -20 AND 20 THEN 'one root' ELSE 'no root' END AS status FROM c""")
def indifference_roots(spark, sf):
    """The rating gap at which a speed's line reaches a rate of 0.23, within +-20."""
    out = []
    for r in scores.surface_fits(_panel(spark, sf), ["speed"], ["gap"], "y").where("coefficients is not null").collect():  # one row a speed
        found, status = scores.roots([r.coefficients[0] - 0.23, r.coefficients[1]], -20, 20)
        out.append((r.speed, round(found[0], 3) if found else None, status))
    return spark.createDataFrame(out, "speed string, root double, status string")


@query(f"""WITH {_PANEL}, c AS (SELECT game_id, utc_ms, cp, greatest(cp + 3, 0)^3 AS a, greatest(cp, 0)^3 AS b, greatest(cp - 3, 0)^3 AS c FROM p)
  SELECT game_id, utc_ms, CASE WHEN cp = 0 THEN 0 ELSE round(cp, 6) END AS b0, CASE WHEN cp <= -3 THEN 0 ELSE round((a - c) / 6 - (b - c) / 3, 4) END AS b1 FROM c""")
def spline_basis(spark, sf):
    b = scores.spline(F.col("cp"), [-3.0, 0.0, 3.0])
    return _panel(spark, sf).select("game_id", "utc_ms", F.round(b[0], 6).alias("b0"), (F.round(b[1], 4) + 0.0).alias("b1"))


@query(f"""WITH {_PANEL}, d AS (SELECT u, game_id, y - avg(y) OVER g AS y, cp - avg(cp) OVER g AS x FROM p WINDOW g AS (PARTITION BY u)), b AS (SELECT sum(x * y) / sum(x * x) AS b, sum(x * x) AS xx FROM d)
  SELECT u, round(1e6 * sum(x * (y - b * x)) / any_value(xx), 3) AS influence FROM d, b GROUP BY u""")
def influence_frame(spark, sf):
    """What each chooser adds to the slope, in millionths."""
    rows = moments.influence(_panel(spark, sf), "y", "cp", "u")
    return rows.groupBy("u").agg((F.round(F.sum("influence") * 1e6, 3) + 0.0).alias("influence"))


@query(f"""WITH {_PANEL}, s AS (SELECT regr_slope(y, gap) AS sy, regr_slope(cp, gap) AS sc, avg(gap) AS mg, avg(y) AS my, avg(cp) AS mc FROM p)
  SELECT game_id, utc_ms, round(y - my - sy * (gap - mg), 6) AS r_y, round(cp - mc - sc * (gap - mg), 6) AS r_cp FROM p, s""")
def partialled(spark, sf):
    """Outcome and evaluation less what the rating gap explains."""
    out = moments.partial_out(_panel(spark, sf), ["y", "cp"], ["gap"])
    return out.select("game_id", "utc_ms", F.round("r_y", 6).alias("r_y"), F.round("r_cp", 6).alias("r_cp"))


_MEET = f"""m AS (SELECT a.game_id, a.utc_ms, a.u, a.v, a.y, abs(a.gap) AS cp, (SELECT count(*) FROM p b WHERE b.u = a.u AND b.v = a.v AND b.utc_ms < a.utc_ms AND b.utc_ms >= a.utc_ms - {90 * 86_400_000}) AS k FROM p a), f AS (SELECT y, cp, ln(1 + k) AS gap FROM m)"""


@query(f"""WITH RECURSIVE {_PANEL}, {_MEET}, c AS (SELECT cp, gap, count(*) AS n, sum(y) AS k FROM f GROUP BY 1, 2),
  it(i, b0, b1, b2) AS (SELECT 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE UNION ALL
    SELECT i + 1, b0 + (c00 * g0 + c01 * g1 + c02 * g2) / det, b1 + (c01 * g0 + c11 * g1 + c12 * g2) / det, b2 + (c02 * g0 + c12 * g1 + c22 * g2) / det FROM (
      SELECT *, h00 * c00 + h01 * c01 + h02 * c02 AS det FROM (
        SELECT *, h11 * h22 - h12 * h12 AS c00, h02 * h12 - h01 * h22 AS c01, h01 * h12 - h02 * h11 AS c02, h00 * h22 - h02 * h02 AS c11, h01 * h02 - h00 * h12 AS c12, h00 * h11 - h01 * h01 AS c22 FROM (
          SELECT any_value(i) AS i, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(k - n * q) AS g0, sum(cp * (k - n * q)) AS g1, sum(gap * (k - n * q)) AS g2,
            sum(n * q * (1 - q)) AS h00, sum(n * q * (1 - q) * cp) AS h01, sum(n * q * (1 - q) * gap) AS h02, sum(n * q * (1 - q) * cp * cp) AS h11, sum(n * q * (1 - q) * cp * gap) AS h12, sum(n * q * (1 - q) * gap * gap) AS h22
          FROM (SELECT *, {_GROW} AS q FROM it, c WHERE i < 30) x) y) z) w WHERE i IS NOT NULL)
  SELECT unnest(['intercept', 'absolute_gap', 'log_prior_meetings']) AS term, unnest([round(b0, 5), round(b1, 5), round(b2, 5)]) AS value FROM it WHERE i = 30""")
def prediction_fit(spark, sf):
    """Logit of the outcome on the size of the gap and the pair's meetings of the last 90 days."""
    p = _panel(spark, sf).select("game_id", "utc_ms", "u", "v", "y", "gap", "cp")
    met = window_counts(p, p, ["u", "v"], ["game_id", "utc_ms", "u", "v", "y", "gap", "cp"], "utc_ms", "utc_ms", {"k": (-90 * 86_400_000, 0)})
    cells = met.groupBy(F.abs("gap").alias("absolute_gap"), F.log1p("k").alias("log_prior")).agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    fit = likelihood.logit(cells, "n", "s", ["absolute_gap", "log_prior"])
    return _rounded(spark, list(zip(("intercept", "absolute_gap", "log_prior_meetings"), fit["coef"], strict=True)))


# Contracts ------------------------------------------------------------------------


@query("SELECT row_id, rev, count(*) AS copies FROM scores_main GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf):
    return contracts.duplicate_keys(table(spark, sf, "scores_main"), ["row_id", "rev"])


@query("""SELECT row_id, 'left' AS side FROM (SELECT row_id FROM exposures EXCEPT SELECT row_id FROM scores_main) UNION ALL SELECT row_id, 'right' FROM (SELECT row_id FROM scores_main EXCEPT SELECT row_id FROM exposures)""")
def coverage_full_join(spark, sf):
    return contracts.coverage(table(spark, sf, "exposures"), table(spark, sf, "scores_main"), ["row_id"])


@query("""SELECT 0 AS step, 'all' AS screen, count(*) AS kept FROM analysis_panel UNION ALL SELECT 1, 'user', count(*) FILTER (WHERE chooser_user_id >= 0) FROM analysis_panel
  UNION ALL SELECT 2, 'evaluated', count(*) FILTER (WHERE chooser_user_id >= 0 AND engine_eval_cp_disconnected IS NOT NULL) FROM analysis_panel
  UNION ALL SELECT 3, 'long', count(*) FILTER (WHERE chooser_user_id >= 0 AND engine_eval_cp_disconnected IS NOT NULL AND ply_count >= 10) FROM analysis_panel""")
def flow_table(spark, sf):
    return contracts.flow(table(spark, sf, "analysis_panel"), {"user": F.col("chooser_user_id") >= 0, "evaluated": F.col("engine_eval_cp_disconnected").isNotNull(), "long": F.col("ply_count") >= 10})


@query("""WITH a AS (SELECT row_id, sum(n_all_time)::BIGINT AS "old" FROM scores_main GROUP BY 1), b AS (SELECT row_id, sum(n_all_time)::BIGINT AS "new" FROM scores_copy GROUP BY 1)
  SELECT row_id, "old", "new" FROM a FULL JOIN b USING (row_id) WHERE "old" IS NULL OR "new" IS NULL OR abs("old" - "new") > 0.5""")
def bridge_tolerance(spark, sf):
    return contracts.bridge(table(spark, sf, "scores_main"), table(spark, sf, "scores_copy"), ["row_id"], "n_all_time", 0.5)


@query("""SELECT 'lang' AS "column", count(*) FILTER (WHERE lang IS NULL) AS nulls, 0::BIGINT AS nans, count(*) FILTER (WHERE trim(lang) = '') AS blanks FROM documents
  UNION ALL SELECT 'n_chars', count(*) FILTER (WHERE n_chars IS NULL), 0, 0 FROM documents UNION ALL SELECT 'author_id', count(*) FILTER (WHERE author_id IS NULL), 0, 0 FROM documents""")
def quality_census(spark, sf):
    return contracts.census(table(spark, sf, "documents"), ["lang", "n_chars", "author_id"])


@query("""SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(chooser >= 0, false) THEN 'user' WHEN NOT coalesce(t >= start_ms, false) THEN 'times' WHEN NOT coalesce(fair, false) THEN 'fair' ELSE 'kept' END AS disposition FROM decisions) GROUP BY 1""")
def dispositions(spark, sf):
    rules = {"user": F.col("chooser") >= 0, "times": F.col("t") >= F.col("start_ms"), "fair": F.col("fair")}
    return table(spark, sf, "decisions").groupBy(contracts.disposition(rules).alias("disposition")).agg(F.count("*").alias("n"))
