"""Queries with the temporal operators: as-of, range, sessions, outcomes, series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerwake.operators import temporal as op
from ledgerwake.operators.anomaly import Baseline, observed_grid, seasonal_scores
from ledgerwake.operators.contracts import conflicts, nested
from ledgerwake.functions import columns as cols
from ledgerwake.operators.skew import exact_quantiles, row_ids, running_labels
from ledgerwake.session import table
from ledgerwake.stats.scores import cumulative, midranks

DAY = 86_400_000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "exposures").where("recipient_id is not null and anchor_ms is not null").select("row_id", "recipient_id", "opponent_id", "anchor_ms").distinct()


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda c: F.struct(F.col(f"{c}_id").alias("player"), F.col(f"{c}_elo").alias("elo"))
    return table(spark, sf, "chronology").where("utc_ms is not null").select("game_id", "utc_ms", "archive_ordinal", F.explode(F.array(side("white"), side("black"))).alias("x")).select("game_id", "utc_ms", "archive_ordinal", "x.*").distinct()


def _games(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chronology").where("utc_ms is not null").groupBy("game_id", "white_id", "black_id", "utc_ms").agg(F.min("archive_ordinal").alias("ord"), F.max("result_code").alias("result_code"))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "decisions").where("chooser >= 0 and t is not null").select("gid", "chooser", "counterparty", "start_ms", "t", "ord", "fair", "y").distinct()


_ASKED = "asked AS (SELECT DISTINCT row_id, recipient_id, opponent_id, anchor_ms FROM exposures WHERE recipient_id IS NOT NULL AND anchor_ms IS NOT NULL)"
_SIDES = """sides AS (SELECT DISTINCT game_id, utc_ms, archive_ordinal, white_id AS player, white_elo AS elo FROM chronology WHERE utc_ms IS NOT NULL
  UNION SELECT DISTINCT game_id, utc_ms, archive_ordinal, black_id, black_elo FROM chronology WHERE utc_ms IS NOT NULL)"""
_GAMES = "games AS (SELECT game_id, white_id, black_id, utc_ms, min(archive_ordinal) AS ord, max(result_code) AS result_code FROM chronology WHERE utc_ms IS NOT NULL GROUP BY ALL)"
_DECIDED = "decided AS (SELECT DISTINCT gid, chooser, counterparty, start_ms, t, ord, fair, y FROM decisions WHERE chooser >= 0 AND t IS NOT NULL)"


def _asof_sql(sign: str, order: str) -> str:
    return f"""WITH {_ASKED}, {_SIDES} SELECT a.row_id, a.anchor_ms, s.utc_ms AS near_ms, s.elo FROM asked a LEFT JOIN sides s ON s.player = a.recipient_id AND s.utc_ms {sign} a.anchor_ms
      QUALIFY row_number() OVER (PARTITION BY a.row_id, a.anchor_ms, a.recipient_id, a.opponent_id ORDER BY s.utc_ms {order}, s.archive_ordinal {order}, s.elo DESC) = 1"""


def _asof(spark: SparkSession, sf: str, direction: str, strict: bool) -> DataFrame:
    out = op.asof_join(_asked(spark, sf).withColumnRenamed("recipient_id", "player"), _sides(spark, sf), ["player"], "anchor_ms", "utc_ms", ["elo"], "archive_ordinal", direction, strict)
    return out.select("row_id", "anchor_ms", F.col("asof_utc_ms").alias("near_ms"), F.col("asof_elo").alias("elo"))


@query(_asof_sql("<", "DESC"))
def asof_back_strict(spark, sf):
    return _asof(spark, sf, "backward", True)


@query(_asof_sql("<=", "DESC"))
def asof_back_inclusive(spark, sf):
    return _asof(spark, sf, "backward", False)


@query(_asof_sql(">", "ASC"))
def asof_fwd_strict(spark, sf):
    return _asof(spark, sf, "forward", True)


@query(f"""WITH {_DECIDED}, tied AS (SELECT chooser, t, count(*) AS n FROM decided GROUP BY 1, 2), run AS (SELECT *, sum(n) OVER (PARTITION BY chooser ORDER BY t)::BIGINT AS upto FROM tied)
  SELECT e.row_id, coalesce(r.upto, 0) AS earlier FROM (SELECT DISTINCT row_id, opponent_id, anchor_ms FROM exposures WHERE opponent_id IS NOT NULL AND anchor_ms IS NOT NULL) e
  ASOF LEFT JOIN run r ON r.chooser = e.opponent_id AND e.anchor_ms > r.t""")
def asof_tied(spark, sf):
    """Decisions of the opponent before the anchor: ties are collapsed, then looked up."""
    asked = table(spark, sf, "exposures").where("opponent_id is not null and anchor_ms is not null").select("row_id", F.col("opponent_id").alias("chooser"), "anchor_ms").distinct()
    return op.window_counts(asked, _decided(spark, sf), ["chooser"], ["row_id", "anchor_ms"], "anchor_ms", "t", {"earlier": (-(10**13), 0)}).drop("anchor_ms")


@query(f"""WITH {_ASKED}, {_SIDES}, lags AS (SELECT a.row_id, k.lag, a.anchor_ms - k.lag * 7 * {DAY} AS cut, a.recipient_id FROM asked a, range(4) k(lag))
  SELECT l.row_id, l.lag, s.elo FROM lags l LEFT JOIN sides s ON s.player = l.recipient_id AND s.utc_ms < l.cut
  QUALIFY row_number() OVER (PARTITION BY l.row_id, l.lag, l.cut, l.recipient_id ORDER BY s.utc_ms DESC, s.archive_ordinal DESC, s.elo DESC) = 1""")
def asof_multi_lag(spark, sf):
    lags = _asked(spark, sf).select("row_id", F.col("recipient_id").alias("player"), "anchor_ms", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("lag"))
    lags = lags.withColumn("cut", F.col("anchor_ms") - F.col("lag") * 7 * DAY)
    return op.asof_join(lags, _sides(spark, sf), ["player"], "cut", "utc_ms", ["elo"], "archive_ordinal").select("row_id", F.col("lag").cast("long").alias("lag"), F.col("asof_elo").alias("elo"))


@query(f"""WITH w AS (SELECT DISTINCT game_id AS focal, utc_ms AS lo, utc_ms + 60000 AS hi FROM analysis_panel WHERE utc_ms IS NOT NULL), {_GAMES}
  SELECT focal, count(*) AS n FROM w JOIN games g ON g.utc_ms >= w.lo AND g.utc_ms < w.hi GROUP BY focal""")
def range_join_windows(spark, sf):
    spans = table(spark, sf, "analysis_panel").where("utc_ms is not null").select(F.col("game_id").alias("focal"), F.col("utc_ms").alias("lo"), (F.col("utc_ms") + 60_000).alias("hi")).distinct()
    return op.range_join(_games(spark, sf), spans, "utc_ms", "lo", "hi", 60_000).groupBy("focal").agg(F.count("*").alias("n"))


_SPANS = {"prior_7d": (-7 * DAY, 0), "prior_30d": (-30 * DAY, 0), "lagged": (-97 * DAY, -7 * DAY), "later_30d": (1, 30 * DAY + 1)}


def _counts_sql(rows: str, events: str, on: str, at: str, t: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE e.{t} >= q.{at} + {a} AND e.{t} < q.{at} + {b}) AS {n}" for n, (a, b) in _SPANS.items())
    return f"SELECT q.row_id, {counts} FROM {rows} q LEFT JOIN {events} e ON {on} GROUP BY q.row_id, q.{at}"


@query(f"WITH {_ASKED}, {_SIDES}, one AS (SELECT DISTINCT player, game_id, utc_ms FROM sides) " + _counts_sql("(SELECT DISTINCT row_id, recipient_id, anchor_ms FROM asked)", "one", "e.player = q.recipient_id", "anchor_ms", "utc_ms"))
def prefix_window_counts(spark, sf):
    games = _sides(spark, sf).select("player", "game_id", "utc_ms").distinct()
    asked = _asked(spark, sf).select("row_id", F.col("recipient_id").alias("player"), "anchor_ms")
    return op.window_counts(asked, games, ["player"], ["row_id", "anchor_ms"], "anchor_ms", "utc_ms", _SPANS).drop("anchor_ms")


@query(f"WITH {_ASKED}, {_GAMES}, p AS (SELECT *, least(white_id, black_id) AS a, greatest(white_id, black_id) AS b FROM games) " + _counts_sql("(SELECT DISTINCT row_id, anchor_ms, least(recipient_id, opponent_id) AS a, greatest(recipient_id, opponent_id) AS b FROM asked WHERE opponent_id IS NOT NULL)", "p", "e.a = q.a AND e.b = q.b", "anchor_ms", "utc_ms"))
def pair_window_counts(spark, sf):
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    games = _games(spark, sf).select(*pair("white_id", "black_id"), "utc_ms")
    asked = _asked(spark, sf).where("opponent_id is not null").select("row_id", "anchor_ms", *pair("recipient_id", "opponent_id"))
    return op.window_counts(asked, games, ["a", "b"], ["row_id", "anchor_ms"], "anchor_ms", "utc_ms", _SPANS).drop("anchor_ms")


@query(f"WITH {_DECIDED}, f AS (SELECT * FROM decided QUALIFY row_number() OVER (PARTITION BY chooser ORDER BY t, ord, gid) = 1) SELECT chooser, gid, t FROM f WHERE fair AND start_ms >= 1680307200000")
def first_event_then_cut(spark, sf):
    return op.first_event(_decided(spark, sf), "chooser", ["t", "ord", "gid"], F.col("fair") & (F.col("start_ms") >= 1_680_307_200_000)).select("chooser", "gid", "t")


_HORIZON = 90 * DAY


@query(f"""WITH {_ASKED}, {_DECIDED}, last AS (SELECT max(t) AS until FROM decided),
  hits AS (SELECT a.row_id, a.anchor_ms, a.opponent_id, a.recipient_id, d.gid, d.t, d.y FROM asked a JOIN decided d ON d.chooser = a.opponent_id AND d.t > a.anchor_ms AND d.t <= a.anchor_ms + {_HORIZON} AND d.start_ms > a.anchor_ms AND d.counterparty <> a.recipient_id AND d.fair
    QUALIFY row_number() OVER (PARTITION BY a.row_id, a.anchor_ms, a.opponent_id, a.recipient_id ORDER BY d.t, d.ord, d.gid) = 1)
  SELECT a.row_id, a.anchor_ms, h.gid, h.y, CASE WHEN h.gid IS NOT NULL THEN 1 WHEN a.anchor_ms + {_HORIZON} < until THEN 0 END AS reached
  FROM asked a LEFT JOIN hits h USING (row_id, anchor_ms, opponent_id, recipient_id), last WHERE a.opponent_id IS NOT NULL""")
def first_outcome_after_anchor(spark, sf):
    """First fair decision of the opponent against someone else; unknown where the horizon was not fully observed."""
    asked, decided = _asked(spark, sf).where("opponent_id is not null"), _decided(spark, sf)
    until = decided.agg(F.max("t")).first()[0] or 0
    row = ["row_id", "anchor_ms", "opponent_id", "recipient_id"]
    out = op.first_outcome(asked, decided.where("fair"), row, ("opponent_id", "chooser"), "anchor_ms", "t", _HORIZON, ["ord", "gid"], ["gid", "y"], ("recipient_id", "counterparty"), "start_ms")
    return out.select("row_id", "anchor_ms", "gid", "y", op.unknown_until(out, F.col("gid").isNotNull(), "anchor_ms", _HORIZON, until).alias("reached"))


@query(f"""WITH {_ASKED}, {_DECIDED} SELECT a.row_id, a.anchor_ms, {", ".join(f"count(*) FILTER (WHERE d.t <= a.anchor_ms + {k * DAY}) AS n_{k}d" for k in (7, 30, 90))}
  FROM asked a JOIN decided d ON d.chooser = a.opponent_id AND d.t > a.anchor_ms AND d.t <= a.anchor_ms + {_HORIZON} GROUP BY a.row_id, a.anchor_ms""")
def horizon_counts(spark, sf):
    asked, decided = _asked(spark, sf).withColumnRenamed("opponent_id", "chooser"), _decided(spark, sf)
    spans = {f"n_{k}d": (1, k * DAY + 1) for k in (7, 30, 90)}
    return op.window_counts(asked, decided, ["chooser"], ["row_id", "anchor_ms"], "anchor_ms", "t", spans).where("n_90d > 0")


_EXPERIENCE = "CASE WHEN drawn > 0 THEN 'PG' WHEN earlier > 0 THEN 'PC' ELSE 'NC' END"


@query(f"""WITH {_DECIDED} SELECT a.gid, a.chooser, a.t, {_EXPERIENCE} AS experience FROM (SELECT gid, chooser, t, count(*) FILTER (WHERE fair) OVER w AS earlier, coalesce(sum(y::INT) OVER w, 0) AS drawn FROM decided WINDOW w AS (PARTITION BY chooser ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) a""")
def experience_class(spark, sf):
    """What the chooser did strictly before: gave a draw (PG), else chose in a fair position (PC), else neither (NC); peers at the same time do not count."""
    decided, row, ever = _decided(spark, sf), ["gid", "chooser", "t", "ord", "start_ms", "counterparty", "fair", "y"], (-(10**13), 0)
    every = op.window_counts(decided, decided.where("fair"), ["chooser"], row, "t", "t", {"earlier": ever})
    drawn = op.window_counts(decided, decided.where("y"), ["chooser"], row, "t", "t", {"drawn": ever})
    on = [every[c].eqNullSafe(drawn[c]) for c in row]
    counts = every.join(drawn, on).select(*[every[c] for c in ("gid", "chooser", "t")], "earlier", "drawn")
    return counts.select("gid", "chooser", "t", F.expr(_EXPERIENCE).alias("experience"))


@query(f"""WITH {_ASKED}, a AS (SELECT DISTINCT recipient_id, anchor_ms FROM asked)
  SELECT recipient_id, anchor_ms, coalesce(anchor_ms > max(anchor_ms) OVER (PARTITION BY recipient_id ORDER BY anchor_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {_HORIZON}, true) AS at_risk FROM a""")
def at_risk_cooldown(spark, sf):
    """An anchor is at risk if the one before it lies more than the horizon back."""
    anchors = _asked(spark, sf).select("recipient_id", "anchor_ms").distinct()
    out = op.asof_join(anchors, anchors.select("recipient_id", F.col("anchor_ms").alias("before")).withColumn("one", F.lit(1)), ["recipient_id"], "anchor_ms", "before", ["one"])
    return out.select("recipient_id", "anchor_ms", F.coalesce(F.col("anchor_ms") > F.col("asof_before") + _HORIZON, F.lit(True)).alias("at_risk"))


@query(f"""WITH RECURSIVE {_ASKED}, a AS (SELECT DISTINCT recipient_id AS r, anchor_ms AS t FROM asked), k(r, t) AS (SELECT r, min(t) FROM a GROUP BY r UNION ALL SELECT r, n FROM (SELECT k.r, min(a.t) AS n FROM k JOIN a ON a.r = k.r AND a.t > k.t + {_HORIZON} GROUP BY k.r, k.t) z) SELECT r AS recipient_id, t AS anchor_ms FROM k""")
def spaced_anchors(spark, sf):
    """Anchors taken one after another, each more than the horizon after the last one taken."""
    return op.spaced(_asked(spark, sf), "recipient_id", "anchor_ms", _HORIZON)


_GAP = 6 * 3_600_000
_SESSIONS = f"""{_SIDES}, m AS (SELECT DISTINCT player, game_id, utc_ms FROM sides), f AS (SELECT *, utc_ms - lag(utc_ms) OVER w >= {_GAP} OR lag(utc_ms) OVER w IS NULL AS opens FROM m WINDOW w AS (PARTITION BY player ORDER BY utc_ms, game_id)),
  s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY player ORDER BY utc_ms, game_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM f)"""


def _sessions(spark, sf):
    return op.sessionize(_sides(spark, sf).select("player", "game_id", "utc_ms").distinct(), "player", "utc_ms", ["game_id"], _GAP)


@query(f"WITH {_SESSIONS} SELECT player, game_id, utc_ms, session_no, row_number() OVER (PARTITION BY player, session_no ORDER BY utc_ms, game_id) AS position FROM s")
def sessionize_gap(spark, sf):
    w = Window.partitionBy("player", "session_no").orderBy("utc_ms", "game_id")
    return _sessions(spark, sf).select("player", "game_id", "utc_ms", F.col("session_no").cast("long").alias("session_no"), F.row_number().over(w).alias("position"))


@query(f"WITH {_SESSIONS} SELECT player, session_no, count(*) AS n, min(utc_ms) AS start_ms, max(utc_ms) - min(utc_ms) AS length_ms, session_no = 1 AS left_censored FROM s GROUP BY player, session_no")
def session_summary(spark, sf):
    s = _sessions(spark, sf).groupBy("player", "session_no").agg(F.count("*").alias("n"), F.min("utc_ms").alias("start_ms"), (F.max("utc_ms") - F.min("utc_ms")).alias("length_ms"))
    return s.withColumn("session_no", F.col("session_no").cast("long")).withColumn("left_censored", F.col("session_no") == 1)


_CUT = 1_700_000_000_000


@query(f"WITH {_SESSIONS} SELECT player, game_id, session_no FROM s WHERE utc_ms >= {_CUT}")
def sessions_carried(spark, sf):
    """The later games' sessions, numbered on from the state that the earlier ones left."""
    games = _sides(spark, sf).select("player", "game_id", "utc_ms").distinct()
    early = op.sessionize(games.where(F.col("utc_ms") < _CUT), "player", "utc_ms", ["game_id"], _GAP)
    carry = early.groupBy("player").agg(F.max("utc_ms").alias("last_at"), F.max("session_no").alias("session_no"))
    out = op.carried_sessions(games.where(F.col("utc_ms") >= _CUT), carry, "player", "utc_ms", ["game_id"], _GAP)
    return out.select("player", "game_id", F.col("session_no").cast("long").alias("session_no"))


@query(f"""WITH {_SIDES} SELECT player, max(utc_ms) AS utc_ms, max_by({{'e': elo}}, {{'a': utc_ms, 'b': coalesce(elo, -1000000)}}).e AS elo FROM sides GROUP BY player""")
def carry_merge(spark, sf):
    s = _sides(spark, sf)
    old = op.merge_carry(s.limit(0), s.where(F.col("utc_ms") < _CUT), "player", "utc_ms", ["elo"])
    return op.merge_carry(old, s.where(F.col("utc_ms") >= _CUT), "player", "utc_ms", ["elo"])


@query(f"""WITH {_GAMES}, p AS (SELECT DISTINCT game_id, utc_ms, white_id AS player, black_id AS foe FROM games UNION SELECT DISTINCT game_id, utc_ms, black_id, white_id FROM games),
  m AS (SELECT player, utc_ms, count(*) AS n, min({{'g': game_id, 'f': foe}}) AS one FROM p WHERE player IS NOT NULL GROUP BY 1, 2),
  l AS (SELECT player, utc_ms, n, lag(utc_ms) OVER w AS pt, lag(n) OVER w AS pn, lag(one) OVER w AS po FROM m WINDOW w AS (PARTITION BY player ORDER BY utc_ms)),
  j AS (SELECT p.game_id, p.utc_ms, count(p.player) AS players, max(greatest(n, coalesce(pn, 1))) AS most, count(pt) AS known, min(pt) = max(pt) AND min(po.g) = max(po.g) AS same, bool_and(po.f = p.foe) AS facing FROM p LEFT JOIN l USING (player, utc_ms) GROUP BY ALL)
  SELECT game_id, utc_ms, CASE WHEN players <> 2 THEN 'unmapped' WHEN most > 1 THEN 'ambiguous' WHEN known < 2 THEN 'left_boundary' WHEN same AND facing THEN 'mutual' ELSE 'different' END AS status FROM j""")
def adjacency_census(spark, sf):
    return op.adjacency(_games(spark, sf), "game_id", ("white_id", "black_id"), "utc_ms")


@query(f"WITH {_GAMES} SELECT game_id, utc_ms = min(utc_ms) OVER (PARTITION BY least(white_id, black_id), greatest(white_id, black_id)) AS first_meeting FROM games")
def first_pair(spark, sf):
    games = _games(spark, sf)
    pair = (F.least("white_id", "black_id").alias("a"), F.greatest("white_id", "black_id").alias("b"))
    first = games.groupBy(*pair).agg(F.min("utc_ms").alias("first_ms"))
    return games.select("game_id", "utc_ms", *pair).join(first, ["a", "b"]).select("game_id", (F.col("utc_ms") == F.col("first_ms")).alias("first_meeting"))


@query(f"""WITH {_SIDES}, g AS (SELECT DISTINCT player, game_id, utc_ms FROM sides) SELECT player, game_id, utc_ms,
  coalesce(utc_ms - max(utc_ms) OVER (PARTITION BY player ORDER BY utc_ms, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 60000, false)
  OR coalesce(min(utc_ms) OVER (PARTITION BY player ORDER BY utc_ms, game_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - utc_ms <= 60000, false) AS crowded FROM g""")
def overlap_guard(spark, sf):
    games = _sides(spark, sf).select("player", "game_id", "utc_ms").distinct()
    near = op.window_counts(games, games, ["player"], ["player", "game_id", "utc_ms"], "utc_ms", "utc_ms", {"n": (-60_000, 60_001)})
    return near.select("player", "game_id", "utc_ms", (F.col("n") > 1).alias("crowded"))


#: Hours of the events' 30 days: three days to either side, traffic of five hours before.
_HOURLY = Baseline(offsets=tuple(24 * d for d in (-3, -2, -1, 1, 2, 3)), traffic=(6, 1), least_traffic=20.0)


def _seasonal_sql(counts: str) -> str:
    """Text of the seasonal scores of ``counts`` (series, hour, n) over covered hours, named scored."""
    return f"""h AS ({counts}), covered AS (SELECT epoch_ms(ts) // 3600000 AS hour, count(*) AS n FROM events GROUP BY 1),
  grid AS (SELECT s.series, c.hour, coalesce(h.n, 0) AS n FROM covered c CROSS JOIN (SELECT DISTINCT series FROM h) s LEFT JOIN h ON h.series = s.series AND h.hour = c.hour),
  traffic AS (SELECT c.hour + k.k AS hour, sum(c.n) AS t FROM covered c, range(2, 7) k(k) GROUP BY 1 HAVING count(*) = 5),
  g AS (SELECT grid.*, t FROM grid LEFT JOIN traffic USING (hour)),
  refs AS (SELECT a.series, a.hour, a.n, list(CASE WHEN a.t >= 20 AND b.t >= 20 AND a.t / b.t BETWEEN 0.25 AND 4 THEN b.n * (a.t / b.t) END) FILTER (WHERE a.t >= 20 AND b.t >= 20 AND a.t / b.t BETWEEN 0.25 AND 4) AS r
    FROM g a LEFT JOIN g b ON a.series = b.series AND b.hour - a.hour IN (-72, -48, -24, 24, 48, 72) GROUP BY 1, 2, 3),
  m AS (SELECT *, coalesce(len(r), 0) AS refs, list_aggregate(r, 'median') AS expected FROM refs), d AS (SELECT *, list_aggregate(list_transform(r, lambda x: abs(x - expected)), 'median') AS mad FROM m),
  scored AS (SELECT series, hour, n, refs, expected, mad, CASE WHEN refs >= 4 THEN (n - expected) / greatest(sqrt(greatest(expected, 0) + 1), 1.4826 * mad) END AS score, CASE WHEN refs >= 4 THEN n / greatest(expected, 5) END AS ratio, n - expected AS excess FROM d)"""


def _hourly(spark: SparkSession, sf: str, *by: str | F.Column) -> DataFrame:
    e = table(spark, sf, "events").withColumn("hour", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000))
    return e.groupBy(*by, "hour").agg(F.count("*").alias("n"))


def _seasonal(spark: SparkSession, sf: str, counts: DataFrame) -> DataFrame:
    covered = _hourly(spark, sf)
    return seasonal_scores(observed_grid(counts, covered, "series", "hour"), "series", "hour", _HOURLY, covered)


@query(f"""WITH {_seasonal_sql("SELECT event_type AS series, epoch_ms(ts) // 3600000 AS hour, count(*) AS n FROM events GROUP BY 1, 2")}
  SELECT series, hour, n, refs, {", ".join(f"round({c}, 6) AS {c}" for c in ("expected", "mad", "score", "ratio", "excess"))} FROM scored""")
def hourly_anomaly(spark, sf):
    """Each hour against the same hour of nearby days, adjusted for traffic; hours without any event are missing, not 0."""
    out = _seasonal(spark, sf, _hourly(spark, sf, F.col("event_type").alias("series")))
    return out.withColumns({c: F.round(c, 6) for c in ("expected", "mad", "score", "ratio", "excess")})


@query(f"""WITH {_SIDES}, d AS (SELECT player, utc_ms // {DAY} AS day, count(DISTINCT game_id) AS n FROM sides GROUP BY 1, 2)
  SELECT player, day, n, sum(n) OVER w3 AS n3, count(*) OVER w3 = 3 AS complete FROM d WINDOW w3 AS (PARTITION BY player ORDER BY day RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""".replace("sum(n) OVER w3 AS n3", "(sum(n) OVER w3)::BIGINT AS n3"))
def complete_window_diff(spark, sf):
    """Three-day sums that say whether all three days were observed."""
    d = _sides(spark, sf).groupBy("player", F.floor(F.col("utc_ms") / DAY).alias("day")).agg(F.count_distinct("game_id").alias("n"))
    w = Window.partitionBy("player").orderBy("day").rangeBetween(-2, 0)
    return d.select("player", "day", "n", F.sum("n").over(w).alias("n3"), (F.count("*").over(w) == 3).alias("complete"))


@query(f"""WITH {_DECIDED}, r AS (SELECT chooser, t, ord, gid, y, count(*) FILTER (WHERE y) OVER (PARTITION BY chooser ORDER BY t, ord, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, row_number() OVER (PARTITION BY chooser ORDER BY t, ord, gid) AS spell FROM decided)
  SELECT spell, count(*) AS at_risk, count(*) FILTER (WHERE y) AS events FROM r WHERE before = 0 GROUP BY spell""")
def hazard_riskset(spark, sf):
    """Decisions up to a chooser's first draw, by position."""
    d = _decided(spark, sf).withColumn("mark", F.when(F.col("y"), 1))
    runs = running_labels(d, "chooser", "t", "mark", lambda _: F.lit(True), ["ord", "gid"], prior="seen", label="spell")
    return runs.where("seen is null").groupBy(F.col("spell").cast("long").alias("spell")).agg(F.count("*").alias("at_risk"), F.count_if("y").alias("events"))


@query(f"""WITH {_SIDES}, w AS (SELECT player, (1735000000000 - utc_ms) // (7 * {DAY}) AS week FROM sides WHERE utc_ms < 1735000000000)
  SELECT player, bool_or(week = 0) AS w0, bool_or(week = 1) AS w1, bool_or(week = 2) AS w2, bool_or(week = 3) AS w3 FROM w WHERE week < 4 GROUP BY player""")
def roster_four_weeks(spark, sf):
    w = _sides(spark, sf).where("utc_ms < 1735000000000").withColumn("week", F.floor((1_735_000_000_000 - F.col("utc_ms")) / (7 * DAY))).where("week < 4")
    return w.groupBy("player").agg(*[F.bool_or(F.col("week") == k).alias(f"w{k}") for k in range(4)])


_WIDTHS = (10, 50, 100)


def _last_n_sql(w: int) -> str:
    own = f"FILTER (WHERE k <= {w})"
    tie = f"coalesce(max(t) FILTER (WHERE k = {w}) = max(t) FILTER (WHERE k = {w + 1}), false)"
    good = f"c >= {w} AND count(r) {own} = {w} AND NOT {tie}"
    when = lambda x, name: f"CASE WHEN {good} THEN round({x}, 5) END AS {name}{w}"
    det = f"sqrt(greatest(regr_syy(r, k) {own} - pow(regr_sxy(r, k) {own}, 2) / (regr_sxx(r, k) {own}), 0) / {w - 2})"
    return ", ".join([
        when(f"stddev_samp(r) {own}", "sd"), when(f"(quantile_cont(r, 0.75) {own}) - (quantile_cont(r, 0.25) {own})", "iqr"), when(det, "detrended"),
        when(f"(max(t) {own} - min(t) {own}) / {DAY}::DOUBLE", "span"), f"CASE WHEN c >= {w} THEN (count(*) {own} - count(r) {own})::INT END AS missing{w}", f"{tie} AS tie{w}",
    ])


@query(f"""WITH {_ASKED}, {_SIDES}, h AS (SELECT DISTINCT player, utc_ms AS t, archive_ordinal, game_id, CASE WHEN elo BETWEEN 400 AND 4000 THEN elo::DOUBLE END AS r FROM sides),
  n AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY t, archive_ordinal, game_id, r NULLS FIRST) AS i FROM h), a AS (SELECT DISTINCT row_id, recipient_id, anchor_ms FROM asked),
  q AS (SELECT a.row_id, a.recipient_id, a.anchor_ms, count(h.t) AS c FROM a LEFT JOIN h ON h.player = a.recipient_id AND h.t < a.anchor_ms GROUP BY ALL),
  l AS (SELECT q.*, n.t, n.r, c - n.i + 1 AS k FROM q LEFT JOIN n ON n.player = q.recipient_id AND n.i <= c AND n.i > c - 101)
  SELECT row_id, anchor_ms, least(c, 101)::INT AS n_prior, round((anchor_ms - max(t)) / {DAY}::DOUBLE, 5) AS age_days, {", ".join(_last_n_sql(w) for w in _WIDTHS)} FROM l GROUP BY row_id, recipient_id, anchor_ms, c""")
def last_n_features(spark, sf):
    """Spread, trend and span of the recipient's last 10, 50 and 100 ratings before the anchor."""
    h = _sides(spark, sf).withColumn("r", F.when(F.col("elo").between(400, 4000), F.col("elo").cast("double")))
    asked = _asked(spark, sf).select("row_id", F.col("recipient_id").alias("player"), "anchor_ms")
    out = op.last_n_features(h, asked, "player", "utc_ms", "r", ["archive_ordinal", "game_id"], ["row_id", "player", "anchor_ms"], "anchor_ms", _WIDTHS).drop("player")
    return out.withColumns({c: F.round(c, 5) for c in out.columns if c.startswith(("age", "sd", "iqr", "detrended", "span"))})


_ANGLE = f"2 * pi() * (utc_ms % {DAY}) / {DAY}e0"
_YEAR = f"CASE WHEN utc_ms >= {1_704_067_200_000} THEN 2 ELSE 1 END"


@query(f"""WITH {_SIDES}, m AS (SELECT player, {_YEAR} AS half, count(*) AS n, count(DISTINCT utc_ms // {DAY}) AS days, sum(cos({_ANGLE})) AS c, sum(sin({_ANGLE})) AS s FROM sides GROUP BY 1, 2),
  p AS (SELECT player, half, n, days, sqrt(c * c + s * s) / n AS concentration, (atan2(s, c) / (2 * pi()) * 24 + 24) % 24 AS phase FROM m WHERE n >= 5 AND days >= 3)
  SELECT a.player, a.n, b.n AS n_later, round(a.concentration, 6) AS concentration, round(a.phase, 4) AS phase, CASE WHEN a.concentration >= 0.2 AND b.concentration >= 0.2 THEN round(least(abs(a.phase - b.phase), 24 - abs(a.phase - b.phase)), 4) END AS distance
  FROM p a LEFT JOIN p b ON b.player = a.player AND b.half = 2 WHERE a.half = 1""")
def circular_phase(spark, sf):
    """Time of day that a player's games centre on, and how far it moved from one year to the next.

    A year counts with at least 5 games on 3 days, a distance only where both years are concentrated.
    """
    m = _sides(spark, sf).groupBy("player", F.expr(_YEAR).alias("half")).agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("utc_ms") / DAY)).alias("days"), F.expr(f"sum(cos({_ANGLE}))").alias("c"), F.expr(f"sum(sin({_ANGLE}))").alias("s"))
    p = m.where("n >= 5 and days >= 3").select("player", "half", "n", (F.hypot("c", "s") / F.col("n")).alias("concentration"), F.expr("pmod(atan2(s, c) / (2 * pi()) * 24 + 24, 24)").alias("phase"))
    year = lambda k: F.max(F.when(F.col("half") == k, F.struct("n", "concentration", "phase"))).alias(f"y{k}")
    both = p.groupBy("player").agg(year(1), year(2)).where("y1 is not null")
    apart = F.abs(F.col("y1.phase") - F.col("y2.phase"))
    distance = F.when((F.col("y1.concentration") >= 0.2) & (F.col("y2.concentration") >= 0.2), F.round(F.least(apart, 24 - apart), 4))
    return both.select("player", F.col("y1.n").alias("n"), F.col("y2.n").alias("n_later"), F.round("y1.concentration", 6).alias("concentration"), F.round("y1.phase", 4).alias("phase"), distance.alias("distance"))


@query("""WITH e AS (SELECT quantile_cont(chooser_elo::DOUBLE, 0.5) AS q50, quantile_cont(chooser_elo::DOUBLE, 0.9) AS q90 FROM analysis_panel WHERE chooser_elo > 0), p AS (SELECT DISTINCT game_id, chooser_elo FROM analysis_panel WHERE chooser_elo > 0)
  SELECT game_id, chooser_elo, (chooser_elo + 50) // 100 * 100 AS mark, chooser_elo - (chooser_elo + 50) // 100 * 100 AS off, sign(chooser_elo - (chooser_elo + 50) // 100 * 100)::INT AS side,
    (chooser_elo + 8) // 100 > (chooser_elo - 8) // 100 AS crosses_100, chooser_elo + 8 >= q50 AND chooser_elo - 8 < q50 AS crosses_p50, chooser_elo + 8 >= q90 AND chooser_elo - 8 < q90 AS crosses_p90 FROM p, e""")
def nearest_threshold(spark, sf):
    """The nearest round rating, and whether a win (8 points up) lies beyond a round or quantile boundary that a loss (8 down) does not."""
    mark = F.expr("(chooser_elo + 50) div 100 * 100")
    rated = table(spark, sf, "analysis_panel").where("chooser_elo > 0")
    edges = exact_quantiles(rated.withColumn("one", F.lit(1)), "one", "chooser_elo", {"q50": 0.5, "q90": 0.9}).select("q50", "q90")
    p = rated.select("game_id", "chooser_elo").distinct().withColumn("mark", mark).crossJoin(F.broadcast(edges))  # one row of edges
    p = p.withColumn("off", F.col("chooser_elo") - F.col("mark")).withColumn("side", F.signum("off").cast("int"))
    beyond = [((F.col("chooser_elo") + 8 >= F.col(q)) & (F.col("chooser_elo") - 8 < F.col(q))).alias(f"crosses_{q.replace('q', 'p')}") for q in ("q50", "q90")]
    return p.select("game_id", "chooser_elo", "mark", "off", "side", F.expr("(chooser_elo + 8) div 100 > (chooser_elo - 8) div 100").alias("crosses_100"), *beyond)


@query("""WITH h AS (SELECT n_all_time AS v, count(*) AS n FROM scores_main WHERE n_all_time IS NOT NULL GROUP BY 1), c AS (SELECT v, (sum(n) OVER (ORDER BY v))::DOUBLE / (SELECT sum(n) FROM h) AS p FROM h)
  SELECT s.row_id, s.n_all_time, round(coalesce(c.p, 0), 6) AS percentile FROM (SELECT DISTINCT row_id, n_all_time FROM scores_copy WHERE n_all_time IS NOT NULL) s ASOF LEFT JOIN c ON s.n_all_time >= c.v""")
def ecdf_percentile(spark, sf):
    """Each copy value's share of main values at or below it."""
    h = table(spark, sf, "scores_main").where("n_all_time is not null").groupBy(F.col("n_all_time").alias("v")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    total = h.agg(F.sum("n")).first()[0] or 1
    h = cumulative(h, ["one"], "v", "n").withColumn("p", F.col("__upto") / F.lit(total))
    s = table(spark, sf, "scores_copy").where("n_all_time is not null").select("row_id", "n_all_time").distinct().withColumn("one", F.lit(1))
    out = op.asof_join(s, h, ["one"], "n_all_time", "v", ["p"], strict=False)
    return out.select("row_id", "n_all_time", F.round(F.coalesce("asof_p", F.lit(0.0)), 6).alias("percentile"))


@query("""WITH p AS (SELECT DISTINCT game_id, utc_ms, outcome_kind_draw FROM analysis_panel WHERE utc_ms IS NOT NULL) SELECT (utc_ms - 1704067200000) // 86400000 AS off, count(*) AS n, count(*) FILTER (WHERE outcome_kind_draw) AS draws FROM p WHERE utc_ms >= 1704067200000 AND utc_ms < 1706659200000 GROUP BY 1""")
def event_study(spark, sf):
    p = table(spark, sf, "analysis_panel").where("utc_ms >= 1704067200000 and utc_ms < 1706659200000").select("game_id", "utc_ms", "outcome_kind_draw").distinct()
    return p.groupBy(F.floor((F.col("utc_ms") - 1_704_067_200_000) / DAY).alias("off")).agg(F.count("*").alias("n"), F.count_if("outcome_kind_draw").alias("draws"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row_no FROM orders")
def global_row_ids(spark, sf):
    return row_ids(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_no")


@query(f"""WITH RECURSIVE d AS (SELECT user_id, epoch_ms(ts) // {DAY} AS day, count(*) AS n FROM events GROUP BY 1, 2), s AS (SELECT * FROM d WHERE n >= 3),
  r(user_id, days, last, k) AS (SELECT user_id, [first], first, 1 FROM (SELECT user_id, arg_min(day, {{'a': -n, 'b': day}}) AS first FROM s GROUP BY user_id)
    UNION ALL SELECT q.user_id, list_append(q.days, q.pick), q.pick, q.k + 1 FROM (SELECT r.user_id, r.days, r.k, arg_min(s.day, {{'a': -s.n, 'b': s.day}}) AS pick FROM r JOIN s ON s.user_id = r.user_id AND len(list_filter(r.days, lambda x: abs(x - s.day) < 2)) = 0 WHERE r.k < 3 GROUP BY ALL) q)
  SELECT r.user_id, r.last AS day, s.n, r.k AS rank FROM r JOIN s ON s.user_id = r.user_id AND s.day = r.last""")
def busiest_days(spark, sf):
    """A user's three busiest days, at least two days apart."""
    d = table(spark, sf, "events").groupBy("user_id", F.unix_date(F.to_date("ts")).cast("long").alias("day")).agg(F.count("*").alias("n")).where("n >= 3")
    return op.separated_top(d, "user_id", "day", "n", 3, 2)


@query("""WITH h AS (SELECT event_type, epoch_ms(ts) // 3600000 AS hour, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT min(hour) AS lo, max(hour) AS hi FROM h),
  g AS (SELECT event_type, hour, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT event_type FROM h), (SELECT unnest(range(lo, hi + 1)) AS hour FROM b)) x LEFT JOIN h USING (event_type, hour))
  SELECT event_type, hour, n, (sum(n) OVER (w ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))::BIGINT AS trailing, (sum(n) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))::BIGINT AS centred, coalesce(sum(n) OVER (w ROWS BETWEEN 8 PRECEDING AND 3 PRECEDING), 0)::BIGINT AS earlier FROM g WINDOW w AS (PARTITION BY event_type ORDER BY hour)""")
def rolling_grid(spark, sf):
    """Sums over a dense hourly grid: trailing, centred, and a window that ends before."""
    h = table(spark, sf, "events").groupBy("event_type", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000).alias("hour")).agg(F.count("*").alias("n"))
    ends = h.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi"))
    g = h.select("event_type").distinct().crossJoin(F.broadcast(ends)).select("event_type", F.explode(F.sequence("lo", "hi")).alias("hour")).join(h, ["event_type", "hour"], "left").na.fill(0, ["n"])  # one row of ends
    w = Window.partitionBy("event_type").orderBy("hour")
    total = lambda a, b: F.coalesce(F.sum("n").over(w.rowsBetween(a, b)), F.lit(0))
    return g.select("event_type", "hour", "n", total(-5, 0).alias("trailing"), total(-3, 3).alias("centred"), total(-8, -3).alias("earlier"))


_HALF = "(('0x' || substr(md5(user_id::VARCHAR), 1, 8))::BIGINT % 2)"


@query(f"""WITH {_seasonal_sql(f"SELECT event_type || {_HALF} AS series, epoch_ms(ts) // 3600000 AS hour, count(*) AS n FROM events GROUP BY 1, 2")},
  z AS (SELECT left(series, length(series) - 1) AS event_type, right(series, 1) AS fold, * FROM scored), s AS (SELECT * FROM z WHERE fold = '0' AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(score, 9) DESC, hour) <= 5)
  SELECT s.event_type, s.hour, round(s.score, 6) AS found_score, round(z.score, 6) AS other_score, coalesce(z.score >= 1 AND z.ratio >= 0.2 AND z.excess >= 1, false) AS replicated FROM s LEFT JOIN z ON z.event_type = s.event_type AND z.hour = s.hour AND z.fold = '1'""")
def fold_replication(spark, sf):
    """The most unusual hours of one half of the users, judged again in the other half."""
    half = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 2
    z = _seasonal(spark, sf, _hourly(spark, sf, F.concat("event_type", half.cast("string")).alias("series")))
    z = z.withColumns({"event_type": F.expr("left(series, length(series) - 1)"), "fold": F.expr("right(series, 1)")})
    w = Window.partitionBy("event_type").orderBy(F.desc(F.round("score", 9)), "hour")
    seeds = z.where("fold = '0' and score is not null").withColumn("k", F.row_number().over(w)).where("k <= 5").select("event_type", "hour", F.round("score", 6).alias("found_score"))
    other = z.where("fold = '1'").select("event_type", "hour", F.round("score", 6).alias("other_score"), ((F.col("score") >= 1) & (F.col("ratio") >= 0.2) & (F.col("excess") >= 1)).alias("ok"))
    return seeds.join(other, ["event_type", "hour"], "left").select("event_type", "hour", "found_score", "other_score", F.coalesce("ok", F.lit(False)).alias("replicated"))


@query(f"""WITH {_ASKED}, {_DECIDED}, h AS (SELECT a.row_id, a.anchor_ms, d.gid, d.ord FROM asked a JOIN decided d ON d.chooser = a.opponent_id AND d.t > a.anchor_ms AND d.t <= a.anchor_ms + {_HORIZON} AND d.start_ms > a.anchor_ms AND d.counterparty <> a.recipient_id AND d.fair
    QUALIFY row_number() OVER (PARTITION BY a.row_id, a.anchor_ms, a.opponent_id, a.recipient_id ORDER BY d.t, d.ord, d.gid) = 1) SELECT gid, count(*) AS exposures FROM h GROUP BY gid HAVING count(*) > 1""")
def reused_outcomes(spark, sf):
    """Outcomes that serve several anchors."""
    return first_outcome_after_anchor(spark, sf).where("gid is not null").groupBy("gid").agg(F.count("*").alias("exposures")).where("exposures > 1")


@query("SELECT lower(trim(cohort)) AS cohort, count(DISTINCT coalesce(load_no, -1)) AS coarse_labels FROM decisions GROUP BY 1 HAVING count(DISTINCT coalesce(load_no, -1)) > 1")
def nested_labels(spark, sf):
    """Cohorts that came in several loads."""
    d = table(spark, sf, "decisions").select(F.lower(F.trim("cohort")).alias("cohort"), "load_no")
    return nested(d, "cohort", "load_no")


@query()
def rating_replayed(spark, sf):
    """Both players' states before each game; records whose ratings are both missing or impossible update nothing."""
    g = table(spark, sf, "chronology").where("utc_ms is not null").groupBy("game_id", "utc_ms", "white_id", "black_id", "result_code").agg(F.max("white_elo").alias("w"), F.max("black_elo").alias("b"))
    possible = lambda c: F.col(c).between(400, 4000)
    g = g.withColumn("pool", F.pmod(F.crc32(F.col("game_id").cast("binary")), F.lit(5))).withColumn("observed", possible("w") | possible("b"))
    g = g.withColumns({c: F.when(possible(c), F.col(c)).otherwise(1500) for c in ("w", "b")}).withColumn("score", F.col("result_code") / 2)
    return op.rating_replay(g, "pool", "utc_ms", "game_id", ("white_id", "black_id"), ("w", "b"), "score", "observed")


_MOVE = r"(\d+\. [KQRBN]?[a-h][1-8]\S* [KQRBN]?[a-h][1-8]\S*)"


@query(f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_MOVE}', 1)) AS m FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, regexp_extract(m, '^(\\d+)', 1)::INT AS move_no, split_part(m, ' ', 2) AS white, split_part(m, ' ', 3) AS black FROM m""")
def record_split(spark, sf):
    """Numbered moves in documents, taken apart into one row per move pair."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_MOVE), F.lit(1))).alias("m"))
    part = lambda k: F.split_part("m", F.lit(" "), F.lit(k))
    return d.select("doc_id", F.regexp_extract("m", r"^(\d+)", 1).cast("int").alias("move_no"), part(2).alias("white"), part(3).alias("black"))


# Orders within one chooser, who may hold a great part of the rows ----------------

_MOVES = "moves AS (SELECT DISTINCT gid, chooser, t, ord, y FROM decisions WHERE chooser >= 0 AND t IS NOT NULL)"
_LAST = ["ord", "gid"]


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "decisions").where("chooser >= 0 and t is not null").select("gid", "chooser", "t", "ord", "y").distinct()


def _before_after(df: DataFrame) -> DataFrame:
    """The two times before (t1, t2) and after (n1, n2): times grow along the order, so the greatest earlier one is the last."""
    same = lambda prior: prior
    df = running_labels(df, "chooser", "t", "t", None, _LAST, prior="t1", second=("t2", same))
    back = [F.desc_nulls_last("ord"), F.desc_nulls_last("gid"), F.desc_nulls_last("y")]
    df = running_labels(df.withColumn("__back", -F.col("t")), "chooser", "__back", "t", None, back, prior="n1", least=True, second=("n2", same))
    return df.drop("__back")


@query(f"""WITH {_MOVES} SELECT gid, chooser, lag(t) OVER w AS t1, lag(t, 2) OVER w AS t2, lead(t) OVER w AS n1, lead(t, 2) OVER w AS n2 FROM moves WINDOW w AS (PARTITION BY chooser ORDER BY t, ord, gid)""")
def lag2_lead2(spark, sf):
    return _before_after(_moves(spark, sf)).select("gid", "chooser", "t1", "t2", "n1", "n2")


@query(f"""WITH {_MOVES} SELECT gid, chooser, CAST(sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (PARTITION BY chooser ORDER BY t, ord, gid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS so_far,
  max(t) OVER (PARTITION BY chooser ORDER BY t, ord, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max,
  min(t) OVER (PARTITION BY chooser ORDER BY t, ord, gid ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_min FROM moves""")
def running_rows(spark, sf):
    df = running_labels(_moves(spark, sf), "chooser", "t", "t", lambda _: F.col("y"), _LAST, prior="prior_max", label="so_far")
    back = [F.desc_nulls_last("ord"), F.desc_nulls_last("gid")]
    df = running_labels(df.withColumn("__back", -F.col("t")), "chooser", "__back", "t", None, back, prior="next_min", least=True)
    return df.select("gid", "chooser", F.col("so_far").cast("long").alias("so_far"), "prior_max", "next_min")


@query(f"""WITH {_MOVES} SELECT gid, chooser, count(*) OVER (PARTITION BY chooser ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior, count(*) OVER (PARTITION BY chooser ORDER BY t) AS with_peers FROM moves""")
def range_peer_excl(spark, sf):
    moves = _moves(spark, sf)
    counts = op.window_counts(moves, moves, ["chooser"], ["gid", "chooser", "t", "ord", "y"], "t", "t", {"prior": (-(10**13), 0), "with_peers": (-(10**13), 1)})
    return counts.select("gid", "chooser", "prior", "with_peers")


@query(f"WITH {_MOVES} SELECT gid, chooser, min(t) OVER (PARTITION BY chooser) AS first_t, count(*) OVER (PARTITION BY chooser, t) AS ties, t - min(t) OVER (PARTITION BY chooser) AS age FROM moves")
def whole_partition(spark, sf):
    """Partial aggregates and joins, which AQE splits for a hot chooser, instead of one window task."""
    moves = _moves(spark, sf)
    first = moves.groupBy("chooser").agg(F.min("t").alias("first_t"))
    ties = moves.groupBy("chooser", "t").agg(F.count("*").alias("ties"))
    return moves.join(ties, ["chooser", "t"]).join(first, "chooser").select("gid", "chooser", "first_t", "ties", (F.col("t") - F.col("first_t")).alias("age"))


@query(f"WITH {_MOVES} SELECT gid, chooser, CAST(sum(CASE WHEN t >= 1688169600000 THEN 1 END) OVER (PARTITION BY chooser ORDER BY t, ord, gid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS since FROM moves")
def conditional_running(spark, sf):
    df = running_labels(_moves(spark, sf), "chooser", "t", "t", lambda _: F.col("t") >= 1_688_169_600_000, _LAST, label="since")
    return df.select("gid", "chooser", F.when(F.col("since") > 0, F.col("since")).cast("long").alias("since"))


@query("""SELECT e.row_id, count(*) AS later, min(d.t) AS first_t FROM (SELECT DISTINCT row_id, opponent_id, recipient_id, anchor_ms FROM exposures) e
  JOIN (SELECT DISTINCT gid, chooser, counterparty, t, ord FROM decisions WHERE t IS NOT NULL) d ON d.chooser = e.opponent_id AND d.t > e.anchor_ms AND d.t <= e.anchor_ms + 2592000000 AND d.counterparty <> e.recipient_id GROUP BY e.row_id, e.opponent_id, e.recipient_id, e.anchor_ms""")
def horizon_join_agg(spark, sf):
    """Decisions of the next 30 days against others: all less those against the recipient, both from running counts."""
    row = ["row_id", "opponent_id", "recipient_id", "anchor_ms"]
    asked = table(spark, sf, "exposures").where("opponent_id is not null and recipient_id is not null and anchor_ms is not null").select(*row).distinct()
    d = table(spark, sf, "decisions").where("t is not null and counterparty is not null").select("gid", F.col("chooser").alias("opponent_id"), F.col("counterparty").alias("recipient_id"), "t", "ord").distinct()
    span = (1, 30 * DAY + 1)
    every = op.window_counts(asked, d, ["opponent_id"], row, "anchor_ms", "t", {"every": span})
    own = op.window_counts(asked, d, ["opponent_id", "recipient_id"], row, "anchor_ms", "t", {"own": span})
    first = op.first_outcome(asked, d, row, ("opponent_id", "opponent_id"), "anchor_ms", "t", 30 * DAY, ["ord", "gid"], ["t"], ("recipient_id", "recipient_id"))
    return every.join(own, row).join(first, row).where("every > own").select("row_id", (F.col("every") - F.col("own")).alias("later"), F.col("t").alias("first_t"))


# Cells, quantiles, board strings --------------------------------------------------


@query("""WITH p AS (SELECT engine_eval_cp_disconnected AS cp, ply_count AS ply, chooser_elo - disconnected_elo AS gap, CASE api_speed WHEN 'bullet' THEN 0 WHEN 'blitz' THEN 1 WHEN 'rapid' THEN 2 WHEN 'classical' THEN 3 ELSE 4 END AS speed FROM analysis_panel
    WHERE NOT isnan(engine_eval_cp_disconnected) AND ply_count IS NOT NULL AND chooser_elo IS NOT NULL AND disconnected_elo IS NOT NULL)
  SELECT ((CASE WHEN cp <= -300 THEN 0 WHEN cp < -100 THEN 1 WHEN cp <= 100 THEN 2 WHEN cp < 300 THEN 3 ELSE 4 END * 4 + CASE WHEN ply <= 10 THEN 0 WHEN ply <= 30 THEN 1 WHEN ply <= 60 THEN 2 ELSE 3 END) * 5 + speed) * 5
    + CASE WHEN gap <= -200 THEN 0 WHEN gap <= -100 THEN 1 WHEN gap <= 100 THEN 2 WHEN gap <= 200 THEN 3 ELSE 4 END AS cell, count(*) AS n FROM p GROUP BY 1""")
def state_cells(spark, sf):
    p = table(spark, sf, "analysis_panel").where("engine_eval_cp_disconnected is not null and not isnan(engine_eval_cp_disconnected) and ply_count is not null and chooser_elo is not null and disconnected_elo is not null")
    cell = cols.state_cell(F.col("engine_eval_cp_disconnected"), F.col("ply_count"), cols.speed_code(F.col("api_speed")), F.col("chooser_elo") - F.col("disconnected_elo"))
    return p.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))


@query("""SELECT row_id, CASE WHEN n_all_time IS NULL THEN 'missing' WHEN n_all_time < 10 THEN 'few' WHEN n_all_time < 30 THEN 'some' ELSE 'many' END AS amount,
  CASE WHEN expected_all_time IS NULL OR isnan(expected_all_time) THEN -1 WHEN expected_all_time <= 0.1 THEN 0 WHEN expected_all_time <= 0.2 THEN 1 ELSE 2 END AS level FROM scores_main""")
def edge_bins(spark, sf):
    s = table(spark, sf, "scores_main")
    return s.select("row_id", cols.binned(F.col("n_all_time"), [10, 30], ["few", "some", "many"], "left", "missing").alias("amount"), cols.binned(F.col("expected_all_time"), [0.1, 0.2], missing=-1).alias("level"))


@query("""SELECT api_speed, round(quantile_cont(disconnected_clock_last_obs_s, 0.1), 6) AS q10, round(median(disconnected_clock_last_obs_s), 6) AS q50, round(quantile_cont(disconnected_clock_last_obs_s, 0.9), 6) AS q90
  FROM analysis_panel WHERE NOT isnan(disconnected_clock_last_obs_s) GROUP BY api_speed""")
def quantile_exact(spark, sf):
    """By refined histograms: no buffer holds the values of one of the few groups."""
    q = exact_quantiles(table(spark, sf, "analysis_panel"), "api_speed", "disconnected_clock_last_obs_s", {"q10": 0.1, "q50": 0.5, "q90": 0.9})
    return q.select("api_speed", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")])


@query("""WITH q AS (SELECT quantile_cont(n_all_time::DOUBLE, 0.25) AS a, quantile_cont(n_all_time::DOUBLE, 0.5) AS b, quantile_cont(n_all_time::DOUBLE, 0.75) AS c FROM scores_main WHERE n_all_time IS NOT NULL)
  SELECT row_id, rev, n_all_time, CASE WHEN n_all_time <= a THEN 1 WHEN n_all_time <= b THEN 2 WHEN n_all_time <= c THEN 3 ELSE 4 END AS quarter FROM (SELECT DISTINCT row_id, rev, n_all_time FROM scores_main WHERE n_all_time IS NOT NULL) s, q""")
def quantile_cuts(spark, sf):
    s = table(spark, sf, "scores_main").where("n_all_time is not null")
    edges = exact_quantiles(s.withColumn("one", F.lit(1)), "one", "n_all_time", {"a": 0.25, "b": 0.5, "c": 0.75}).select("a", "b", "c")
    rows = s.select("row_id", "rev", "n_all_time").distinct().crossJoin(F.broadcast(edges))  # one row of edges
    return rows.select("row_id", "rev", "n_all_time", F.when(F.col("n_all_time") <= F.col("a"), 1).when(F.col("n_all_time") <= F.col("b"), 2).when(F.col("n_all_time") <= F.col("c"), 3).otherwise(4).alias("quarter"))


@query("""SELECT speed, n_all_time, n, (sum(n) OVER (PARTITION BY speed ORDER BY n_all_time) - n / 2e0 + 5e-1)::DOUBLE AS midrank FROM (SELECT speed, n_all_time, count(*) AS n FROM scores_main WHERE n_all_time IS NOT NULL AND speed IS NOT NULL GROUP BY speed, n_all_time) x""")
def midrank(spark, sf):
    """Mid-ranks over distinct values, walked in chunks where a group has many."""
    return midranks(table(spark, sf, "scores_main"), ["speed"], "n_all_time").select("speed", "n_all_time", "n", F.col("rank").alias("midrank"))


@query(f"""SELECT game_id, count(*) AS n FROM chronology GROUP BY game_id HAVING {" OR ".join(f"count({c}) > 0 AND (count({c}) < count(*) OR min({c}) <> max({c}))" for c in ("white_elo", "black_elo", "utc_ms"))}""")
def conflict_keys(spark, sf):
    """Games whose records disagree."""
    return conflicts(table(spark, sf, "chronology"), ["game_id"], ["white_elo", "black_elo", "utc_ms"])


#: Position strings, some of them broken on purpose (fixed values).
_BOARDS = (
    ("start", "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"),
    ("queen up", "rnb1kbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 1 4"),
    ("endgame", "8/5k2/8/3P4/8/2K5/8/7r w - - 3 60"),
    ("seven ranks", "8/5k2/8/3P4/8/2K5/7r w - - 3 60"),
    ("nine squares", "8/5k3/8/3P4/8/2K5/8/7r w - - 3 60"),
    ("two kings", "8/5kk1/8/3P4/8/2K5/8/7r w - - 3 60"),
    ("five fields", "8/5k2/8/3P4/8/2K5/8/7r w - - 3"),
    ("promoted", "QQ6/5k2/8/8/8/2K5/8/8 b - - 0 70"),
    ("no board", "none"),
)
_PIECE = lambda c: f"(length(b) - length(replace(b, '{c}', '')))"
_BALANCE = " + ".join(f"{v} * ({_PIECE(p.upper())} - {_PIECE(p)})" for p, v in cols.PIECE_VALUES.items())


@query(f"""WITH f(name, fen) AS (VALUES {", ".join(f"('{n}', '{x}')" for n, x in _BOARDS)}, ('null', NULL)), g AS (SELECT *, split_part(fen, ' ', 1) AS b FROM f),
  r AS (SELECT name, [len(regexp_replace(x, '[0-9]', '', 'g')) + coalesce(list_sum(list_transform(regexp_extract_all(x, '[0-9]'), lambda d: d::INT)), 0) for x in string_split(b, '/')] AS squares FROM g)
  SELECT name, {_BALANCE} AS balance, {_PIECE("P")} AS white_p, {_PIECE("q")} AS black_q, coalesce(len(string_split(trim(fen), ' ')) = 6 AND len(string_split(b, '/')) = 8 AND regexp_full_match(b, '[prnbqkPRNBQK1-8/]+') AND list_min(squares) = 8 AND list_max(squares) = 8
    AND {_PIECE("K")} = 1 AND {_PIECE("k")} = 1 AND split_part(fen, ' ', 2) = 'w', false) AS valid FROM g JOIN r USING (name)""")
def board_strings(spark, sf):
    """Material and validity of position strings, white to move; the tables of this project hold none."""
    f = spark.createDataFrame([*_BOARDS, ("null", None)], "name string, fen string")
    n = cols.piece_counts(F.col("fen"))
    return f.select("name", cols.material_balance(F.col("fen")).alias("balance"), n["white_p"].alias("white_p"), n["black_q"].alias("black_q"), cols.valid_position(F.col("fen"), F.lit("w")).alias("valid"))
