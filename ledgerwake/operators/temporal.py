"""As-of joins, trailing counts, sessions, first events and outcomes over event histories.

Times are integers (epoch milliseconds). Rows of one entity are never gathered
in one task when the entity is hot: orders are walked by running_labels, and
pairs are joined within buckets of time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwake.operators.skew import running_labels
from ledgerwake.session import materialize, release


def _none() -> Column:
    return F.lit(None)


def _key(by: Sequence[str]) -> Column:
    """One column that is equal where all of ``by`` are; null where one is null."""
    if len(by) == 1:
        return F.col(by[0])
    return F.when(sum((F.col(c).isNull().cast("int") for c in by), F.lit(0)) == 0, F.to_json(F.struct(*by)))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    left_at: str,
    right_at: str,
    payload: Sequence[str],
    tie: str | None = None,
    direction: str = "backward",
    strict: bool = True,
    prefix: str = "asof_",
    target_rows: int = 100_000,
) -> DataFrame:
    """Every row of ``left`` with the nearest earlier (or later) row of ``right``.

    backward takes the greatest right_at before left_at (at or before it if not
    ``strict``), forward the least after it; among equal times the greatest
    ``tie`` backward, the least forward (a number), then the greatest payload.
    The whole right row is taken, so a null in its payload stays null. Adds
    right_at and the payload with ``prefix``; both are null where no row
    matches or where by or left_at is null. Repeated left rows stay; right rows with
    a null in by or right_at never match.
    """
    way = 1 if direction == "backward" else -1
    far = F.struct((F.col(right_at) * way).alias("t"), (F.col(tie) * way if tie else F.lit(0)).alias("k"), F.struct(*payload).alias("p"))
    r = right.select(_key(by).alias("__key"), (F.col(right_at) * way).cast("long").alias("__at"), far.alias("__value")).where("__key is not null and __at is not null")
    l = left.select(_key(by).alias("__key"), (F.col(left_at) * way).cast("long").alias("__at"), F.struct(*[left[c] for c in left.columns]).alias("__left"))
    sides = (0, 1) if strict else (1, 0)  # which of the two comes first at equal times
    r = r.select("*", F.lit(sides[1]).alias("__kind"), _none().cast(T.StructType(left.schema.fields)).alias("__left"))
    asked = l.where("__key is not null and __at is not null").select("__key", "__at", _none().cast(r.schema["__value"].dataType).alias("__value"), F.lit(sides[0]).alias("__kind"), "__left")
    runs = running_labels(r.unionByName(asked), "__key", "__at", "__value", None, ["__kind"], target_rows, "__prior", "__n")
    out = runs.where(F.col("__kind") == sides[0]).select("__left", "__prior")
    out = out.unionByName(l.where("__key is null or __at is null").select("__left", _none().cast(r.schema["__value"].dataType).alias("__prior")))
    then = [(F.col("__prior.t") * way).alias(f"{prefix}{right_at}"), *[F.col(f"__prior.p.{c}").alias(f"{prefix}{c}") for c in payload]]
    return out.select(*[F.col("__left")[c].alias(c) for c in left.columns], *then)


def window_counts(left: DataFrame, events: DataFrame, by: Sequence[str], row: Sequence[str], left_at: str, event_at: str, spans: Mapping[str, tuple[int, int]], target_rows: int = 100_000) -> DataFrame:
    """(row, one count per span): events of the same ``by`` with left_at + a <= event_at < left_at + b.

    Counts before both ends are read off one running count and subtracted, so
    no pairs are formed. ``row`` identifies rows of left; repeated ones count
    once. Null times and keys count nothing: such rows are left out.
    """
    e = events.select(_key(by).alias("__key"), F.col(event_at).cast("long").alias("__at")).where("__key is not null and __at is not null")
    ends = F.explode(F.array(*[F.struct(F.lit(i).alias("span"), F.lit(sign).alias("sign"), F.lit(o).cast("long").alias("off")) for i, s in enumerate(spans.values()) for o, sign in ((s[0], -1), (s[1], 1))]))
    q = left.select(_key(by).alias("__key"), F.col(left_at).cast("long").alias("__t"), F.struct(*row).alias("__row")).where("__key is not null and __t is not null").distinct()
    q = q.select("__key", "__row", "__t", ends.alias("x")).select("__key", (F.col("__t") + F.col("x.off")).alias("__at"), F.struct("__row", "x.span", "x.sign").alias("__ask"), F.lit(0).alias("__kind"))
    rows = q.unionByName(e.select("__key", "__at", _none().cast(q.schema["__ask"].dataType).alias("__ask"), F.lit(1).alias("__kind"))).withColumn("__none", _none().cast("long"))
    runs = running_labels(rows, "__key", "__at", "__none", lambda _: F.col("__kind") == 1, ["__kind"], target_rows, "__prior", "__n").where("__kind = 0")
    counts = [F.sum(F.when(F.col("__ask.span") == i, F.col("__ask.sign") * F.col("__n")).otherwise(0)).alias(name) for i, name in enumerate(spans)]
    return runs.groupBy(*[F.col("__ask")["__row"][c].alias(c) for c in row]).agg(*counts)


def sessionize(df: DataFrame, by: str, at: str, ties: Sequence[str], gap: int, target_rows: int = 100_000) -> DataFrame:
    """Adds session_no, from 1: a new session begins where the entity was idle for ``gap`` or more.

    Rows with a null in by or at are left out.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(at).isNotNull())
    opens = lambda prior: prior.isNull() | (F.col(at) - prior >= gap)
    return running_labels(rows, by, at, at, opens, ties, target_rows, "__prior", "session_no").drop("__prior")


def carried_sessions(df: DataFrame, carry: DataFrame, by: str, at: str, ties: Sequence[str], gap: int) -> DataFrame:
    """sessionize over new rows that continue from ``carry`` (by, last_at, session_no), one row an entity.

    A new row within ``gap`` of last_at stays in the carried session.
    """
    out = sessionize(df, by, at, ties, gap)
    ends = out.groupBy(by).agg(F.min(at).alias("__first"))
    base = ends.join(carry.select(by, F.col("last_at").alias("__last"), F.col("session_no").alias("__no")), by, "left")
    shift = F.when(F.col("__no").isNull(), 0).otherwise(F.col("__no") - (F.col("__first") - F.col("__last") < gap).cast("int"))
    return out.join(base.select(by, shift.alias("__shift")), by).withColumn("session_no", F.col("session_no") + F.col("__shift")).drop("__shift")


def merge_carry(carry: DataFrame, new: DataFrame, by: str, at: str, columns: Sequence[str]) -> DataFrame:
    """The latest (at, columns) of each entity: new rows, and carried ones that were not seen again."""
    rows = carry.select(by, at, *columns).unionByName(new.select(by, at, *columns))
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.max(F.struct(at, *columns)).alias("__x")).select(by, "__x.*")


def first_event(df: DataFrame, by: str, order: Sequence[str], keep: Column | None = None) -> DataFrame:
    """The first row of each entity, then ``keep``: an entity whose first row fails has none.

    An aggregate with map-side combine, not a window. Nulls in by or in the
    first order column are left out.
    """
    rows = df.where(F.col(by).isNotNull() & F.col(order[0]).isNotNull())
    first = rows.groupBy(F.col(by).alias("__by")).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("__x")).select("__x.*")
    return first if keep is None else first.where(keep)


def within_horizon(left: DataFrame, events: DataFrame, by: tuple[str, str], left_at: str, event_at: str, horizon: int, also: Column | None = None) -> DataFrame:
    """Pairs with equal keys and left_at < event_at <= left_at + horizon.

    Both sides are joined by key and by bucket of ``horizon``, so an entity's
    rows meet only where their times are near.
    """
    bucket = F.floor(F.col(left_at) / horizon).cast("long")
    l = left.withColumns({"__bucket": F.explode(F.array(bucket, bucket + 1)), "__k": F.col(by[0]), "__from": F.col(left_at)})
    e = events.withColumns({"__there": F.floor(F.col(event_at) / horizon).cast("long"), "__e": F.col(by[1]), "__when": F.col(event_at)})
    on = F.expr(f"__k = __e and __bucket = __there and __when > __from and __when <= __from + {horizon}")
    return l.join(e, on if also is None else on & also).drop("__bucket", "__there", "__k", "__e", "__from", "__when")


def first_outcome(
    left: DataFrame,
    events: DataFrame,
    row: Sequence[str],
    by: tuple[str, str],
    left_at: str,
    event_at: str,
    horizon: int,
    order: Sequence[str],
    take: Sequence[str],
    other: tuple[str, str],
    started: str | None = None,
    target_rows: int = 100_000,
) -> DataFrame:
    """(row, take): each left row's first event of left_at < event_at <= left_at + horizon; nulls if there is none.

    Events of the same key ``by`` count if their ``other`` differs from the left
    row's and, where ``started`` is given, they also started after left_at. The
    first is the least (event_at, order). ``row`` names columns that tell left rows
    apart and include key, left_at and other; repeated ones give one row. Events
    with a null in key, event_at, other or started never count; left rows with a null in key, time or
    other have no event.

    No pairs are formed. Events are walked from the last to the first, keeping
    the first event so far and the first of another ``other`` than that one's:
    whichever ``other`` a left row excludes, its answer is one of the two. Hot
    keys are split (see running_labels).
    """
    value = F.struct(F.col(event_at).cast("long").alias("t"), F.struct(*order).alias("k"), F.col(other[1]).alias("o"), F.struct(*take).alias("p"))
    begin = F.least(event_at, started) if started else F.col(event_at)
    known = [F.col(c).isNotNull() for c in (by[1], event_at, other[1], *([started] if started else []))]
    e = events
    for k in known:
        e = e.where(k)
    e = e.select(F.col(by[1]).alias("__key"), (-begin).cast("long").alias("__at"), value.alias("__value"), F.lit(1).alias("__kind"))
    asked = left.select(*row).distinct()
    have = [F.col(c).isNotNull() for c in (by[0], left_at, other[0])]
    q = asked.where(have[0] & have[1] & have[2]).select(F.col(by[0]).alias("__key"), (-F.col(left_at)).cast("long").alias("__at"), _none().cast(e.schema["__value"].dataType).alias("__value"), F.lit(0).alias("__kind"), F.struct(*row).alias("__row"))
    rows = q.unionByName(e.withColumn("__row", _none().cast(q.schema["__row"].dataType)))
    two = lambda prior: F.when(F.col("__value.o") != prior["o"], F.greatest("__value", prior))
    runs = running_labels(rows, "__key", "__at", "__value", None, ["__kind"], target_rows, "__first", least=True, second=("__next", two)).where("__kind = 0")
    best = F.when(F.col("__first.o") != F.col("__row")[other[0]], F.col("__first")).otherwise(F.col("__next"))
    out = runs.select("__row", best.alias("__x")).select(*[F.col("__row")[c].alias(c) for c in row], F.when(F.col("__x.t") <= F.col("__row")[left_at] + horizon, F.col("__x.p")).alias("__p"))
    none = asked.where(~(have[0] & have[1] & have[2])).withColumn("__p", _none().cast(out.schema["__p"].dataType))
    return out.unionByName(none).select(*row, *[F.col(f"__p.{c}").alias(c) for c in take])


def range_join(points: DataFrame, spans: DataFrame, at: str, low: str, high: str, width: int, by: tuple[str, str] | None = None) -> DataFrame:
    """Pairs with low <= at < high (and equal keys), joined by buckets of ``width``.

    ``width`` should be near the usual span; a longer one takes several buckets.
    """
    s = spans.where(F.col(high) > F.col(low)).withColumns({"__b": F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width))), "__low": F.col(low), "__high": F.col(high), "__s": F.col(by[1]) if by else F.lit(0)})
    p = points.withColumns({"__c": F.floor(F.col(at) / width), "__at": F.col(at), "__p": F.col(by[0]) if by else F.lit(0)})
    return p.join(s, F.expr("__b = __c and __p = __s and __at >= __low and __at < __high")).drop("__b", "__c", "__low", "__high", "__at", "__s", "__p")


def adjacency(games: DataFrame, game: str, sides: tuple[str, str], at: str, target_rows: int = 100_000) -> DataFrame:
    """(game, at, status): whether the game before was the same one for both players.

    ``unmapped`` where a side has no player; ``ambiguous`` where a player
    starts several games at this moment or at the moment before; ``left_boundary`` where
    one has no earlier game; ``mutual`` where both come from the same game against
    each other; else ``different``. Rows with a null time are left out; repeated rows
    count once.
    """
    pairs = F.array(*[F.struct(F.col(a).alias("player"), F.col(b).alias("opponent")) for a, b in (sides, sides[::-1])])
    played = games.where(F.col(at).isNotNull()).select(F.col(game).alias("__game"), F.col(at).cast("long").alias("__at"), F.explode(pairs).alias("x")).select("__game", "__at", "x.*").distinct()
    moments = played.where("player is not null").groupBy("player", "__at").agg(F.count("*").alias("n"), F.min(F.struct("__game", "opponent")).alias("one"))
    runs = running_labels(moments.withColumn("__seen", F.struct("__at", "n", "one")), "player", "__at", "__seen", None, [], target_rows, "__prior")
    own = played.join(runs.select("player", "__at", "n", "__prior"), ["player", "__at"], "left")
    before = F.struct("__prior.__at", "__prior.one.__game")
    both = own.groupBy("__game", "__at").agg(
        F.count("player").alias("players"),
        F.max(F.greatest("n", F.coalesce("__prior.n", F.lit(1)))).alias("n"),
        F.count("__prior").alias("known"),
        (F.min(before) == F.max(before)).alias("same"),
        F.bool_and(F.col("__prior.one.opponent") == F.col("opponent")).alias("facing"),
    )
    status = F.when(F.col("players") != 2, "unmapped").when(F.col("n") > 1, "ambiguous").when(F.col("known") < 2, "left_boundary").when(F.col("same") & F.col("facing"), "mutual").otherwise("different")
    return both.select(F.col("__game").alias(game), F.col("__at").alias(at), status.alias("status"))


#: Rating points of one unit of the Glicko-2 scale.
GLICKO_SCALE = 173.7178


@dataclass(frozen=True)
class ReplayLaw:
    """Settings of rating_replay: bounds of the deviation, growth of the variance per day, and the volatility's."""

    periods_a_day: float = 0.21436
    least_rd: float = 45.0
    most_rd: float = 500.0
    most_sigma: float = 0.1
    tau: float = 0.75
    start_sigma: float = 0.09


def grown(rd: float, sigma: float, days: float, law: ReplayLaw) -> float:
    """The deviation after ``days`` without a game."""
    periods = max(0.0, days) * law.periods_a_day
    return min(law.most_rd, max(law.least_rd, math.sqrt(rd * rd + (GLICKO_SCALE * sigma) ** 2 * periods)))


def after_game(rating: float, rd: float, sigma: float, other: float, other_rd: float, score: float, law: ReplayLaw) -> tuple[float, float, float]:
    """Rating, deviation and volatility after one game, by the Glicko-2 rules (Glickman 2012)."""
    phi, phi_o = rd / GLICKO_SCALE, other_rd / GLICKO_SCALE
    g = 1 / math.sqrt(1 + 3 * phi_o * phi_o / math.pi**2)
    expected = 1 / (1 + math.exp(-g * (rating - other) / GLICKO_SCALE))
    v = 1 / max(g * g * expected * (1 - expected), 1e-12)
    delta = v * g * (score - expected)
    a = math.log(sigma * sigma)

    def f(x: float) -> float:
        e = math.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / law.tau**2

    lo, hi = a, math.log(delta**2 - phi**2 - v) if delta**2 > phi**2 + v else a - law.tau
    while hi < a and f(hi) < 0:
        hi -= law.tau
    f_lo, f_hi = f(lo), f(hi)
    while abs(hi - lo) > 1e-6:  # regula falsi with halved weights
        mid = lo + (lo - hi) * f_lo / (f_hi - f_lo)
        f_mid = f(mid)
        if f_mid * f_hi <= 0:
            lo, f_lo = hi, f_hi
        else:
            f_lo /= 2
        hi, f_hi = mid, f_mid
    s = min(law.most_sigma, math.exp(lo / 2))
    new = 1 / math.sqrt(1 / (phi * phi + s * s) + 1 / v)
    return rating + GLICKO_SCALE * new * new * g * (score - expected), min(law.most_rd, max(law.least_rd, GLICKO_SCALE * new)), s


def _last_n(df: DataFrame, w: int) -> DataFrame:
    """Adds the features of the first ``w`` of the structs (no, t, v) of ``xs``, which run backward in time.

    Sums come from one walk over the values, taken from the first of them against cancellation.
    """
    at = lambda i: F.get("xs", F.lit(i))["t"]
    base = F.get("xs", F.lit(0))["v"]
    df = df.withColumn("z", F.transform(F.slice("xs", 1, w), lambda x: x["v"] - base)).withColumn("miss", F.size(F.filter("z", lambda x: x.isNull())))
    none = F.struct(*[F.lit(0.0).alias(c) for c in ("i", "s", "ss", "si")])
    step = lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["s"] + x).alias("s"), (a["ss"] + x * x).alias("ss"), (a["si"] + x * (a["i"] - (w - 1) / 2)).alias("si"))
    tie = F.coalesce(at(w - 1) == at(w), F.lit(False))
    good = (F.size("xs") >= w) & F.get("xs", F.lit(0))["v"].isNotNull() & (F.col("miss") == 0) & ~tie
    df = df.withColumn("ok", good).withColumns({"a": F.when(F.col("ok"), F.aggregate("z", none, step)), "sorted": F.when(F.col("ok"), F.array_sort("z"))})
    syy = F.greatest(F.col("a.ss") - F.pow(F.col("a.s"), 2) / w, F.lit(0.0))

    def quantile(p: float) -> Column:
        low = int(p * (w - 1))
        a, b = F.get("sorted", F.lit(low)), F.get("sorted", F.lit(min(low + 1, w - 1)))
        return a + (b - a) * (p * (w - 1) - low)

    numbers = {
        "sd": F.sqrt(syy / (w - 1)),
        "iqr": quantile(0.75) - quantile(0.25),
        "detrended": F.sqrt(F.greatest(syy - F.pow(F.col("a.si"), 2) / (w * (w * w - 1) / 12), F.lit(0.0)) / (w - 2)),
        "span": (at(0) - at(w - 1)) / 86_400_000,
    }
    missing = F.when(F.size("xs") >= w, F.size(F.filter(F.slice("xs", 1, w), lambda x: x["v"].isNull())))
    df = df.withColumns({**{f"{name}{w}": F.when(F.col("ok"), c) for name, c in numbers.items()}, f"missing{w}": missing, f"tie{w}": tie})
    return df.drop("z", "miss", "ok", "a", "sorted")


def last_n_features(history: DataFrame, targets: DataFrame, by: str, at: str, value: str, ties: Sequence[str], row: Sequence[str], target_at: str, widths: Sequence[int] = (50, 100), target_rows: int = 100_000) -> DataFrame:
    """(row, n_prior, age_days and, for each width W, sdW, iqrW, detrendedW, spanW, missingW, tieW) of each target row.

    They describe the last W rows of ``history`` strictly before the target's time, in the order of
    (``at``, ``ties``): standard deviation, interquartile range, standard deviation about a straight line over
    the position, days from the first to the last, and how many have no value. tieW says that the W-th row
    shares its time with the one before it, so that the cut is arbitrary. With a tie, a missing value or fewer than W rows the
    numbers are null. n_prior counts up to max(widths) + 1, age_days is the time since the last row.

    Rows are numbered per entity (see running_labels) and kept in blocks of max(widths) + 1; a target
    meets its own block and the one before, so its cost does not depend on the entity's rows. ``row`` tells
    targets apart; repeated ones give one row. Null keys and times match nothing; repeated history rows count once.
    """
    size = max(widths) + 1
    h = history.select(F.col(by).alias("b"), F.col(at).cast("long").alias("t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(ties)], F.col(value).cast("double").alias("v")).where("b is not null and t is not null").distinct()
    keys = [f"k{i}" for i in range(len(ties))]
    asked = targets.select(*row, F.col(by).alias("__b"), F.col(target_at).cast("long").alias("__t")).distinct()
    q = asked.where("__b is not null and __t is not null").select(F.col("__b").alias("b"), F.col("__t").alias("t"), F.struct(*row).alias("ask"))
    rows = h.withColumns({"kind": F.lit(1), "ask": _none().cast(q.schema["ask"].dataType)}).unionByName(q.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    runs = running_labels(rows, "b", "t", "t", lambda _: F.col("kind") == 1, ["kind", *keys, "v"], target_rows, "__prior", "no")
    block = F.floor((F.col("no") - 1) / size)
    blocks = runs.where("kind = 1").select("b", F.explode(F.array(block, block + 1)).alias("block"), F.struct(F.col("no").alias("no"), "t", "v").alias("x")).groupBy("b", "block").agg(F.collect_list("x").alias("xs"))  # at most two blocks of rows
    wanted = runs.where("kind = 0").select("b", "t", "ask", F.col("no").alias("n"), block.alias("block"))
    near = wanted.join(blocks, ["b", "block"], "left")
    last = F.reverse(F.array_sort(F.filter("xs", lambda x: (x["no"] <= F.col("n")) & (x["no"] > F.col("n") - size))))
    near = near.select("ask", "t", F.coalesce(last, F.array().cast(near.schema["xs"].dataType)).alias("xs"))
    near = near.withColumns({"n_prior": F.size("xs"), "age_days": (F.col("t") - F.get("xs", F.lit(0))["t"]) / 86_400_000})
    for w in widths:
        near = _last_n(near, w)
    found = near.select(*[F.col("ask")[c].alias(c) for c in row], *[c for c in near.columns if c not in ("ask", "t", "xs")])
    return found.unionByName(asked.where("__b is null or __t is null").select(*row, F.lit(0).alias("n_prior")), allowMissingColumns=True)


def spaced(df: DataFrame, by: str, at: str, horizon: int) -> DataFrame:
    """(by, at): times taken greedily from the first on, each more than ``horizon`` after the last one taken.

    Every time knows its successor, the first time more than the horizon later; the
    taken ones are the chain of successors of the entity's first. The chain is
    followed by doubling: rounds grow with the logarithm of its length, and no task gets a whole
    entity. Rows with a null in by or at are left out; repeated ones count once.
    """
    times = df.select(F.col(by).alias("b"), F.col(at).cast("long").alias("t")).na.drop().distinct()
    asked = times.withColumn("from", F.col("t") + horizon)
    to = asof_join(asked, times.select("b", F.col("t").alias("u")).withColumn("one", F.lit(1)), ["b"], "from", "u", ["one"], direction="forward")
    jumps = materialize(to.select("b", "t", F.col("asof_u").alias("to")), "jumps")
    taken = materialize(jumps.groupBy("b").agg(F.min("t").alias("t")), "taken")
    while True:
        # what is taken grows by the ends of jumps of 1, 2, 4, ... steps
        more = taken.join(jumps, ["b", "t"]).where("to is not null").select("b", F.col("to").alias("t"))
        grown_by = materialize(taken.unionByName(more).distinct(), "taken")
        same = grown_by.count() == taken.count()
        release(taken)
        taken = grown_by
        if same:
            release(jumps)
            return taken.select(F.col("b").alias(by), F.col("t").alias(at))
        ends = jumps.select("b", F.col("t").alias("to"), F.col("to").alias("further"))
        doubled = materialize(jumps.join(ends, ["b", "to"], "left").select("b", "t", F.col("further").alias("to")), "jumps")
        release(jumps)
        jumps = doubled


def rating_replay(games: DataFrame, pool: str, at: str, game: str, players: tuple[str, str], ratings: tuple[str, str], score: str, observed: str, law: ReplayLaw | None = None) -> DataFrame:
    """Two-party states of each pool's games, replayed strictly in the order of (``at``, ``game``).

    Ratings are those that the games bring along; deviation, volatility and
    number of games of both players are carried. Per game the two states are
    read (the deviation grown by the days since the player's last game) and then both
    updated, but only where ``observed`` holds. Columns: pool, at, game, rd_a, rd_b,
    sigma_a, sigma_b, games_a, games_b (all before the game), after_a, after_b
    (the ratings that it gives). Rows with a null in a player, rating, score or time,
    and games against oneself, are left out. As games couple players, only pools
    run in parallel: a pool is one task by nature.
    """
    import pandas as pd

    law = law or ReplayLaw()
    (a, b), (ra, rb) = players, ratings
    kept = games.select(pool, at, game, F.col(a).alias("__a"), F.col(b).alias("__b"), F.col(ra).cast("double").alias("__ra"), F.col(rb).cast("double").alias("__rb"), F.col(score).cast("double").alias("__s"), F.coalesce(observed, F.lit(False)).alias("__o"))
    kept = kept.na.drop(subset=[at, "__a", "__b", "__ra", "__rb", "__s"]).where("__a != __b")

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([at, game, "__a", "__b"], kind="stable")
        state: dict[int, tuple[float, float, int, int]] = {}
        out = []
        for now, x, y, p, q, s, seen in zip(rows[at], rows["__a"], rows["__b"], rows["__ra"], rows["__rb"], rows["__s"], rows["__o"], strict=True):
            (d1, s1, n1, l1), (d2, s2, n2, l2) = (state.get(k, (law.most_rd, law.start_sigma, 0, now)) for k in (x, y))
            d1, d2 = grown(d1, s1, (now - l1) / 86_400_000, law), grown(d2, s2, (now - l2) / 86_400_000, law)
            one, two = after_game(p, d1, s1, q, d2, s, law), after_game(q, d2, s2, p, d1, 1 - s, law)
            out.append((d1, d2, s1, s2, n1, n2, one[0], two[0]))
            if seen:
                state[x], state[y] = (one[1], one[2], n1 + 1, now), (two[1], two[2], n2 + 1, now)
        names = ["rd_a", "rd_b", "sigma_a", "sigma_b", "games_a", "games_b", "after_a", "after_b"]
        return pd.concat([rows[[pool, at, game]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    schema = f"{pool} {kinds[pool]}, {at} {kinds[at]}, {game} {kinds[game]}, rd_a double, rd_b double, sigma_a double, sigma_b double, games_a long, games_b long, after_a double, after_b double"
    return kept.groupBy(pool).applyInPandas(replay, schema)


def unknown_until(df: DataFrame, reached: Column, anchor: str, horizon: int, observed_until: int) -> Column:
    """1 if reached, 0 if the whole horizon was observed, else null (censored)."""
    return F.when(reached, 1).when(F.col(anchor) + horizon < observed_until, 0)


def calendar(df: DataFrame, by: Sequence[str], at: str, step: int, low: Callable[[str], Column] = F.min, high: Callable[[str], Column] = F.max) -> DataFrame:
    """(by, at) for every step between each group's first and last."""
    return df.groupBy(*by).agg(low(at).alias("__lo"), high(at).alias("__hi")).select(*by, F.explode(F.sequence("__lo", "__hi", F.lit(step))).alias(at))


def separated_top(df: DataFrame, by: str, at: str, value: str, top: int, apart: int) -> DataFrame:
    """(by, at, value, rank): greatest values of each group, none within ``apart`` of a greater one taken before.

    Greedy, so a group's rows meet in one task: give it seeds (local maxima,
    rows above a threshold), which are few. Ties go to the earlier time.
    """
    import pandas as pd

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        taken: list[int] = []
        keep = []
        rows = rows.sort_values([value, at], ascending=[False, True], kind="stable")
        for i, t in enumerate(rows[at]):
            if len(taken) < top and all(abs(t - u) >= apart for u in taken):
                taken.append(t)
                keep.append(i)
        return rows.iloc[keep].assign(rank=range(1, len(keep) + 1))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(by, at, value).na.drop().groupBy(by).applyInPandas(pick, f"{by} {kinds[by]}, {at} {kinds[at]}, {value} {kinds[value]}, rank long")
