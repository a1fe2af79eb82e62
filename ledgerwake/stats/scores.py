"""Scores, matching, resampling and balance as aggregations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwake.operators.skew import exact_quantiles
from ledgerwake.session import materialize


def pair_excluded_score(df: DataFrame, entity: str, other: str, y: str) -> DataFrame:
    """(entity, other, n, score): the entity's mean of y without its rows with ``other``.

    Entity sums less pair sums; null where nothing is left.
    """
    pair = df.where(F.col(entity).isNotNull() & F.col(other).isNotNull() & F.col(y).isNotNull()).groupBy(entity, other).agg(F.count("*").alias("np"), F.sum(F.col(y).cast("double")).alias("sp"))
    whole = pair.groupBy(entity).agg(F.sum("np").alias("n"), F.sum("sp").alias("s"))
    return pair.join(whole, entity).select(entity, other, (F.col("n") - F.col("np")).alias("n"), ((F.col("s") - F.col("sp")) / F.expr("nullif(n - np, 0)")).alias("score"))


def fold_of(user: Column, folds: int) -> Column:
    """A user's fold, by md5."""
    return (F.conv(F.substring(F.md5(user.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % folds).cast("int")


def _without_folds(base: DataFrame, keys: Sequence[str], folds: int) -> DataFrame:
    """(keys, jf, rf, n, s): sums of ``base`` (keys, own_fold, other_fold, n, s) over the rows of neither fold jf nor rf.

    Every row of sums goes to at most ``folds`` squared fold pairs.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("jf"), F.lit(r).alias("rf")) for j in range(folds) for r in range(folds)])).alias("x")
    out = base.select("*", pairs).where("x.jf != own_fold and x.rf != own_fold and x.jf != other_fold and x.rf != other_fold")
    return out.groupBy(*keys, F.col("x.jf").alias("jf"), F.col("x.rf").alias("rf")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def expanding_reference(df: DataFrame, entity: str, other: str, cell: str, at: str, y: str, strength: float = 50.0, folds: int = 4) -> DataFrame:
    """(cell, at, jf, rf, reference): for every time and pair of folds, the cell's rate over strictly earlier times, shrunk to the overall one.

    Rows whose entity or other party lies in either fold take no part, so a row may be
    judged by a reference that neither of its parties has shaped. The overall rate has half a success added to one trial.
    A (time, fold pair) with nothing before it has no reference. Sums by cell, time and folds come
    first; what follows grows with the numbers of cells, times and fold pairs only.
    """
    base = df.where(F.col(y).isNotNull()).groupBy(F.col(cell).alias("cell"), F.col(at).alias("at"), fold_of(F.col(entity), folds).alias("own_fold"), fold_of(F.col(other), folds).alias("other_fold")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    sums = materialize(_without_folds(base, ["cell", "at"], folds), "fold-sums")
    times = materialize(base.select("at").distinct(), "fold-times")
    cells = base.select("cell").distinct()
    later = times.select(F.col("at").alias("now"))
    before = sums.join(F.broadcast(later), F.col("at") < F.col("now"))  # the few times of a panel
    own = before.groupBy("cell", "now", "jf", "rf").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = own.groupBy("now", "jf", "rf").agg(((F.sum("s") + 0.5) / (F.sum("n") + 1)).alias("p"))
    grid = whole.crossJoin(F.broadcast(cells))  # times, fold pairs and cells are the result's size
    out = grid.join(own, ["cell", "now", "jf", "rf"], "left").na.fill(0, ["n", "s"])
    return out.select(F.col("cell").alias(cell), F.col("now").alias(at), "jf", "rf", ((F.col("s") + strength * F.col("p")) / (F.col("n") + strength)).alias("reference"))


def crossfit_scores(history: DataFrame, queries: DataFrame, entity: str, other: str, at: str, cell: str, y: str, cutoff: int, strength: float = 50.0, folds: int = 4) -> DataFrame:
    """Leave-pair-out means of each (entity, other) of ``queries`` at one time cutoff, raw and adjusted.

    Only rows strictly before ``cutoff`` count, and none of the pair's own. Columns: entity, other, n, raw,
    expected, adjusted (raw less expected), counterparts, pair_removed. expected is the mean reference of
    the same rows: for each the rate of its cell over the rows before the cutoff in which neither party lies in
    the fold of ``entity`` or ``other``, shrunk as in expanding_reference. Nothing left gives nulls, an
    empty reference a null expected.

    All sums are taken by pair and cell first; entity sums less pair sums give the rest, so no pairs of rows are formed.
    """
    h = history.where((F.col(at) < cutoff) & F.col(y).isNotNull()).na.drop(subset=[entity, other, cell])
    base = materialize(h.groupBy(F.col(entity).alias("j"), F.col(other).alias("i"), F.col(cell).alias("c")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")), "pair-cells")
    by_fold = base.groupBy("c", fold_of(F.col("j"), folds).alias("own_fold"), fold_of(F.col("i"), folds).alias("other_fold")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    sums = materialize(_without_folds(by_fold, ["c"], folds), "fold-sums")
    whole = sums.groupBy("jf", "rf").agg(((F.sum("s") + 0.5) / (F.sum("n") + 1)).alias("p"))
    model = whole.crossJoin(F.broadcast(base.select("c").distinct())).join(sums, ["c", "jf", "rf"], "left").na.fill(0, ["n", "s"])  # cells by fold pairs
    model = model.groupBy("c", "jf").agg(F.map_from_entries(F.collect_list(F.struct("rf", ((F.col("s") + strength * F.col("p")) / (F.col("n") + strength)).alias("p")))).alias("by_rf"))
    rated = base.withColumn("jf", fold_of(F.col("j"), folds)).join(F.broadcast(model), ["c", "jf"], "left")
    weights = [(F.col("n") * F.col("by_rf")[r]).alias(f"m{r}") for r in range(folds)]
    names = [f"m{r}" for r in range(folds)]
    pair = materialize(rated.select("j", "i", "n", "s", *weights).groupBy("j", "i").agg(*[F.sum(c).alias(c) for c in ("n", "s", *names)]), "pair-sums")
    mine = pair.groupBy("j").agg(F.count("*").alias("__k"), *[F.sum(c).alias(f"__{c}") for c in ("n", "s", *names)])
    q = queries.select(F.col(entity).alias("j"), F.col(other).alias("i")).na.drop().distinct()
    out = q.join(mine, "j", "left").join(pair, ["j", "i"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = zero("__n") - zero("n")
    rf = fold_of(F.col("i"), folds)
    expected = F.coalesce(*[F.when(rf == r, (F.col(f"__m{r}") - zero(f"m{r}")) / n) for r in range(folds)])
    raw = (F.col("__s") - zero("s")) / n
    out = out.select("j", "i", n.alias("n"), F.when(n > 0, raw).alias("raw"), F.when(n > 0, expected).alias("expected"), (zero("__k") - F.col("n").isNotNull().cast("int")).alias("counterparts"), zero("n").alias("pair_removed"))
    return out.select(F.col("j").alias(entity), F.col("i").alias(other), "n", "raw", "expected", (F.col("raw") - F.col("expected")).alias("adjusted"), "counterparts", "pair_removed")


def standardize(df: DataFrame, group: str, strata: Sequence[str], y: str, cluster: str, least: int = 5) -> DataFrame:
    """(group, n, rate, se): rates on the strata that every group has at least ``least`` rows in, weighted alike.

    se is that of the rows' influences, summed by ``cluster``, with the strata's weights taken as given.
    Rows with a null in group, strata, y or cluster are left out.
    """
    own = df.na.drop(subset=[group, *strata, y, cluster]).groupBy(cluster, group, *strata).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    cell = own.groupBy(group, *strata).agg(F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("m"))
    groups = cell.agg(F.count_distinct(group)).first()[0]
    shared = cell.groupBy(*strata).agg(F.min("n").alias("lo"), F.count("*").alias("g"), F.sum("n").alias("w")).where((F.col("lo") >= least) & (F.col("g") == groups)).select(*strata, "w")
    kept = cell.join(shared, list(strata))
    rates = kept.groupBy(group).agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("w")) / F.sum("w")).alias("rate"), F.sum("w").alias("__all"))
    part = own.join(kept.select(group, *strata, "m", "w", F.col("n").alias("__cell")), [group, *strata])
    part = part.groupBy(cluster, group).agg(F.sum(F.col("w") / F.col("__cell") * (F.col("s") - F.col("n") * F.col("m"))).alias("i"))
    return rates.join(part.groupBy(group).agg(F.sum(F.col("i") ** 2).alias("v")), group).select(group, "n", "rate", (F.sqrt("v") / F.col("__all")).alias("se"))


def weighted_corr(x: Column, y: Column, w: Column) -> Column:
    """Weighted Pearson correlation as one aggregate."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov, vx, vy = F.sum(w * x * y) - sx * sy / n, F.sum(w * x * x) - sx * sx / n, F.sum(w * y * y) - sy * sy / n
    return F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy))


def midranks(df: DataFrame, by: Sequence[str], value: str, target_rows: int = 100_000) -> DataFrame:
    """(by, value, n, rank): weighted mid-ranks over distinct values.

    Groups of many distinct values are walked in chunks (see skew.running_labels).
    Rows with a null in by or value, and NaN values, are left out.
    """
    h = df.select(*by, value).where(" and ".join(f"`{c}` is not null" for c in (*by, value))).where(~F.isnan(F.col(value).cast("double")))
    h = h.groupBy(*by, value).agg(F.count("*").alias("n"))
    upto = cumulative(h, list(by), value, "n", target_rows)
    return upto.select(*by, value, "n", (F.col("__upto") - F.col("n") / 2.0 + 0.5).alias("rank"))


def cumulative(df: DataFrame, by: Sequence[str], value: str, n: str, target_rows: int = 100_000) -> DataFrame:
    """Adds __upto, the sum of ``n`` over the group's rows with values up to the row's; values are distinct within a group.

    Rows are laid out by range, the sums of the ranges (one row a group and range) are added up, and
    each range sums its own rows: no task gets a whole group.
    """
    total = df.count()
    if total <= target_rows:
        w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
        return df.withColumn("__upto", F.sum(n).over(w.orderBy(value)))
    laid = materialize(df.repartitionByRange(max(2, -(-3 * total // target_rows)), *by, value).withColumn("__part", F.spark_partition_id()), "cumulative")
    sums = laid.groupBy(*by, "__part").agg(F.sum(n).alias("__own"))
    along = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "__part", F.coalesce(F.sum("__own").over(along), F.lit(0)).alias("__before"))
    own = laid.withColumn("__in", F.sum(n).over(Window.partitionBy(*by, "__part").orderBy(value)))
    return own.join(before, [*by, "__part"]).withColumn("__upto", F.col("__in") + F.col("__before")).drop("__in", "__before", "__part")


def imputed(df: DataFrame, cell: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds <c>_filled (the cell's exact median where null or NaN) and <c>_missing."""
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    key = F.to_json(F.struct(*cell), {"ignoreNullFields": "false"})  # null is a cell of its own
    out = df.withColumn("__cell", key)
    for c in columns:
        medians = exact_quantiles(out.select("__cell", c), "__cell", c, {f"__m_{c}": 0.5}).drop("n")
        out = out.join(medians, "__cell", "left")
    return out.select(*df.columns, *[F.coalesce(value[c], F.col(f"__m_{c}")).alias(f"{c}_filled") for c in columns], *[value[c].isNull().alias(f"{c}_missing") for c in columns])


def matched_effect(df: DataFrame, treated: str, strata: Sequence[str], y: str, cluster: str) -> DataFrame:
    """One row of coarsened exact matching: n_treated, n_control, effect on the treated, its se, strata.

    se is that of the rows' influences summed by ``cluster``, with the strata's weights taken as given. Rows
    with a null in treated, strata, y or cluster are left out.
    """
    own = df.na.drop(subset=[treated, *strata, y, cluster]).groupBy(cluster, *strata).agg(*[f.alias(a) for t, k in ((F.col(treated), 1), (~F.col(treated), 0)) for f, a in ((F.count_if(t), f"n{k}"), (F.sum(F.when(t, F.col(y).cast("double")).otherwise(0.0)), f"s{k}"))])
    cell = own.groupBy(*strata).agg(*[F.sum(c).alias(f"t{c}") for c in ("n1", "n0", "s1", "s0")]).where("tn1 > 0 and tn0 > 0").withColumns({"m1": F.col("ts1") / F.col("tn1"), "m0": F.col("ts0") / F.col("tn0")})
    out = cell.agg(F.sum("tn1").alias("n_treated"), F.sum("tn0").alias("n_control"), (F.sum((F.col("m1") - F.col("m0")) * F.col("tn1")) / F.sum("tn1")).alias("effect"), F.count("*").alias("strata"))
    influence = F.col("s1") - F.col("n1") * F.col("m1") - F.col("tn1") / F.col("tn0") * (F.col("s0") - F.col("n0") * F.col("m0"))
    v = own.join(cell, list(strata)).groupBy(cluster).agg(F.sum(influence).alias("i")).agg(F.sum(F.col("i") ** 2).alias("v"))
    return out.join(F.broadcast(v)).select("n_treated", "n_control", "effect", (F.sqrt("v") / F.col("n_treated")).alias("se"), "strata")  # one row each


def balance(df: DataFrame, treated: str, columns: Sequence[str]) -> DataFrame:
    """(covariate, mean_1, mean_0, smd): standardised mean differences; nulls and NaN left out."""
    cols = F.explode(F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    long = df.where(F.col(treated).isNotNull()).select(F.col(treated).alias("t"), cols).select("t", "x.*").where("v is not null and not isnan(v)")
    one, two = F.when(F.col("t"), F.col("v")), F.when(~F.col("t"), F.col("v"))
    s = long.groupBy("covariate").agg(F.avg(one).alias("mean_1"), F.avg(two).alias("mean_0"), F.sqrt((F.var_samp(one) + F.var_samp(two)) / 2).alias("sd"))
    return s.select("covariate", "mean_1", "mean_0", ((F.col("mean_1") - F.col("mean_0")) / F.expr("nullif(sd, 0)")).alias("smd"))


#: A prime; draws are polynomials of degree 3 over its field, so any four units are drawn independently.
PRIME = (1 << 31) - 1


def unit_number(unit: Column) -> Column:
    """A number below PRIME of a unit: the first 15 hex digits of md5, so that any system gives the same."""
    return F.conv(F.substring(F.md5(unit.cast("string").cast("binary")), 1, 15), 16, 10).cast("long") % PRIME


def draw_coefficients(seed: int, draw: int) -> tuple[int, int, int, int]:
    return tuple(int(hashlib.md5(f"{seed}|{draw}|{j}".encode()).hexdigest()[:15], 16) % PRIME for j in range(4))


def draw_number(x: Column | np.ndarray, a: object, b: object, c: object, d: object) -> Column | np.ndarray:
    """The unit's number in a draw: a x^3 + b x^2 + c x + d."""
    return (((a * x + b) % PRIME * x + c) % PRIME * x + d) % PRIME


def poisson_weight(number: Column) -> Column:
    """A Poisson(1) weight of a draw's number (cut at 9)."""
    u, cut, p, steps = (number + 0.5) / float(PRIME), 0.0, math.exp(-1), F.lit(0)
    for k in range(9):
        cut += p / math.factorial(k)
        steps = steps + (u > cut).cast("int")
    return steps


def bootstrap(df: DataFrame, cluster: str, y: str, draws: int, seed: int = 1) -> DataFrame:
    """(draw, estimate): means under Poisson(1) weights of clusters, hashed from seed, draw and cluster.

    Clusters are summed first; the draws multiply clusters, not rows, and any run gives
    the same weights.
    """
    own = df.where(F.col(cluster).isNotNull() & F.col(y).isNotNull()).groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s")).withColumn("x", unit_number(F.col(cluster)))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("draw"), *[F.lit(v).cast("long").alias(c) for v, c in zip(draw_coefficients(seed, d), "abcd", strict=True)]) for d in range(1, draws + 1)])).alias("z")
    w = own.select("n", "s", "x", each).select("n", "s", "z.draw", poisson_weight(draw_number(F.col("x"), F.col("z.a"), F.col("z.b"), F.col("z.c"), F.col("z.d"))).alias("w"))
    return w.groupBy("draw").agg((F.sum(F.col("w") * F.col("s")) / F.expr("nullif(sum(w * n), 0)")).alias("estimate"))


#: Draws that one task makes of one cell's units.
DRAWS_A_TASK = 25


def rematch(df: DataFrame, cell: Sequence[str], unit: str, treated: str, y: str, draws: int, per_case: int = 1, seed: int = 1) -> DataFrame:
    """(draw, pairs, effect): cases matched 1:k to controls of their cell by seeded hash, again in each draw.

    Cases and controls are put in the order of their draw number (then unit and y) and paired by
    position. A cell's units meet in one task, so cells should be fine; they are sent once
    for every DRAWS_A_TASK draws, not once a draw.
    """
    r = df.where(F.col(treated).isNotNull() & F.col(y).isNotNull()).na.drop(subset=list(cell))
    r = r.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(cell)], F.coalesce(F.col(unit).cast("string"), F.lit("")).alias("unit"), F.col(treated).alias("t"), F.col(y).cast("double").alias("v"), F.explode(F.sequence(F.lit(1), F.lit(draws), F.lit(DRAWS_A_TASK))).alias("first"))
    r = r.withColumn("x", unit_number(F.col("unit")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["unit", "v"])  # equal numbers stay in this order
        sides = [(own["v"].to_numpy(), own["x"].to_numpy()) for own in (pdf[pdf["t"]], pdf[~pdf["t"]])]
        first, out = int(pdf["first"].iloc[0]), []
        for draw in range(first, min(first + DRAWS_A_TASK, draws + 1)):
            law = draw_coefficients(seed, draw)
            case, control = (v[np.argsort(draw_number(x, *law), kind="stable")] for v, x in sides)
            starts = np.arange(0, len(control), per_case)
            pairs = min(len(case), len(starts))
            if pairs:
                means = np.add.reduceat(control, starts) / np.minimum(per_case, len(control) - starts)
                out.append((draw, pairs, float((case[:pairs] - means[:pairs]).sum())))
        return pd.DataFrame(out, columns=["draw", "pairs", "s"])

    own = r.groupBy(*[f"__c{i}" for i in range(len(cell))], "first").applyInPandas(run, "draw int, pairs long, s double")
    return own.groupBy("draw").agg(F.sum("pairs").alias("pairs"), (F.sum("s") / F.sum("pairs")).alias("effect"))


def randomized(df: DataFrame, entity: str, y: str, x: str, unit: str, draws: int, seed: int = 1) -> DataFrame:
    """(draw, statistic): sum of x over as many of each entity's rows as had y, chosen anew by hash; draw 0 is as observed.

    All rows of an entity are as likely to be chosen: those of least draw number (then unit and x). They
    meet in one task, which makes all draws; rows are sent once, not once a draw.
    """
    r = df.where(F.col(y).isNotNull() & F.col(x).isNotNull() & F.col(entity).isNotNull()).select(F.col(entity).alias("e"), F.col(y).cast("boolean").alias("y"), F.col(x).cast("double").alias("x"), F.coalesce(F.col(unit).cast("string"), F.lit("")).alias("unit"))
    r = r.withColumn("id", unit_number(F.col("unit")))
    seen = r.where("y").agg(F.sum("x").alias("statistic")).select(F.lit(0).alias("draw"), "statistic")

    def chosen(own: pd.DataFrame) -> np.ndarray:
        """The sums of whole entities' rows, for each draw."""
        keys, x, ids = own["e"].to_numpy(), own["x"].to_numpy(), own["id"].to_numpy()
        no = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
        most, size = np.bincount(no, own["y"].to_numpy(float)), np.bincount(no)
        first = np.arange(len(no)) - (np.cumsum(size) - size)[no] < most[no]  # in order of the draw
        return np.array([x[np.argsort(no * PRIME + draw_number(ids, *draw_coefficients(seed, d + 1)), kind="stable")][first].sum() for d in range(draws)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, parts = np.zeros(draws), []
        for b in batches:
            if not len(b):
                continue
            keys = b["e"].to_numpy()
            cut = len(b) - int(np.argmax(keys[::-1] != keys[-1])) if keys[0] != keys[-1] else 0
            if cut or parts and parts[-1]["e"].iloc[-1] != keys[0]:  # all before the last entity is whole
                out += chosen(pd.concat([*parts, b.iloc[:cut]], ignore_index=True))
                parts = []
            parts.append(b.iloc[cut:])
        if parts:
            out += chosen(pd.concat(parts, ignore_index=True))
        yield pd.DataFrame({"draw": np.arange(1, draws + 1, dtype=np.int32), "statistic": out})

    some = seen.where("statistic is not null").select(F.lit(True).alias("any"))  # no draws if no row had y
    laid = r.repartition("e").sortWithinPartitions("e", "unit", "x").select("e", "y", "x", "id")
    sums = laid.mapInPandas(run, "draw int, statistic double").groupBy("draw").agg(F.sum("statistic").alias("statistic"))
    return seen.unionByName(sums.join(F.broadcast(some)).select("draw", "statistic"))


def spline(x: Column, knots: Sequence[float]) -> list[Column]:
    """Natural cubic spline: x and, for each knot but the last two, a basis that is linear beyond the ends."""
    cube = lambda k: F.pow(F.greatest(x - k, F.lit(0.0)), 3)
    last, before = knots[-1], knots[-2]
    d = lambda k: (cube(k) - cube(last)) / (last - k)
    return [x.cast("double"), *[d(k) - d(before) for k in knots[:-2]]]


def surface(df: DataFrame, cell: Sequence[str], z: Sequence[str], y: str) -> DataFrame:
    """Moments per cell: n, sums and cross products of z and y, ready for a k x k solve per surface."""
    c = [F.col(v).cast("double") for v in (*z, y)]
    names = [*z, "y"]
    return df.groupBy(*cell).agg(F.count("*").alias("n"), *[F.sum(v).alias(f"s_{a}") for v, a in zip(c, names, strict=True)], *[F.sum(c[i] * c[j]).alias(f"s_{names[i]}_{names[j]}") for i in range(len(c)) for j in range(i, len(c))])


def surface_fits(df: DataFrame, cell: Sequence[str], z: Sequence[str], y: str) -> DataFrame:
    """(cell, n, coefficients, standardized): each cell's OLS of y on z, and its value at the means of z over all rows.

    coefficients has the constant first. Cells whose z vary too little for a solution have nulls. The cells' moments are
    solved in batches where they lie; only the k global means reach the driver.
    """
    k = len(z)
    m = surface(df, cell, z, y)
    whole = m.agg(F.sum("n"), *[F.sum(f"s_{a}") for a in z]).first()
    at = np.array([1.0, *[(v or 0.0) / max(whole[0] or 0, 1) for v in whole[1:]]])
    names = ["one", *z]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cell)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                v = r._asdict() if all(c.isidentifier() for c in b.columns) else dict(zip(b.columns, r, strict=True))
                of = lambda p, q: v["n"] if p == q == "one" else v[f"s_{q}"] if p == "one" else v[f"s_{p}_{q}"]  # noqa: E731, B023
                a = np.array([[of(*((p, q) if i <= j else (q, p))) for j, q in enumerate(names)] for i, p in enumerate(names)], float)
                right = np.array([of("one", "y"), *[v[f"s_{p}_y"] for p in z]], float)
                good = np.isfinite(a).all() and np.linalg.matrix_rank(a) == k + 1
                beta = np.linalg.solve(a, right) if good else None
                out.append((*[v[c] for c in cell], v["n"], None if beta is None else beta.tolist(), None if beta is None else float(beta @ at)))
            yield pd.DataFrame(out, columns=[*cell, "n", "coefficients", "standardized"])

    return m.mapInPandas(run, f"{kinds}, n long, coefficients array<double>, standardized double")


def roots(coef: Sequence[float], low: float, high: float) -> tuple[list[float], str]:
    """Real roots of a polynomial (constant first) within [low, high] and a status."""
    found = np.roots(list(coef)[::-1]) if any(coef[1:]) else np.array([])
    own = sorted(float(r.real) for r in found if abs(r.imag) < 1e-9 and low <= r.real <= high)
    return own, "no root" if not own else "one root" if len(own) == 1 else "several roots"


def interval(df: DataFrame, value: str, level: float = 0.95) -> tuple[float | None, float | None]:
    """Percentile interval; missing draws count once as lowest and once as highest."""
    v = F.col(value)
    lo, hi = F.coalesce(v, F.lit(-math.inf)), F.coalesce(v, F.lit(math.inf))
    return tuple(df.agg(F.percentile(lo, (1 - level) / 2), F.percentile(hi, (1 + level) / 2)).first())
