"""Several fixed effects: singletons, cell compression and alternating projections."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.session import materialize, release
from ledgerwake.stats.moments import complete, gram


def peel(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Without rows that are alone in one of their groups, again and again until none is."""
    df = materialize(df, "peeled")
    while True:
        out = df
        for g in groups:
            many = df.groupBy(g).count().where("count > 1").select(g)
            out = out.join(many, g, "left_semi")
        out = materialize(out, "peeled")
        same = out.count() == df.count()
        release(df)
        df = out
        if same:
            return df


def cells(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per tuple of groups: __n rows and the mean of each column."""
    return df.groupBy(*groups).agg(F.count("*").cast("double").alias("__n"), *[F.avg(c).alias(c) for c in columns])


def absorb(df: DataFrame, groups: Sequence[str], columns: Sequence[str], weight: str = "__n", tolerance: float = 1e-8, most: int = 500) -> DataFrame:
    """``columns`` less all group effects, by alternating projections on weighted cells.

    Stops when no group's mean exceeds ``tolerance`` times the column's scale, and
    raises if that is not reached in ``most`` rounds: an unconverged fit is
    never returned. Each round is one aggregation and one join per group; the
    result is written to the shared folder, which cuts the lineage.
    """
    scale = df.agg(*[F.greatest(F.stddev_pop(c), F.lit(1e-300)).alias(c) for c in columns]).first()
    df = materialize(df, "absorb")
    for _ in range(most):
        out, worst = df, []
        for k, g in enumerate(groups):
            means = out.groupBy(g).agg(*[(F.sum(F.col(c) * F.col(weight)) / F.sum(weight)).alias(f"__m{i}") for i, c in enumerate(columns)])
            out = out.join(means, g)
            for i, c in enumerate(columns):
                out = out.withColumn(c, F.col(c) - F.col(f"__m{i}"))
                if k == 0:
                    worst.append(f"__m{i}")
            out = out.withColumnsRenamed({f"__m{i}": f"__first{i}" for i in range(len(columns))}) if k == 0 else out.drop(*[f"__m{i}" for i in range(len(columns))])
        out = materialize(out, "absorb")
        off = out.agg(*[F.max(F.abs(f"__first{i}")) for i in range(len(columns))]).first()
        release(df)
        path = out._ledgerwake_path
        df = out.drop(*[f"__first{i}" for i in range(len(columns))])
        df._ledgerwake_path = path
        if all((o or 0) <= tolerance * s for o, s in zip(off, scale, strict=True)):
            return df
    raise ArithmeticError(f"group means still above {tolerance} after {most} rounds")


def effects_ols(df: DataFrame, y: str, x: Sequence[str], groups: Sequence[str]) -> dict:
    """OLS of y on x with several fixed effects, on compressed cells: coef and n.

    x and y are averaged in cells of equal groups first, which leaves the
    estimate as it is when x is constant within cells; else the rows are kept.
    """
    rows = peel(complete(df, [y, *x]).select(y, *x, *groups).na.drop(subset=list(groups)), groups)
    by = [*groups, *x]
    z = absorb(cells(rows, by, [y]).withColumns({f"__x{i}": F.col(c).cast("double") for i, c in enumerate(x)}), groups, [y, *(f"__x{i}" for i in range(len(x)))])
    n, _, m = gram(z, [*(f"__x{i}" for i in range(len(x))), y], "__n")
    release(rows, z)
    k = len(x)
    return {"coef": np.linalg.pinv(m[:k, :k]) @ m[:k, k], "n": n}
