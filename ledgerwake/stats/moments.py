"""Regression from mergeable moments: only k x k sums reach the driver."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwake.session import materialize, release


def _pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def _square(k: int, values: Sequence[float | None]) -> np.ndarray:
    out = np.zeros((k, k))
    for (i, j), v in zip(_pairs(k), values, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose ``columns`` are all finite numbers."""
    for c in columns:
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df


def gram(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted count, sums and cross products of the columns, in one aggregation."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    c = [F.col(x).cast("double") for x in columns]
    row = df.agg(F.sum(w), *[F.sum(w * x) for x in c], *[F.sum(w * c[i] * c[j]) for i, j in _pairs(len(c))]).first()
    k = len(c)
    return row[0] or 0.0, np.array([x or 0.0 for x in row[1 : k + 1]]), _square(k, row[k + 1 :])


def group_moments(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """(group, n, g_i_j): cross products of the columns within each group, less the group's means."""
    c = [F.col(x).cast("double") for x in columns]
    sums = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(c)], *[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in _pairs(len(c))])
    return sums.select(group, "n", *[(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(f"g{i}_{j}") for i, j in _pairs(len(c))])


def within_ols(df: DataFrame, y: str, x: Sequence[str], group: str) -> dict:
    """OLS with one fixed effect, clustered by it (CR1): coef, se, n, groups.

    The demeaned cross products and each group's score follow from the group's
    own moments, so the rows are read twice (means, moments) and never joined.
    """
    columns = [*x, y]
    k = len(x)
    df = complete(df, columns)
    n, sums, _ = gram(df, columns)
    df = df.withColumns({c: F.col(c).cast("double") - float(s / max(n, 1.0)) for c, s in zip(columns, sums, strict=True)})  # against cancellation
    groups = group_moments(df, group, columns).persist()
    row = groups.agg(F.sum("n"), F.count("*"), *[F.sum(f"g{i}_{j}") for i, j in _pairs(k + 1)]).first()
    total, g = row[0] or 0, row[1]
    m = _square(k + 1, row[2:])
    bread = np.linalg.pinv(m[:k, :k])
    beta = bread @ m[:k, k]
    at = lambda i, j: F.col(f"g{min(i, j)}_{max(i, j)}")
    score = [at(i, k) - sum((at(i, j) * float(beta[j]) for j in range(k)), F.lit(0.0)) for i in range(k)]
    _, _, meat = gram(groups.select(*[s.alias(f"u{i}") for i, s in enumerate(score)]), [f"u{i}" for i in range(k)])
    groups.unpersist()
    scale = g / max(g - 1, 1) * (total - 1) / max(total - k, 1)
    cov = scale * bread @ meat @ bread
    return {"coef": beta, "se": np.sqrt(np.maximum(np.diag(cov), 0)), "cov": cov, "n": total, "groups": g}


def influence(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """``df`` (complete rows) with ``influence``: what each row adds to the slope of a regression with one fixed effect.

    The influences sum to 0; summed by cluster and squared they give the slope's clustered variance (without
    small-sample factors). Group means are joined to the rows, which AQE splits for a hot group.
    """
    rows = complete(df, [x, y]).where(F.col(group).isNotNull())
    fit = within_ols(rows, y, [x], group)
    means = rows.groupBy(group).agg(F.avg(F.col(x).cast("double")).alias("__mx"), F.avg(F.col(y).cast("double")).alias("__my"))
    joined = rows.join(means, group).withColumns({"__dx": F.col(x) - F.col("__mx"), "__dy": F.col(y) - F.col("__my")})
    size = joined.agg(F.sum(F.col("__dx") ** 2)).first()[0] or math.nan
    return joined.withColumn("influence", F.col("__dx") * (F.col("__dy") - float(fit["coef"][0]) * F.col("__dx")) / size).drop("__mx", "__my", "__dx", "__dy")


def partial_out(df: DataFrame, columns: Sequence[str], controls: Sequence[str], cut: float = 1e-11) -> DataFrame:
    """Complete rows with r_<c>: each of ``columns`` less what a constant and the ``controls`` explain.

    One aggregation of cross products; directions of the controls that vary less than ``cut`` of the strongest are left out.
    """
    names = [*controls, *columns]
    rows = complete(df, names)
    n, sums, m = gram(rows, names)
    mean = sums / max(n, 1.0)
    m = m - n * np.outer(mean, mean)
    k = len(controls)
    size, turn = np.linalg.eigh(m[:k, :k]) if k else (np.zeros(0), np.zeros((0, 0)))
    kept = size > max(size.max(initial=0.0), 1.0) * cut
    slopes = (turn[:, kept] / size[kept]) @ turn[:, kept].T @ m[:k, k:]
    off = [F.col(c).cast("double") - float(v) for c, v in zip(names, mean, strict=True)]
    return rows.withColumns({f"r_{c}": off[k + j] - sum((off[i] * float(slopes[i, j]) for i in range(k)), F.lit(0.0)) for j, c in enumerate(columns)})


def cluster_meat(scores: DataFrame, columns: Sequence[str], *keys: str) -> np.ndarray:
    """Sum of outer products of cluster sums; several keys by inclusion and exclusion."""
    k = len(columns)
    out = np.zeros((k, k))
    for mask in range(1, 1 << len(keys)):
        own = [x for i, x in enumerate(keys) if mask >> i & 1]
        sums = scores.groupBy(*own).agg(*[F.sum(c).alias(c) for c in columns])
        out += (-1) ** (len(own) + 1) * gram(sums, columns)[2]
    return out


def dyadic_meat(scores: DataFrame, score: str, a: str, b: str, date: str | None = None) -> float:
    """Sum of score products over all pairs of rows that share an account or the date.

    Rows that share a sum are added by account, less those counted twice as the
    pair, then by date, less those that share both: no pairs are formed. The rows are
    summed by pair and date first; all other sums are taken of that, written once.
    """
    s = scores.where(F.col(score).isNotNull()).select(F.least(a, b).alias("__u"), F.greatest(a, b).alias("__v"), *([F.col(date).alias("__d")] if date else []), F.col(score).alias("__s"))
    base = materialize(s.groupBy("__u", "__v", *(["__d"] if date else [])).agg(F.sum("__s").alias("__s")), "dyads")
    sides = base.select(F.explode(F.array_distinct(F.array("__u", "__v"))).alias("__p"), *(["__d"] if date else []), "__s")
    pair = base.where("__u != __v")

    def of(df: DataFrame, *by: str) -> float:
        return df.groupBy(*by).agg(F.sum("__s").alias("s")).agg(F.sum(F.col("s") ** 2)).first()[0] or 0.0

    out = of(sides, "__p") - of(pair, "__u", "__v")
    if date:
        out += of(base, "__d") - of(sides, "__p", "__d") + (pair.agg(F.sum(F.col("__s") ** 2)).first()[0] or 0.0)
    release(base)
    return out


def iv(df: DataFrame, y: str, d: str, z: str, controls: Sequence[str] = (), cluster: str | None = None) -> dict:
    """Just-identified IV: first stage, reduced form and estimate with standard errors, and the Anderson-Rubin set (95 %).

    ``cluster`` names the groups whose scores are summed; without it every row is its own. The set holds
    all b for which the scores of z and y - b d are no further from 0 than their own covariance allows.
    """
    columns = ["__one", *controls, z, d, y]
    rows = complete(df.withColumn("__one", F.lit(1.0)), columns)
    n, _, m = gram(rows, columns)
    c = len(controls) + 1
    out = np.linalg.pinv(m[:c, :c]) @ m[:c, c:]  # what the controls explain of z, d, y
    r = m[c:, c:] - m[c:, :c] @ out
    zz, zd, zy = r[0]
    if not zz > 0:
        return {"n": n, "first": math.nan, "reduced": math.nan, "iv": math.nan, "set": []}
    first, reduced = zd / zz, zy / zz
    left = [F.col(v).cast("double") - sum((F.col(w).cast("double") * float(out[i, j]) for i, w in enumerate(columns[:c])), F.lit(0.0)) for j, v in enumerate((z, d, y))]
    score = rows.select(*([F.col(cluster).alias("__g")] if cluster else []), (left[0] * (left[2] - left[0] * float(reduced))).alias("__y"), (left[0] * (left[1] - left[0] * float(first))).alias("__d"))
    if cluster:
        score = score.where("__g is not null").groupBy("__g").agg(F.sum("__y").alias("__y"), F.sum("__d").alias("__d"))
    v = gram(score, ["__y", "__d"])[2]
    estimate = zy / zd if zd else math.nan
    q = 3.841458820694124  # 95 % of chi-squared with one degree
    region = quadratic_set(zd * zd - q * v[1, 1], 2 * (q * v[0, 1] - zy * zd), zy * zy - q * v[0, 0])
    spread = v[0, 0] - 2 * estimate * v[0, 1] + estimate**2 * v[1, 1]
    return {
        "n": n,
        "first": first,
        "first_se": math.sqrt(v[1, 1]) / zz,
        "reduced": reduced,
        "reduced_se": math.sqrt(v[0, 0]) / zz,
        "iv": estimate,
        "iv_se": math.sqrt(max(spread, 0.0)) / abs(zd) if zd else math.nan,
        "set": region,
    }


def quadratic_set(a: float, b: float, c: float, tiny: float = 1e-12) -> list[tuple[float, float]]:
    """Where a x^2 + b x + c <= 0: intervals, which may be empty, unbounded, two rays or the line.

    Coefficients below ``tiny`` of the largest count as 0. Roots are taken without cancellation.
    """
    inf, size = math.inf, max(map(abs, (a, b, c)))
    if not math.isfinite(size):
        return []
    a, b, c = (x if abs(x) > tiny * size else 0.0 for x in (a, b, c))
    if a:
        disc = b * b - 4 * a * c
        if disc >= 0:
            far = -(b + math.copysign(math.sqrt(disc), b)) / 2
            ends = sorted((far / a, c / far if far else 0.0))
            return [tuple(ends)] if a > 0 else [(-inf, ends[0]), (ends[1], inf)]
        return [] if a > 0 else [(-inf, inf)]
    if b:
        return [(-inf, -c / b) if b > 0 else (-c / b, inf)]
    return [(-inf, inf)] if c <= 0 else []


def chi2_sf(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, h = k / 2, x / 2
    if h < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= h / n
            total += term
        return max(0.0, 1 - total * math.exp(a * math.log(h) - h - math.lgamma(a)))
    tiny = 1e-300
    b, c = h + 1 - a, 1 / tiny
    d = f = 1 / b
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        f *= (step := d * c)
        if abs(step - 1) < 1e-15:
            break
    return f * math.exp(a * math.log(h) - h - math.lgamma(a))


def wald(coef: np.ndarray, cov: np.ndarray) -> tuple[float, int, float]:
    """Joint test that all coefficients are 0: statistic, rank, p."""
    stat, rank = float(coef @ np.linalg.pinv(cov) @ coef), int(np.linalg.matrix_rank(cov))
    return stat, rank, chi2_sf(stat, rank)


def holm(p: Sequence[float]) -> list[float]:
    """Holm's step-down adjustment."""
    order = sorted(range(len(p)), key=lambda i: p[i])
    out, top = [0.0] * len(p), 0.0
    for k, i in enumerate(order):
        top = max(top, min(1.0, (len(p) - k) * p[i]))
        out[i] = top
    return out


def equivalence(estimate: float, se: float, bound: float, z: float = 1.6448536269514722) -> dict:
    """Two one-sided tests within +-bound, and the least effect found with power 0.8."""
    return {"equivalent": abs(estimate) + z * se < bound, "mde": (1.959963984540054 + 0.8416212335729143) * se}


def reliability(df: DataFrame, a: str, b: str) -> float:
    """Share of a measure's variance that is not noise: covariance of two readings over the mean variance."""
    r = complete(df, [a, b]).agg(F.covar_samp(a, b), F.var_samp(a), F.var_samp(b)).first()
    return 2 * r[0] / (r[1] + r[2]) if r[0] is not None and r[1] + r[2] else math.nan


def joint_meat(a: DataFrame, b: DataFrame, key: str, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Cross products of two models' cluster scores on the clusters that both have."""
    x = a.groupBy(key).agg(*[F.sum(c).alias(f"a_{c}") for c in left])
    y = b.groupBy(key).agg(*[F.sum(c).alias(f"b_{c}") for c in right])
    names = [*(f"a_{c}" for c in left), *(f"b_{c}" for c in right)]
    return gram(x.join(y, key), names)[2][: len(left), len(left) :]
