"""Likelihood models: values, gradients and expected counts are computed where the rows are."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwake.session import materialize, release
from ledgerwake.stats.moments import _pairs, _square
from ledgerwake.stats.scores import draw_coefficients, draw_number, poisson_weight, unit_number


def logit(cells: DataFrame, n: str, successes: str, x: Sequence[str], ridge: float = 0.0, most: int = 50) -> dict:
    """Logistic regression on cells (x, trials, successes) by Newton's method: coef (first the constant), se.

    Raises ArithmeticError if ``most`` steps do not reach the optimum (as with separated data).
    """
    k = len(x) + 1
    design = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    beta = np.zeros(k)
    for _ in range(most):
        eta = sum((design[i] * float(beta[i]) for i in range(k)), F.lit(0.0))
        p = 1 / (1 + F.exp(-eta))
        w = F.col(n) * p * (1 - p)
        row = cells.agg(*[F.sum(design[i] * (F.col(successes) - F.col(n) * p)) for i in range(k)], *[F.sum(w * design[i] * design[j]) for i, j in _pairs(k)]).first()
        penalty = np.diag([0.0, *[ridge] * (k - 1)])
        hessian = _square(k, row[k:]) + penalty
        step = np.linalg.pinv(hessian) @ (np.array(row[:k], float) - penalty @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            return {"coef": beta, "se": np.sqrt(np.diag(np.linalg.pinv(hessian)))}
    raise ArithmeticError(f"logit: the last of {most} steps is still {np.abs(step).max()}")


class Grouped:
    """Rows laid out by group once, so that sums over groups can be taken again and again.

    Groups are walked within sorted partitions by mapInPandas; a group's rows
    meet in one task, many groups in one call.
    """

    def __init__(self, df: DataFrame, group: str, order: Sequence[str], columns: Sequence[str]) -> None:
        self.columns = list(columns)
        rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("__group"), *order, *[F.col(c).cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
        self.rows = rows.repartition("__group").sortWithinPartitions("__group", *order).select("__group", *[f"__{i}" for i in range(len(columns))]).persist()

    def total(self, kernel: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """The sum over groups of ``kernel(values)``, an array of ``size`` numbers; values are a group's rows in order."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out, open_group, parts = np.zeros(size), None, []
            for b in batches:
                keys, values = b["__group"].to_numpy(), b.iloc[:, 1:].to_numpy(float)
                cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if parts and keys[lo] != open_group:
                        out += kernel(np.concatenate(parts))
                        parts = []
                    open_group = keys[lo]
                    parts.append(values[lo:hi])
            if parts:
                out += kernel(np.concatenate(parts))
            yield pd.DataFrame([out.tolist()], columns=[f"s{i}" for i in range(size)])

        row = self.rows.mapInPandas(run, ", ".join(f"s{i} double" for i in range(size))).agg(*[F.sum(f"s{i}") for i in range(size)]).first()
        return np.array([x or 0.0 for x in row])

    def close(self) -> None:
        self.rows.unpersist()


def conditional_kernel(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Exact conditional log-likelihood of one group, its gradient and information.

    The sum over all subsets of the group with as many successes is built one
    row at a time, carrying first and second derivatives.
    """
    m, k = int(y.sum()), x.shape[1]
    if m == 0 or m == len(y):
        return 0.0, np.zeros(k), np.zeros((k, k))
    u = x @ beta
    top = float(u.max())
    e = np.exp(u - top)
    f, g, h = np.zeros(m + 1), np.zeros((m + 1, k)), np.zeros((m + 1, k, k))
    f[0], shift = 1, 0.0
    for w, r in zip(e, x, strict=True):
        rr = np.outer(r, r)
        h[1:] = h[1:] + w * (h[:-1] + g[:-1, :, None] * r + r[:, None] * g[:-1, None, :] + f[:-1, None, None] * rr)
        g[1:] = g[1:] + w * (g[:-1] + f[:-1, None] * r)
        f[1:] = f[1:] + w * f[:-1]
        s = f.max()
        f, g, h = f / s, g / s, h / s
        shift += math.log(s)
    log_f = math.log(f[m]) + shift + m * top
    mean = g[m] / f[m]
    return float((u * y).sum() - log_f), (x * y[:, None]).sum(0) - mean, h[m] / f[m] - np.outer(mean, mean)


def conditional_logit(df: DataFrame, group: str, y: str, x: Sequence[str], most: int = 30) -> dict:
    """Exact conditional logit by Newton's method; a group's rows meet in one task, so groups must be bounded strata.

    Raises ArithmeticError if ``most`` steps do not reach the optimum.
    """
    k = len(x)
    beta = np.zeros(k)
    rows = Grouped(df, group, [], [y, *x])

    def at(now: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def kernel(v: np.ndarray) -> np.ndarray:
            value, grad, info = conditional_kernel(v[:, 1:], v[:, 0], now)
            return np.array([value, *grad, *(info[i, j] for i, j in _pairs(k))])

        return kernel

    try:
        for _ in range(most):
            row = rows.total(at(beta), 1 + k + len(_pairs(k)))
            info = _square(k, row[k + 1 :])
            step = np.linalg.pinv(info) @ row[1 : k + 1]
            beta = beta + step
            if np.abs(step).max() < 1e-9:
                return {"coef": beta, "se": np.sqrt(np.diag(np.linalg.pinv(info))), "loglik": row[0]}
    finally:
        rows.close()
    raise ArithmeticError(f"conditional logit: the last of {most} steps is still {np.abs(step).max()}")


#: Up to so many distinct (trials, successes) are iterated over in the driver.
DRIVER_CELLS = 100_000


def _expected(cells: DataFrame, share: np.ndarray, rate: np.ndarray) -> list[float]:
    """Log-likelihood, then for each type the expected entities, successes and trials: one aggregation."""
    n, k, types = F.col("n"), F.col("k"), len(rate)
    logs = [F.lit(math.log(max(s, 1e-300))) + k * math.log(r) + (n - k) * math.log(1 - r) for s, r in zip(share, rate, strict=True)]
    e = [F.exp(x - F.col("top")) for x in logs]
    d = cells.withColumn("top", F.greatest(*logs) if types > 1 else logs[0]).withColumn("z", sum(e[1:], e[0]))
    d = d.select("n", "k", (F.col("c") * (F.log("z") + F.col("top"))).alias("l"), *[(F.col("c") * x / F.col("z")).alias(f"w{t}") for t, x in enumerate(e)])
    return list(d.agg(F.sum("l"), *[F.sum(F.col(f"w{t}") * v) for v in (F.lit(1), k, n) for t in range(types)]).first())


def _expected_here(c: pd.DataFrame, share: np.ndarray, rate: np.ndarray) -> list[float]:
    logs = np.log(np.maximum(share, 1e-300)) + np.outer(c.k, np.log(rate)) + np.outer(c.n - c.k, np.log1p(-rate))
    top = logs.max(1)
    e = np.exp(logs - top[:, None])
    z = e.sum(1)
    w = e / z[:, None] * c.c.to_numpy()[:, None]
    return [float((c.c * (np.log(z) + top)).sum()), *w.sum(0), *(w * c.k.to_numpy()[:, None]).sum(0), *(w * c.n.to_numpy()[:, None]).sum(0)]


def binomial_mixture(entities: DataFrame, n: str, k: str, types: int, starts: int = 3, rounds: int = 2000, tolerance: float = 1e-8) -> dict:
    """EM for a mixture of binomials over entities' (trials, successes); types come out in the order of their rates.

    Entities are counted by distinct (trials, successes) first; a round is one
    aggregation over these, in the driver if they are few (DRIVER_CELLS). The
    best of several starts is kept; bic uses the number of entities, icl adds the
    entropy of the types. A start that does not converge in ``rounds`` rounds raises ArithmeticError.
    """
    cells = entities.where(F.col(n) > 0).groupBy(F.col(n).alias("n"), F.col(k).alias("k")).agg(F.count("*").alias("c")).persist()
    few = cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS
    source, step = (cells.toPandas(), _expected_here) if few else (cells, _expected)
    total = cells.agg(F.sum("c")).first()[0] or 0
    best: dict = {"loglik": -math.inf}
    for s in range(starts if total else 0):
        rate = np.clip((np.arange(types) + 0.5 + 0.3 * (s - 1) / starts) / types, 0.02, 0.98)
        share, last = np.full(types, 1 / types), -math.inf
        for _ in range(rounds):
            row = step(source, share, rate)
            w, wk, wn = np.array(row[1:], float).reshape(3, types)
            share, rate = w / total, np.clip(wk / np.maximum(wn, 1e-300), 1e-6, 1 - 1e-6)
            if row[0] - last < tolerance * abs(row[0]):
                break
            last = row[0]
        else:
            raise ArithmeticError(f"mixture: start {s} still gains after {rounds} rounds")
        if row[0] > best["loglik"]:
            order = np.argsort(rate)
            best = {"loglik": row[0], "share": share[order], "rate": rate[order], "bic": -2 * row[0] + (2 * types - 1) * math.log(total)}
    if total:
        best["icl"] = best["bic"] + 2 * _type_entropy(cells, best["share"], best["rate"])
    cells.unpersist()
    return best


def _type_entropy(cells: DataFrame, share: np.ndarray, rate: np.ndarray) -> float:
    """The entropy of the entities' type probabilities, summed over entities in one aggregation."""
    n, k = F.col("n"), F.col("k")
    logs = [F.lit(math.log(max(s, 1e-300))) + k * math.log(r) + (n - k) * math.log(1 - r) for s, r in zip(share, rate, strict=True)]
    d = cells.withColumn("top", F.greatest(*logs) if len(logs) > 1 else logs[0])
    z = sum((F.exp(x - F.col("top")) for x in logs), F.lit(0.0))
    w = [F.exp(x - F.col("top")) / z for x in logs]
    return float(d.agg(F.sum(F.col("c") * sum((F.when(x > 0, -x * F.log(x)).otherwise(0.0) for x in w), F.lit(0.0)))).first()[0] or 0.0)


def aligned(one: dict, two: dict) -> list[int]:
    """For each type of ``one`` the type of ``two`` that it matches: the matching of least squared distance in share and rate."""
    types = range(len(one["rate"]))
    cost = lambda o: sum((one["rate"][i] - two["rate"][j]) ** 2 + (one["share"][i] - two["share"][j]) ** 2 for i, j in zip(types, o, strict=True))
    return list(min(permutations(types), key=cost))


def bootstrap_mixture(entities: DataFrame, n: str, k: str, unit: str, types: int, draws: int, seed: int = 1) -> list[dict]:
    """Mixtures fitted to entities under hashed Poisson(1) weights, their types put in the order of the whole fit's."""
    whole = binomial_mixture(entities, n, k, types)
    out = []
    for d in range(1, draws + 1):
        a, b, c, e = draw_coefficients(seed, d)
        w = poisson_weight(draw_number(unit_number(F.col(unit)), F.lit(a), F.lit(b), F.lit(c), F.lit(e)))
        fit = binomial_mixture(entities.withColumn("__w", w).where("__w > 0").select(n, k, F.explode(F.sequence(F.lit(1), "__w"))), n, k, types)
        order = aligned(whole, fit)
        out.append({**fit, "share": fit["share"][order], "rate": fit["rate"][order]})
    return out


def forward_backward(y: np.ndarray, start: np.ndarray, move: np.ndarray, rate: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, state probabilities (T x 2) and expected moves (2 x 2) of one 0/1 sequence with two states.

    The steps are walked on plain floats: arrays of two cost ten times as much.
    """
    (m00, m01), (m10, m11) = move.tolist()
    like = np.where(y[:, None] > 0, rate, 1 - rate).tolist()
    ahead, scale = [], []
    p, q = start.tolist()
    for e, f in like:
        p, q = p * e, q * f
        z = p + q
        p, q = p / z, q / z
        ahead.append((p, q))
        scale.append(z)
        p, q = p * m00 + q * m10, p * m01 + q * m11
    back, ratio = [(1.0, 1.0)], []
    p, q = 1.0, 1.0
    for (e, f), z in zip(like[:0:-1], scale[:0:-1], strict=True):
        u, v = e * p / z, f * q / z
        ratio.append((u, v))
        p, q = m00 * u + m01 * v, m10 * u + m11 * v
        back.append((p, q))
    a = np.array(ahead)
    return float(np.log(scale).sum()), a * np.array(back[::-1]), move * (a[:-1].T @ np.array(ratio[::-1]).reshape(-1, 2))


def hidden_states(df: DataFrame, entity: str, order: Sequence[str], y: str, rounds: int = 1000, tolerance: float = 1e-6) -> dict:
    """Two hidden states with their own rate of y, by Baum-Welch; expected counts are summed over entities.

    Stops when a round gains no more than ``tolerance`` times the log-likelihood,
    which is that of the numbers returned, and raises if that is not reached in
    ``rounds`` rounds. A sequence is walked in one task, as each step depends on
    the one before.
    """
    start, move, rate, last = np.array([0.5, 0.5]), np.array([[0.9, 0.1], [0.1, 0.9]]), np.array([0.2, 0.6]), -math.inf
    rows = Grouped(df.where(F.col(y).isNotNull()), entity, order, [y])

    def at(*now: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        def kernel(v: np.ndarray) -> np.ndarray:
            value, post, moves = forward_backward(v[:, 0], *now)
            return np.array([value, *post[0], *moves.ravel(), *post.sum(0), *(post * v).sum(0)])

        return kernel

    try:
        for _ in range(rounds):
            r = rows.total(at(start, move, rate), 11)
            if r[0] - last <= tolerance * abs(r[0]):
                return {"loglik": r[0], "start": start, "move": move, "rate": rate}
            last = r[0]
            start, move, rate = r[1:3] / r[1:3].sum(), r[3:7].reshape(2, 2), np.clip(r[9:11] / r[7:9], 1e-6, 1 - 1e-6)
            move = move / move.sum(1, keepdims=True)
    finally:
        rows.close()
    raise ArithmeticError(f"log-likelihood still gains more than {tolerance} of itself after {rounds} rounds")


def effect_poisson(df: DataFrame, entity: str, count: str, x: Sequence[str], most: int = 50) -> dict:
    """Poisson regression with entity effects profiled out (conditional on entity totals).

    Raises ArithmeticError if ``most`` steps do not reach the optimum.
    """
    k = len(x)
    c = [F.col(v).cast("double") for v in x]
    beta = np.zeros(k)
    for _ in range(most):
        w = F.exp(sum((c[i] * float(beta[i]) for i in range(k)), F.lit(0.0)))
        own = df.groupBy(entity).agg(F.sum(count).alias("y"), F.sum(w).alias("w"), *[F.sum(w * v).alias(f"a{i}") for i, v in enumerate(c)], *[F.sum(F.col(count) * v).alias(f"b{i}") for i, v in enumerate(c)], *[F.sum(w * c[i] * c[j]).alias(f"h{i}_{j}") for i, j in _pairs(k)]).where("y > 0")
        row = own.agg(*[F.sum(F.col(f"b{i}") - F.col("y") * F.col(f"a{i}") / F.col("w")) for i in range(k)], *[F.sum(F.col("y") * (F.col(f"h{i}_{j}") / F.col("w") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("w") ** 2)) for i, j in _pairs(k)]).first()
        info = _square(k, row[k:])
        step = np.linalg.pinv(info) @ np.array([v or 0.0 for v in row[:k]])
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            return {"coef": beta, "se": np.sqrt(np.diag(np.linalg.pinv(info)))}
    raise ArithmeticError(f"Poisson: the last of {most} steps is still {np.abs(step).max()}")


def random_intercept(entities: DataFrame, n: str, k: str, nodes: int = 15) -> dict:
    """Logit-normal rate over entities' (trials, successes): mean and sd of the intercept, by quadrature on a grid.

    The likelihood is summed over the distinct (trials, successes), in the driver
    if they are few (DRIVER_CELLS), else in one aggregation for all points of a step.
    """
    cells = entities.where(F.col(n) > 0).groupBy(F.col(n).alias("n"), F.col(k).alias("k")).agg(F.count("*").alias("c")).persist()
    here = cells.toPandas() if cells.limit(DRIVER_CELLS + 1).count() <= DRIVER_CELLS else None
    points, weights = np.polynomial.hermite.hermgauss(nodes)

    def value(c: pd.DataFrame, mean: float, sd: float) -> float:
        p = 1 / (1 + np.exp(-(mean + math.sqrt(2) * sd * points)))
        l = c.k.to_numpy()[:, None] * np.log(p) + (c.n - c.k).to_numpy()[:, None] * np.log1p(-p)
        top = l.max(1)
        return float((c.c * (top + np.log((np.exp(l - top[:, None]) * weights).sum(1) / math.sqrt(math.pi)))).sum())

    def values(tries: list[tuple[float, float]]) -> list[float]:
        if here is not None:
            return [value(here, *v) for v in tries]
        names = [f"s{i}" for i in range(len(tries))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame([[value(b, *v) for v in tries]], columns=names)

        return list(cells.mapInPandas(run, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first())

    mean, sd, step = 0.0, 1.0, 1.0
    while step > 1e-5:  # pattern search
        tries = [(mean + a * step, max(1e-3, sd + b * step)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        best = tries[int(np.argmax(values(tries)))]
        step, mean, sd = (step / 2, mean, sd) if best == (mean, sd) else (step, *best)
    loglik = values([(mean, sd)])[0]
    cells.unpersist()
    return {"mean": mean, "sd": sd, "loglik": loglik}


def calibrate(df: DataFrame, entity: str, offset: str, y: str, pseudo: float = 1.0, most: int = 50) -> DataFrame:
    """(entity, n, intercept): each entity's shift of the logit, with ``pseudo`` successes and as many failures at offset 0.

    Newton's method for all entities at once: rows are counted by (entity, offset) first, and
    each round is one join and one aggregation over these counts, which AQE splits for an entity of very
    many offsets. Steps are at most 2. Raises ArithmeticError if ``most`` rounds do not reach the optimum.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(offset).isNotNull() & F.col(y).isNotNull()).select(F.col(entity).alias("e"), F.col(offset).cast("double").alias("r"), F.col(y).cast("double").alias("y"))
    bins = materialize(rows.groupBy("e", "r").agg(F.count("*").alias("c"), F.sum("y").alias("s")), "calibration-cells")
    state = materialize(bins.groupBy("e").agg(F.sum("c").alias("n"), F.sum("s").alias("k"), F.lit(0.0).alias("a")), "calibration")
    for _ in range(most):
        p = 1 / (1 + F.exp(-(F.col("r") + F.col("a"))))
        sums = bins.join(state.select("e", "a"), "e").groupBy("e").agg(F.sum(F.col("c") * p).alias("g"), F.sum(F.col("c") * p * (1 - p)).alias("h"))
        own = 1 / (1 + F.exp(-F.col("a")))
        step = (F.col("k") + pseudo - F.col("g") - 2 * pseudo * own) / (F.col("h") + 2 * pseudo * own * (1 - own))
        new = materialize(state.join(sums, "e").withColumn("step", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), step))).select("e", "n", "k", (F.col("a") + F.col("step")).alias("a"), F.abs("step").alias("moved")), "calibration")
        release(state)
        state, far = new, new.agg(F.max("moved")).first()[0] or 0.0
        if far < 1e-9:
            release(bins)
            return state.select(F.col("e").alias(entity), "n", F.col("a").alias("intercept"))
    raise ArithmeticError(f"calibration: the last of {most} steps is still {far}")


def result_frame(spark: SparkSession, fit: dict) -> DataFrame:
    """A fit's numbers as (term, value)."""
    rows = []
    for name, v in fit.items():
        flat = np.asarray(v, float).ravel() if not isinstance(v, list) else np.asarray([b for x in v for b in x], float)
        rows += [(name if len(flat) == 1 else f"{name}_{i}", float(x)) for i, x in enumerate(flat)]
    return spark.createDataFrame(rows, "term string, value double")
