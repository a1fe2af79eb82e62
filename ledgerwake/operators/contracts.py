"""Data contracts: what must hold before and after a step."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract does not hold; the message has a few of the offending rows."""


def ensure_empty(df: DataFrame, message: str) -> None:
    if found := df.limit(5).collect():
        raise ContractError(f"{message}: {found}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def ensure_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    ensure_empty(duplicate_keys(df, keys), f"{list(keys)} is not unique")
    return df


def violations(df: DataFrame, rule: Column) -> DataFrame:
    """The rows for which ``rule`` does not hold; null does not hold."""
    return df.where(~F.coalesce(rule, F.lit(False)))


def conflicts(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(keys, n) of keys whose rows differ in one of ``columns``: by null, or by more than ``tolerance`` if they are doubles."""
    kinds, tests, aggs = dict(df.dtypes), [], [F.count("*").alias("n")]
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"__n{i}"), F.min(c).alias(f"__lo{i}"), F.max(c).alias(f"__hi{i}")]
        apart = F.col(f"__hi{i}") - F.col(f"__lo{i}") > tolerance if kinds[c] in ("double", "float") else F.col(f"__lo{i}") != F.col(f"__hi{i}")
        tests.append((F.col(f"__n{i}") > 0) & ((F.col(f"__n{i}") < F.col("n")) | apart))
    bad = tests[0]
    for t in tests[1:]:
        bad = bad | t
    return df.groupBy(*keys).agg(*aggs).where(bad).select(*keys, "n")


def coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with side ``left`` or ``right``; null keys are equal."""
    sides = [d.select(*keys, F.lit(i).alias("__side")) for i, d in ((1, a), (2, b))]
    seen = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.bit_or("__side").alias("__side")).where("__side < 3")
    return seen.select(*keys, F.when(F.col("__side") == 1, "left").otherwise("right").alias("side"))


def checked_join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner", cardinality: str = "one_to_one") -> DataFrame:
    """Join whose cardinality is checked first: one_to_one, one_to_many, many_to_one or many_to_many."""
    left, _, right = cardinality.partition("_to_")
    if left == "one":
        ensure_unique(a, keys)
    if right == "one":
        ensure_unique(b, keys)
    return a.join(b, list(keys), how)


def flow(df: DataFrame, screens: Mapping[str, Column]) -> DataFrame:
    """(step, screen, kept): rows that pass all screens so far, in one pass; null fails."""
    so_far, counts = F.lit(True), []
    for name, c in screens.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.struct(F.lit(len(counts) + 1).alias("step"), F.lit(name).alias("screen"), F.count_if(so_far).alias("kept")))
    return df.agg(F.array(F.struct(F.lit(0).alias("step"), F.lit("all").alias("screen"), F.count("*").alias("kept")), *counts).alias("x")).select(F.inline("x"))


def disposition(rules: Mapping[str, Column], last: str = "kept") -> Column:
    """The first screen that a row fails (null fails), else ``last``."""
    out = None
    for name, c in rules.items():
        bad = ~F.coalesce(c, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return out.otherwise(last) if out is not None else F.lit(last)


def bridge(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose values differ by more than ``tolerance`` or exist on one side only."""
    x, y = (d.groupBy(*keys).agg(F.sum(value).alias(n)) for d, n in ((old, "old"), (new, "new")))
    return x.join(y, list(keys), "full").where(F.col("old").isNull() | F.col("new").isNull() | (F.abs(F.col("old") - F.col("new")) > tolerance))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold the same rows as often, by counts in one aggregation (no order, no pairs)."""
    cols = a.columns
    both = a.select(*cols, F.lit(1).alias("__n")).unionByName(b.select(*cols, F.lit(-1).alias("__n")))
    return both.groupBy(*cols).agg(F.sum("__n").alias("n")).where("n != 0").isEmpty()


def census(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, nulls, nans, blanks, distinct_values about) in one scan."""
    kinds = dict(df.dtypes)
    rows = []
    for c in columns:
        nan = F.count_if(F.isnan(c)) if kinds[c] in ("double", "float") else F.lit(0).cast("long")
        blank = F.count_if(F.trim(c) == "") if kinds[c] == "string" else F.lit(0).cast("long")
        rows.append(F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), nan.alias("nans"), blank.alias("blanks")))
    return df.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def require_schema(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """The wanted columns, in that order; raises if one is missing or of another type."""
    have = dict(df.dtypes)
    if bad := {k: (v, have.get(k)) for k, v in wanted.items() if have.get(k) != v}:
        raise ContractError(f"wanted and found: {bad}")
    return df.select(*wanted)


def aliased(df: DataFrame, spellings: Mapping[str, Sequence[str]], optional: Mapping[str, str] | None = None) -> DataFrame:
    """Columns under their standard names; several present spellings are a conflict, absent ``optional`` ones become typed nulls."""
    out = []
    for name, names in spellings.items():
        found = [c for c in names if c in df.columns]
        if len(found) > 1:
            raise ContractError(f"{name} has several columns: {found}")
        if found:
            out.append(F.col(found[0]).alias(name))
        elif optional and name in optional:
            out.append(F.lit(None).cast(optional[name]).alias(name))
        else:
            raise ContractError(f"{name} is missing")
    return df.select(*out)


def conserved(df: DataFrame, path: str, write: Callable[[DataFrame, str], None]) -> DataFrame:
    """Write ``df`` with ``write`` and read it back; raises if a row was lost, added or changed."""
    write(df, path)
    back = df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
    if not same_rows(df, back):
        raise ContractError(f"{path} does not hold the rows that were written")
    return back


def nested(df: DataFrame, fine: str, coarse: str) -> DataFrame:
    """(fine, coarse_labels) of the fine labels that lie in more than one coarse label; null is a label."""
    pairs = df.select(fine, coarse).distinct()
    return pairs.groupBy(fine).agg(F.count("*").alias("coarse_labels")).where("coarse_labels > 1")
