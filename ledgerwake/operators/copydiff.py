"""Differences between two copies of a table, found through invertible Bloom lookup tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwake.session import materialize, release

HASHES = 3
MASK = (1 << 64) - 1
#: Doubles up to this size are hashed by steps of half the tolerance, larger ones as they are.
STEP_LIMIT = 1e6


@dataclass(frozen=True)
class Field:
    """A field to compare: its name, and how to read it on either side."""

    name: str
    main: Column
    copy: Column
    tolerance: float | None = None  # for doubles

    def differs(self, a: Column, b: Column) -> Column:
        """Null differs from all but null, NaN from all but NaN, doubles beyond the tolerance."""
        if self.tolerance is None:
            return ~a.eqNullSafe(b)
        apart = F.when(F.isnan(a) | F.isnan(b), F.isnan(a) != F.isnan(b)).otherwise((a != b) & (F.abs(a - b) > self.tolerance))
        return F.when(a.isNull() | b.isNull(), a.isNull() != b.isNull()).otherwise(apart)

    def hashed(self, c: Column) -> list[Column]:
        """Equal for no two values that differ; noise below the tolerance mostly leaves it equal."""
        if self.tolerance is not None:
            limit = STEP_LIMIT * self.tolerance / 1e-9 if self.tolerance else 0.0
            c = F.when(F.abs(c) < limit, F.floor(c / F.lit((self.tolerance or 1.0) / 2)).cast("double")).otherwise(c + F.lit(0.0))
        return [c.isNull(), c]


#: Up to so many differing keys are broadcast to fetch their rows; more are joined.
MAX_BROADCAST_KEYS = 500_000


def newest(df: DataFrame, keys: Sequence[str], revision: str | None, hashed: Column, values: Sequence[Column] = ()) -> DataFrame:
    """One row per key: the highest revision; of several such rows the greatest row hash, then the greatest values."""
    named = F.struct(*([F.col(revision).alias("__rev")] if revision else []), hashed.alias("__h"), *values)
    return df.select(*[F.col(k) for k in keys], named.alias("__row")).where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(*keys).agg(F.max("__row").alias("__row"))


def _element_hash(kh: int, h: int, seed: int) -> tuple[int, int]:
    """The check and the cell hash of an element, as Spark's xxhash64 chains its arguments."""
    s = 42
    for x in (kh, h):
        s = xxhash.xxh64_intdigest((x & MASK).to_bytes(8, "little"), s)
    return s, xxhash.xxh64_intdigest(seed.to_bytes(8, "little"), s)


def _cells_of(cell_hash: int, per_hash: int) -> list[int]:
    return [i * per_hash + (cell_hash >> 21 * i & 0x1FFFFF) % per_hash for i in range(HASHES)]


def peel(cells: dict[int, list[int]], per_hash: int, seed: int) -> tuple[list[tuple[int, int]], bool]:
    """Elements of a subtracted table as (key hash, sign), and whether it came out empty.

    cells: cell number -> [count, key xor, row xor, check xor], changed in place.
    """
    found, todo = [], list(cells)
    while todo:
        c = cells.get(todo.pop())
        if c is None or c[0] not in (1, -1):
            continue
        n, kh, h, check = c
        own, cell_hash = _element_hash(kh, h, seed)
        if own != check & MASK:
            continue
        found.append((kh, n))
        for i in _cells_of(cell_hash, per_hash):
            d = cells.setdefault(i, [0, 0, 0, 0])
            d[0] -= n
            d[1] ^= kh
            d[2] ^= h
            d[3] ^= check
            todo.append(i)
    return found, not any(any(c) for c in cells.values())


def _peeler(per_hash: int, seed: int):
    def run(own: pd.DataFrame) -> pd.DataFrame:
        bucket = int(own["bucket"].iloc[0])
        rows = zip(own["cell"], own["n"], own["k"], own["h"], own["c"], strict=True)
        found, whole = peel({int(i): [int(x) for x in r] for i, *r in rows}, per_hash, seed)
        keys = list(dict.fromkeys(k for k, _ in found)) if whole else [None]
        # typed: a frame made of rows with gaps would pass through doubles
        return pd.DataFrame({"bucket": pd.array([bucket] * len(keys), "int64"), "kh": pd.array(keys, "Int64")})

    return run


def differing_keys(rows: DataFrame, cells: int, seed: int) -> DataFrame:
    """(bucket, kh) of the elements in which the two sides differ; kh is null for a bucket that didn't peel.

    ``rows`` are (sign, bucket, kh, rev, h), sign 1 and -1 naming the side. They
    are shuffled once, by bucket; what follows stays where the bucket lies: the newest
    row of each key and side, the sums of each side's elements in ``cells``
    cells a bucket, subtracted, and the peeling.
    """
    per_hash = cells // HASHES
    laid = rows.repartition("bucket")
    one = laid.groupBy("bucket", "kh", "sign").agg(F.max(F.struct("rev", "h")).alias("x")).select("bucket", "kh", F.col("x.h").alias("h"), "sign")
    x = F.xxhash64("kh", "h", F.lit(seed).cast("long"))
    spots = [(F.lit(i * per_hash) + F.pmod(F.shiftrightunsigned(x, 21 * i).bitwiseAND(F.lit(0x1FFFFF)), F.lit(per_hash))).cast("int") for i in range(HASHES)]
    part = one.select("bucket", "kh", "h", "sign", F.xxhash64("kh", "h").alias("check"), F.explode(F.array(*spots)).alias("cell"))
    left = part.groupBy("bucket", "cell").agg(F.sum("sign").alias("n"), F.bit_xor("kh").alias("k"), F.bit_xor("h").alias("h"), F.bit_xor("check").alias("c")).where("n != 0 or k != 0 or h != 0 or c != 0")
    return left.groupBy("bucket").applyInPandas(_peeler(per_hash, seed), "bucket long, kh long")


def _differing_share(rows: DataFrame, one_of: int) -> float:
    """Differing elements to a key, from the keys whose hash is divisible by ``one_of``."""
    own = rows.where(F.pmod(F.shiftright("kh", 7), F.lit(one_of)) == 0).groupBy("kh").agg(*[F.max(F.when(F.col("sign") == s, F.struct("rev", "h"))).alias(n) for s, n in ((1, "a"), (-1, "b"))])
    apart = F.when(F.col("a.h").eqNullSafe(F.col("b.h")) & F.col("a").isNotNull() & F.col("b").isNotNull(), 0).otherwise(F.col("a").isNotNull().cast("int") + F.col("b").isNotNull().cast("int"))
    keys, found = own.agg(F.count("*"), F.sum(apart)).first()
    return (found or 0) / max(keys, 1)


def compare_copies(
    main: DataFrame,
    copy: DataFrame,
    keys: Sequence[str],
    fields: Sequence[Field],
    revision: str | None = None,
    rows_per_bucket: int = 8_000,
    cells: int | None = None,
) -> DataFrame:
    """Rows missing on either side and, field by field, values that differ.

    Returns the keys, diff (``only_main``, ``only_copy`` or a field's name) and
    both values as strings (null for missing rows).

    Per side and key only the row of the highest ``revision`` counts (null
    being the lowest); of several such rows that differ, the one of greatest row
    hash. Rows with a null in a key are ignored. Repeated rows, empty tables and columns
    not named in ``fields`` change nothing. Null differs from everything but
    null, NaN from everything but NaN, doubles if further apart than their
    field's tolerance.

    Keys are cut into buckets of about ``rows_per_bucket`` keys. Each side sums
    key hash and row hash of its rows into an invertible Bloom lookup table of
    ``cells`` cells a bucket; the tables are subtracted and peeled, which
    reveals the differing keys, and only these rows are fetched and compared.
    The tables are as large as the differences ask for: their share is counted
    beforehand on the keys of a 64th of the hashes (fewer on large tables).
    Buckets with too many differences to peel are tried again with eight times
    the cells; all keys of buckets that fail again are fetched. A row hash is
    equal for no two rows that differ, so but for collisions of 64-bit hashes no
    difference is lost; rounding noise can only fetch a row in vain. A field
    must have the same type on both sides.
    """
    for f, a, b in zip(fields, main.select(*[f.main for f in fields]).schema, copy.select(*[f.copy for f in fields]).schema, strict=True):
        if a.dataType != b.dataType:  # row hashes of different types never agree
            raise TypeError(f"{f.name} is {a.dataType.simpleString()} on one side and {b.dataType.simpleString()} on the other: cast one")
    # of each side: sign, rows, the columns to compare, the row hash
    tables = [(sign, df, of, F.xxhash64(*[x for f, c in zip(fields, of, strict=True) for x in f.hashed(c)])) for sign, df, of in ((1, main, [f.main for f in fields]), (-1, copy, [f.copy for f in fields]))]
    size = max(main.count(), copy.count())
    buckets = max(1, -(-size // rows_per_bucket))
    kh = F.xxhash64(*keys)
    known = " and ".join(f"`{k}` is not null" for k in keys)
    rev = F.col(revision) if revision else F.lit(0)
    sides = [df.where(known).select(F.lit(s).cast("byte").alias("sign"), kh.alias("kh"), rev.alias("rev"), h.alias("h")) for s, df, _, h in tables]
    rows = sides[0].unionByName(sides[1]).withColumn("bucket", F.pmod("kh", F.lit(buckets)))
    if cells is None:
        expected = _differing_share(rows, max(64, size // 1_000_000)) * rows_per_bucket
        cells = HASHES * math.ceil((1.3 * expected + 6 * math.sqrt(expected) + 24) / HASHES)

    found = materialize(differing_keys(rows, cells, 1), "differing")
    used, wanted = [found], found.where("kh is not null").select("kh")
    failed = found.where("kh is null").select("bucket").distinct()
    if n_failed := failed.count():
        own = rows.join(F.broadcast(failed) if n_failed <= MAX_BROADCAST_KEYS else failed, "bucket", "left_semi")
        second = materialize(differing_keys(own, 8 * cells, 2), "differing")
        used.append(second)
        wanted = wanted.unionByName(second.where("kh is not null").select("kh"))
        rest = second.where("kh is null").select("bucket").distinct()
        if n_rest := rest.count():
            wanted = wanted.unionByName(rows.join(F.broadcast(rest) if n_rest <= MAX_BROADCAST_KEYS else rest, "bucket", "left_semi").select("kh"))
    wanted = materialize(wanted.distinct(), "wanted")
    release(*used)
    fetch = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_KEYS else wanted
    near = [newest(df.withColumn("__kh", kh).join(fetch, F.col("__kh") == F.col("kh"), "left_semi"), keys, revision, h, [c.alias(f.name) for f, c in zip(fields, of, strict=True)]) for _, df, of, h in tables]
    both = near[0].withColumnRenamed("__row", "__a").join(near[1].withColumnRenamed("__row", "__b"), list(keys), "full")
    one = lambda diff, a, b: F.struct(F.lit(diff).alias("diff"), a.cast("string").alias("main_value"), b.cast("string").alias("copy_value"))
    none = F.lit(None)
    pairs = F.array_compact(F.array(*[F.when(f.differs(F.col(f"__a.{f.name}"), F.col(f"__b.{f.name}")), one(f.name, F.col(f"__a.{f.name}"), F.col(f"__b.{f.name}"))) for f in fields]))
    cases = F.when(F.col("__b").isNull(), F.array(one("only_main", none, none))).when(F.col("__a").isNull(), F.array(one("only_copy", none, none))).otherwise(pairs)
    out = materialize(both.select(*keys, F.explode(cases).alias("__x")).select(*keys, "__x.*"), "differences")
    release(wanted)
    return out
