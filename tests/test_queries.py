"""Every query that has SQL, against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: Queries of other folders are tested there.
OWN = {k for m in (entry.training, entry.relational, entry.panel, entry.statistics, entry.storage, entry.streamed) for k in m.QUERIES}
SQL = {k: s for k, s in entry.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    """A value as it compares: NaN is not null, doubles to nine digits."""
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "NaN" if math.isnan(v) else float(f"{float(v):.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def equal_to_sql(spark, duck, name, sql):
    got = entry.queries()[name](spark, SF)
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = Counter(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(spark, duck, name):
    equal_to_sql(spark, duck, name, SQL[name])


@pytest.mark.parametrize("name", sorted(OWN - set(SQL)))
def test_without_sql_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
