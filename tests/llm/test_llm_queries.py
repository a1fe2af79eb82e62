"""Queries of the llm subpackage that have SQL, against DuckDB on the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from ledgerwake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return "NaN" if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = Counter(tuple(plain(dict(zip(columns, r, strict=True))[c]) for c in order) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
