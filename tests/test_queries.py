"""Every query with a DuckDB equivalent against it, at the smallest scale."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from paraforge.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for file in glob.glob(f"{sf}/*.parquet"):
        connection.execute(f"create view {os.path.basename(file)[:-8]} as select * from '{file}'")
    return connection


def plain(rows):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        return v

    return sorted((tuple(value(v) for v in row) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, duck, name):
    ours = QUERIES[name](spark, sf)
    theirs = duck.sql(ORACLE_SQL[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    assert plain(tuple(r[n] for n in names) for r in ours.collect()) == plain(tuple(r[theirs.columns.index(n)] for n in names) for r in theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_projection_reaches_the_scan(spark, sf):
    plan = QUERIES["project_flat"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan
