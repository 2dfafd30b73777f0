"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__
from tessel.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in catalogue.TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    found = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(catalogue.ORACLES[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == names
    assert found == sorted((tuple(plain(r[theirs.index(c)]) for c in names) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["pk_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderkey,1000)" in plan and "o_orderdate" not in plan
