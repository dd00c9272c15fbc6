"""Each query with SQL is held against it, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.10g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_agrees_with_its_sql(spark, sql, name):
    got = entry_point.queries()[name](spark, SF)
    want = sql.sql(entry_point.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert mine == theirs


def test_every_query_of_the_engine_has_sql():
    assert set(entry_point.plans.QUERIES) <= set(entry_point.oracle_sql())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
