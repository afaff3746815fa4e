"""Registered queries against their SQL in a second engine, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from bracken import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(found.columns)
    at = [found.columns.index(c) for c in sorted(df.columns)]
    want = sorted(tuple(repr(r[k]) for k in at) for r in found.fetchall())
    assert sorted(tuple(repr(r[c]) for c in sorted(df.columns)) for r in df.collect()) == want


def test_every_query_without_sql_gives_rows(spark):
    for name in set(catalogue.queries()) - set(SQL):
        assert catalogue.queries()[name](spark, SF).count() > 0
