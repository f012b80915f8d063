"""Every query against its SQL counterpart on the smallest tables, where they are present."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if x is None or x != x else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    got, want = entry.queries()[name](spark, DIR).toPandas(), db.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, DIR)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
