"""Every query with SQL gives the SQL's rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v is None or v != v else str(v) for v in r) for r in frame.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.own.ORACLE))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_order_is_global(spark):
    got = entry.queries()["upcoming_sorted"](spark, SF).toPandas().sort_values("ord")
    assert list(got["ord"]) == list(range(len(got)))
    assert list(zip(got.ts, got.event_id)) == sorted(zip(got.ts, got.event_id))
