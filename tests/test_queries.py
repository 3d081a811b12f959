"""Every registered query against its SQL, or for rows where it has none."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small_sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small_sf}/{t}.parquet'")
    return con


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, small_sf, duck, name):
    df = entry.queries()[name](spark, small_sf)
    rows = [r.asDict() for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.sql(sql)
    columns = sorted(df.columns)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    key = lambda r: tuple(repr(x) for x in r)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)
    assert own == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=key)


def test_entry(spark, small_sf):
    assert entry.entry(spark).count() > 0
