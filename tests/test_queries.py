"""Every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(columns, found):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    flat = lambda v: round(float(v), 5) if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return order, sorted((tuple(flat(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    got = rows(df.columns, df.collect())
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert got == rows(rel.columns, rel.fetchall())
    else:
        assert got[1]


def test_entry(spark):
    assert entry.entry(spark).count() == 200
