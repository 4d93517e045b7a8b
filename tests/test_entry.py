"""The driver's contract: every registered query runs and agrees with its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as e
from strandix.plans import catalog_queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{D}/{f}'")
    return con


def test_entry(spark):
    assert e.entry(spark).columns == ["o_orderkey", "o_orderstatus"]


def test_registry():
    assert set(e.oracle_sql()) <= set(e.queries()) and set(catalog_queries.QUERIES) <= set(e.queries())


def flat(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalog_queries.QUERIES[name](spark, D)
    want = duck.execute(catalog_queries.ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert flat([tuple(r) for r in df.collect()], df.columns) == flat(want.fetchall(), cols)
