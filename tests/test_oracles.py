"""Every query with an oracle gives the oracle's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    plain = lambda v: "null" if v is None else repr(round(v, 6)) if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES) and len(ORACLES) > 50


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
