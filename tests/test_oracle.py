"""Every query with standard SQL gives its result, on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from tidemark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        v = float(v)
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, con, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in frame.collect())
    found = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_have_a_schema(spark, name):
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").columns
