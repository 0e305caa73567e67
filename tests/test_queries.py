import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestar.plans import workload

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_matches_sql(spark, tables, name):
    df = workload.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in workload.ORACLE_SQL:
        assert got
        return
    q = tables.sql(workload.ORACLE_SQL[name])
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in q.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
