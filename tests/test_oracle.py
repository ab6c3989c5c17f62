"""Every query with SQL must give DuckDB's rows on the same tables."""

import datetime as dt
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{data}/{name}'")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.date() if v.time() == dt.time() else v
    if isinstance(v, float) and v != v:
        return None
    return v


def canonical(rows, names):
    order = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 60


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = canonical(cursor.fetchall(), names)
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0
