"""Registration, and SQL checks where there is SQL."""

import re

import duckdb

import __spark_entry__ as entry


def test_one_query_for_each_operator():
    names = list(entry.queries())
    numbers = sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in names


def test_quality_matches_sql(spark, data_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    cursor = con.execute(entry.oracle_sql()["op4_quality_rules"])
    names = [c[0] for c in cursor.description]
    got = entry.queries()["op4_quality_rules"](spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())
