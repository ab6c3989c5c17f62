"""Fill-in-middle: the rank index is exact, outputs equal plain slicing and give the text back."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import infill


@pytest.mark.parametrize("error", [1, 16, 1024])
def test_rank_index_is_exact_within_its_bound(error):
    pick = np.random.default_rng(error)
    jumps = np.where(pick.random(5000) < 0.01, 100_000, pick.integers(0, 90, 5000))
    for offsets in (np.cumsum(jumps), np.arange(3000) * 7, np.zeros(50, int), np.array([5]), np.array([], int)):
        index = infill.RankIndex(offsets, error)
        ranks = np.arange(len(offsets))
        assert (index.offset(ranks) == offsets).all()
        assert len(offsets) == 0 or np.abs(index.residual).max() <= error + 1
    assert len(infill.RankIndex(np.arange(3000) * 7, error).first) == 1


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    x = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transform_equals_slicing_and_restores(docs, awkward):
    pick = random.Random(3)
    made = ["".join(pick.choices(["\n", "a", "ß€", "𝄞", "<P", "<", ">", "S>", "\r", " "], k=pick.randint(0, 60))) for _ in range(300)]
    rows = awkward + list(enumerate(made, 100)) + [(900, "x <M> y"), (901, "\n\n\n"), (902, "a\n" * 50_000)]
    table = docs(rows)
    got = infill.transform(table).withColumn("again", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(*r) for r in rows), key=key)
    texts = {}
    for i, text in rows:
        texts.setdefault(i, set()).add(text or "")
    assert all(r["again"] in texts[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_columns(docs, spark):
    table = docs([(1, "a\nb\nc")])
    wide = table.selectExpr("*", "1 AS h0", "'x' AS form", "2 AS output", "3 AS n")
    assert infill.transform(wide).collect() == infill.transform(table).collect()
    assert infill.transform(table.limit(0)).collect() == []


def test_query_matches_sql(spark, data_dir):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data_dir}/documents.parquet'")
    cursor = con.execute(entry.oracle_sql()["op11_fill_in_middle"])
    names = [c[0] for c in cursor.description]
    got = entry.queries()["op11_fill_in_middle"](spark, data_dir)
    assert sorted(got.columns) == sorted(names)
    want = sorted(cursor.fetchall())
    assert sorted(map(tuple, got.select(*names).collect())) == want
