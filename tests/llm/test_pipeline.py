"""Every stage against a plain version on the rows it was given."""

import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline  # noqa: E402
from test_packing import PATH  # noqa: E402
from test_simhash import brute_fingerprint, brute_groups  # noqa: E402
from test_suffixes import brute as brute_repeats  # noqa: E402

from candlewick.llm import queries, store, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def kept(spark):
    """The rows before the first and after each stage."""
    data = "/root/testdata/sf0.01"
    if not Path(data).is_dir():
        pytest.skip("no test tables here")
    docs = queries.documents(spark, data)
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = store.keep(stage(spark, docs, data), "test-stage")
        out.append(docs.collect())
        if name != "best-fit packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return data, out


def test_quality(kept):
    data, rows = kept
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    sql = queries.ORACLES["op4_quality_rules"]
    want = [r[0] for r in con.execute(f"SELECT doc_id FROM ({sql}) WHERE kept").fetchall()]
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(want)
    assert set(rows[1]) <= set(rows[0])


def test_toxicity(kept, spark):
    data, rows = kept
    assert set(rows[2]) <= set(rows[1])
    gone = {r["doc_id"] for r in rows[1]} - {r["doc_id"] for r in rows[2]}
    bad = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    known = [bad[i] for i in gone if i in bad]
    assert known and np.mean(known) > 0.95


def test_near_dedup(kept):
    _, rows = kept
    marks = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows[2]]
    heads = {g for _, _, g in brute_groups(marks)}
    assert sorted(r["doc_id"] for r in rows[3]) == sorted(heads)
    assert set(rows[3]) <= set(rows[2])


def test_suffix_dedup(kept):
    _, rows = kept
    want = {r[0]: r for r in brute_repeats([(r["doc_id"], r["text"]) for r in rows[3]])}
    assert len(rows[4]) == len(rows[3])
    for r in rows[4]:
        left = want[r["doc_id"]]
        assert len(r["text"].encode()) <= left[1] - left[2]
        assert len(r["text"].encode()) >= left[1] - left[2] - 8 * (left[3] + 1)
        assert r["n_chars"] == len(r["text"])


def test_packing(kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    _, rows = kept
    want = Counter()
    for r in rows[4]:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in rows[5]) == want
    tokens = sum(k[3] * n for k, n in want.items())
    assert len({r["sequence_id"] for r in rows[5]}) <= 1.02 * -(-tokens // 2048) + 1


def test_stages_take_odd_tables(spark, docs, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for rows in ([], awkward):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs(rows), str(tmp_path)).collect()
