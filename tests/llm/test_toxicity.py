import numpy as np
from pyspark.sql import functions as F

from candlewick.llm import toxicity


def test_learns_a_pair_that_no_weight_can_tell():
    """Both terms or neither are bad: weights alone cannot separate these rows."""
    pick = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(3000):
        a, b = pick.integers(0, 2, 2)
        terms = {int(x) for x in pick.integers(10, 40, 3)}
        terms |= {1} if a else {3}
        terms |= {2} if b else {4}
        rows.append(np.array(sorted(terms), np.int32))
        labels.append(float(a == b))
    settings = toxicity.Settings(buckets=64, min_chi=0.0, epochs=40)
    machine = toxicity.train(rows[:2000], np.array(labels[:2000]), settings)
    hit = [(machine.score(r) > 0.5) == bool(y) for r, y in zip(rows[2000:], labels[2000:])]
    assert np.mean(hit) > 0.95


def test_keeps_terms_that_tell_only_in_pairs():
    """The default filter sees no effect of either term; rows outside the pair have no such term."""
    pick = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(4000):
        a, b = pick.integers(0, 2, 2)
        terms = {int(x) for x in pick.integers(10, 500, 20)}
        terms |= {1 if a else 3, 2 if b else 4}
        rows.append(np.array(sorted(terms), np.int32))
        labels.append(float(a == b))
    settings = toxicity.Settings(buckets=512)
    known = toxicity.telling(rows[:3000], np.array(labels[:3000]), settings)
    assert not set(known.tolist()) & {1, 2, 3, 4}
    machine = toxicity.train(rows[:3000], np.array(labels[:3000]), settings)
    hit = [(machine.score(r) > 0.5) == bool(y) for r, y in zip(rows[3000:], labels[3000:])]
    assert np.mean(hit) > 0.95
    assert set(np.flatnonzero(machine.factors.any(1)).tolist()) == {1, 2, 3, 4} | set(known.tolist())
    noise = toxicity.train(rows, pick.permutation(labels), settings)
    assert np.count_nonzero(noise.weights) <= 1


def test_pair_sum_is_the_sum_over_pairs():
    pick = np.random.default_rng(2)
    machine = toxicity.Machine(0.3, pick.normal(size=8), pick.normal(size=(8, 3)))
    terms = np.array([0, 2, 5, 7])
    pairs = sum(float(machine.factors[a] @ machine.factors[b]) for a in terms for b in terms if a < b)
    assert np.isclose(machine.raw(terms), 0.3 + machine.weights[terms].sum() + pairs)


def test_held_out_accuracy(spark, data_dir):
    data = data_dir.replace("0.001", "0.1")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    held = toxicity.fold(F.col("doc_id"), 4) == 2
    machine = toxicity.learn(docs, labels, held)
    rows = toxicity.score(docs.filter(held), machine).join(labels, "doc_id").select("score", "toxic").collect()
    bad = [r["score"] >= 0.3 for r in rows if r["toxic"]]
    good = [r["score"] >= 0.3 for r in rows if not r["toxic"]]
    assert np.mean(bad) > 0.85 and np.mean(good) < 0.01


def test_collects_one_row_of_a_repeated_id(spark, docs, monkeypatch):
    met = []
    monkeypatch.setattr(toxicity, "train", lambda rows, labels, settings: met.append((rows, labels)))
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    toxicity.learn(docs([(1, f"word{i}") for i in range(50)] + [(2, "x")]), labels, F.lit(False))
    assert len(met[0][0]) == 2 and met[0][1].tolist() == [1.0, 0.0]


def test_odd_rows_and_empty_tables(spark, docs, awkward):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1), (77, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    df = docs(awkward)
    machine = toxicity.learn(df, labels, F.lit(False))
    scores = toxicity.score(df, machine).collect()
    assert len(scores) == len(awkward) and all(0 <= r["score"] <= 1 for r in scores)
    assert len({r["score"] for r in scores if r["doc_id"] == 5}) == 1
    silent = toxicity.learn(df, none, F.lit(False))
    assert all(r["score"] < 1e-6 for r in toxicity.score(df, silent).collect())
    assert toxicity.score(docs([]), silent).collect() == []
    kept = toxicity.keep_clean(df.withColumn("score", F.lit("x")), silent)
    assert kept.columns == [*df.columns, "score"] and kept.count() == len(awkward)
