import math

import pytest
from pyspark.sql import functions as F

from candlewick.operators import models, text


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


LEX = [("good", 1.9), ("bad", -2.5), ("great", 3.1)]


def scores(spark, *texts, **kw):
    lexicon = spark.createDataFrame(LEX, "token string, valence double")
    out = text.sentiment(text.tokens(docs(spark, *texts)), lexicon, **kw)
    return {r.doc_id: r for r in out.collect()}


def test_tokens_cover_whole_texts(spark):
    long = "Über-Größe don't 42 " * 5000
    tok = text.tokens(docs(spark, long, None, "", "!!"))
    assert tok.count() == 20000
    assert [r.token for r in tok.filter("pos < 4").orderBy("pos").collect()] == ["über", "größe", "don", "t"]


def test_plain_scores(spark):
    got = scores(spark, "good good bad thing", "plain words", "", "bad")
    s = 1.9 * 2 - 2.5
    assert got[0].sentiment_score == round(s / math.sqrt(s * s + 15), 4)
    total = 2.9 * 2 + 3.5 + 1
    assert got[0].positive_score == round(5.8 / total, 3)
    assert got[0].negative_score == round(3.5 / total, 3)
    assert got[0].neutral_score == round(1 / total, 3)
    assert (got[1].sentiment_score, got[1].neutral_score, got[1].sentiment_label) == (0.0, 1.0, "neutral")
    assert 2 not in got
    assert got[3].sentiment_label == "negative" and -1 < got[3].sentiment_score < 0


def test_negation_and_boost(spark):
    kw = {"negations": ["not"], "boosters": {"very": 1.0, "barely": -1.0}}
    got = scores(spark, "not so good", "very good", "barely a bad", "not a b c good", **kw)
    c = lambda v: round(v / math.sqrt(v * v + 15), 4)
    assert got[0].sentiment_score == c(1.9 * -0.74)
    assert got[1].sentiment_score == c(1.9 + 0.293)
    assert got[2].sentiment_score == c(-2.5 + 0.293 * 0.95)
    assert got[3].sentiment_score == c(1.9)


def test_cleaning_paths_agree(spark):
    df = docs(spark, "The cats and THE dogs", "of the")
    direct = text.clean(df, ["the", "and", "of"], {"cats": "cat"}).select("doc_id", "content")
    assert sorted(map(tuple, direct.collect())) == [(0, "cat dogs"), (1, "")]
    lemmas = spark.createDataFrame([("cats", "cat")], "token string, lemma string")
    joined = text.rejoin(text.lemmatize(text.drop_stop_words(text.tokens(df), ["the", "and", "of"]), lemmas))
    assert sorted(map(tuple, joined.collect())) == [(0, "cat dogs")]


def test_ngrams(spark):
    df = docs(spark, "aa bb aa bb c", "zz", "")
    got = sorted((r.doc_id, r.term, r.tf) for r in text.term_counts(text.ngrams(df, 1, 3)).collect())
    assert got == [
        (0, "aa", 2), (0, "aa bb", 2), (0, "aa bb aa", 1), (0, "bb", 2), (0, "bb aa", 1),
        (0, "bb aa bb", 1), (1, "zz", 1),
    ]


def test_tfidf_and_vocabulary(spark):
    df = docs(spark, "aa bb aa", "bb cc", "")
    terms = text.ngrams(df, 1, 1)
    got = {(r.doc_id, r.term): r.weight for r in text.tfidf(text.term_counts(terms), df).collect()}
    rare, common = math.log(4 / 2) + 1, math.log(4 / 3) + 1
    norm = math.hypot(2 * rare, common)
    assert got[(0, "aa")] == pytest.approx(2 * rare / norm)
    assert got[(0, "bb")] == pytest.approx(common / norm)
    assert sum(v * v for (d, _), v in got.items() if d == 1) == pytest.approx(1)
    kept = text.limit_vocabulary(terms, 2).select("term").distinct().collect()
    assert {r.term for r in kept} == {"aa", "bb"}


def test_classifier_learns_a_word(spark):
    rows = [(i, f"{'good' if i % 3 else 'bad'} word{i % 7} filler", "pos" if i % 3 else "neg", 0.0)
            for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label_name string, share double")
    featured = models.text_features(df, "text", ["share"], 256)
    out = models.sentiment_classifier(featured, "label_name")
    assert out.count() == 120
    assert out.filter(F.col("label_name") != F.col("predicted_sentiment")).count() == 0


def test_context_in_the_row_equals_the_window(spark):
    from candlewick.operators import text

    docs = spark.createDataFrame([(1, "not very good, good"), (2, ""), (3, None), (4, "bad not")], "doc_id int, text string")
    lexicon = spark.createDataFrame([("good", 1.9), ("bad", -2.5)], "token string, valence double")
    rules = {"negations": ["not"], "boosters": {"very": 1.0}}
    near = text.sentiment(text.in_context(docs), lexicon, **rules)
    far = text.sentiment(text.tokens(docs), lexicon, **rules)
    assert sorted(near.collect()) == sorted(far.collect())
    assert "Window" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_every_term_has_a_feature_of_its_own(spark):
    """More terms than any small number of buckets could part; weights match the long tables."""
    words = [f"w{i:04d}" for i in range(600)]
    rows = [(i, " ".join(words[i * 20 : i * 20 + 40]), 0.25) for i in range(29)] + [(99, "", 0.5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    got = {r.doc_id: r.raw for r in models.text_features(df, "text", ["share"]).collect()}
    single = text.term_counts(text.ngrams(df, 1, 1))
    index = {r["term"]: r["index"] for r in text.term_index(text.ngrams(df, 1, 2), 1 << 17).collect()}
    assert len(index) == len(set(index.values())) == 600 + 599
    want = {}
    for r in text.tfidf(single, df).collect():
        want.setdefault(r.doc_id, {})[index[r.term]] = r.weight
    for r in text.term_counts(text.ngrams(df, 2, 2)).collect():
        want[r.doc_id][index[r.term]] = float(r.tf)
    for i, vector in got.items():
        pairs = dict(zip(vector.indices.tolist(), vector.values.tolist()))
        assert vector.size == len(index) + 1 and pairs.pop(len(index)) == (0.5 if i == 99 else 0.25)
        assert pairs == pytest.approx(want.get(i, {}))


def test_a_lexicon_by_function_needs_no_join(spark):
    from candlewick.sources import views

    df = docs(spark, "good good bad thing not good", "plain words", "", None, "très mauvais jour")
    table = views.lexicon(text.tokens(df))
    for rules in ({}, {"negations": ["not"], "boosters": {"good": 1.0}}):
        rows = text.in_context(df) if rules else text.tokens(df)
        near = text.sentiment(rows, views.valence, **rules)
        assert sorted(near.collect()) == sorted(text.sentiment(rows, table, **rules).collect())
        assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_corpus_counts_of_repeated_and_missing_documents(spark):
    rows = [(1, "aa bb aa bb"), (1, "aa bb cc"), (2, "aa bb"), (None, "aa bb"), (None, "bb aa"), (3, None), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for lo, hi in ((2, 2), (1, 3)):
        tf = text.term_counts(text.ngrams(df, lo, hi))
        want = tf.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("total"))
        out = text.corpus_counts(df, lo, hi)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    plan = text.corpus_counts(df, 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_candidates_hold_the_whole_vocabulary(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.15)), 60):02d}" for _ in range(rng.randrange(40))) for _ in range(60)]
    df = docs(spark, *texts, None, "")
    every = text.ngrams(df, 1, 3)
    for size in (5, 40, 1000):
        kept = text.candidates(df, 3, size)
        order = ["total", "term"]
        want = sorted(map(tuple, text.vocabulary(every, size).select(*order).collect()))
        assert sorted(map(tuple, text.vocabulary(kept, size).select(*order).collect())) == want
        terms = [t for _, t in want]
        count = lambda rows: sorted(map(tuple, text.term_counts(rows.filter(F.col("term").isin(terms))).collect()))
        assert count(kept) == count(every)
    assert text.candidates(df, 3, 5).count() < every.count()


def test_features_of_documents_partitioned_by_id(spark):
    rows = [(i, f"w{i % 7} w{i % 5} w{i % 3}", 0.5) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        got = models.text_features(df.repartition(8, "doc_id"), "text", ["share"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = {r.doc_id: r.raw for r in models.text_features(df.coalesce(1), "text", ["share"]).collect()}
    assert len(got) == 200
    for r in got:
        assert r.raw.indices.tolist() == want[r.doc_id].indices.tolist()
        assert r.raw.values.tolist() == pytest.approx(want[r.doc_id].values.tolist())


def test_tfidf_of_texts_exchanges_no_row_per_common_word(spark, monkeypatch):
    rows = [(1, "aa bb aa"), (1, "bb cc Über über"), (2, "aa bb"), (None, "aa bb x"), (None, "bb aa"), (3, None),
            (4, "x"), (5, ""), (6, "zz zz zz yy"), (7, " ".join(f"w{i}" for i in range(3000)) + " aa" * 999)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = df.filter(F.col("text").isNotNull())
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.term)
    want = sorted(text.tfidf(text.term_counts(text.ngrams(whole, 1, 1)), whole).collect(), key=key)
    for size in (1 << 18, 3, 0):
        monkeypatch.setattr(text, "COMMON_TERMS", size)
        out = text.text_tfidf(df)
        got = sorted(out.collect(), key=key)
        assert [r[:4] for r in got] == [r[:4] for r in want]
        assert [r.weight for r in got] == pytest.approx([r.weight for r in want], rel=1e-12)
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert text.text_tfidf(df.filter("doc_id > 99")).collect() == []


def test_tfidf_queries_cut_texts_without_a_row_per_word(spark, data, monkeypatch):
    from candlewick.plans import catalog

    def refuse(*_):
        raise AssertionError("a row per word is exchanged")

    monkeypatch.setattr(text, "term_counts", refuse)
    for name in ("tfidf", "tfidf_top"):
        assert catalog.queries()[name](spark, data).count() > 0


def test_features_exchange_no_row_per_word(spark, monkeypatch):
    from candlewick.operators import packed

    rows = [(1, "aa bb aa", 0.1), (1, "cc aa Über", 0.2), (2, "aa bb", 0.3), (None, "aa cc", 0.4), (3, None, 0.5),
            (4, "", 0.6), (5, " ".join(f"w{i}" for i in range(300)) + " aa bb", 0.7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, share double")

    def refuse(*_):
        raise AssertionError("a row per word is exchanged")

    monkeypatch.setattr(models, "ngrams", refuse, raising=False)
    monkeypatch.setattr(packed, "candidates", refuse)
    words, total = {}, {}
    for doc, body, _ in rows:
        cut = (body or "").lower().split()
        for terms, into in ((cut, words.setdefault(doc, {})), ([" ".join(x) for x in zip(cut, cut[1:])], words[doc])):
            for t in terms:
                into[t] = into.get(t, 0) + 1
                total[t] = total.get(t, 0) + 1
    for size, common in ((7, 1 << 18), (7, 2), (3, 0), (2000, 5)):
        monkeypatch.setattr(packed, "COMMON_TERMS", common)
        index = sorted(sorted(total, key=lambda t: (-total[t], t))[:size])
        df_of = lambda t: sum(t in w for w in words.values())
        raw = {d: {t: n if " " in t else n * (math.log(8 / (1 + df_of(t))) + 1) for t, n in w.items()} for d, w in words.items()}
        got = models.text_features(df, "text", ["share"], size, keep=["doc_id", "share"]).collect()
        assert len(got) == len(rows)
        for r in got:
            w = raw[r.doc_id] if r.doc_id is not None else {}
            norm = math.sqrt(sum(v * v for t, v in w.items() if " " not in t))
            want = {i: w[t] if " " in t else w[t] / norm for i, t in enumerate(index) if t in w}
            assert r.raw.indices.tolist() == [*sorted(want), len(index)]
            assert r.raw.values.tolist() == pytest.approx([*(want[i] for i in sorted(want)), r.share])


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_classifier_reaches_the_optimum_in_passes_over_blocks(spark, monkeypatch, levels):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    from candlewick.operators import logistic

    rng = np.random.default_rng(levels)
    x = rng.random((300, 6)) * (rng.random((300, 6)) < 0.5)
    x[:, 4], x[:, 5] = 0.1, 0.0  # a constant and an empty feature
    names = ["a", "b", "c"][:levels]
    label = [names[int(i)] for i in np.minimum(x[:, 0] * 2 + x[:, 1] + rng.random(300), levels - 1)]
    vectors = [Vectors.dense(r) if i % 7 == 0 else Vectors.sparse(6, [(int(j), float(r[j])) for j in np.flatnonzero(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(list(zip(range(300), label, vectors)), ["doc_id", "label_name", "raw"])
    found = []
    fit = logistic.fit
    monkeypatch.setattr(logistic, "fit", lambda *a: found.append(fit(*a)) or found[-1])
    monkeypatch.setattr(logistic, "BLOCK", 40)
    out = {r.doc_id: r for r in models.sentiment_classifier(df, "label_name", tol=1e-12).collect()}
    assert len(out) == 300
    weights = found[0][:, :-1], found[0][:, -1]
    train = np.array([out[i].part == "train" for i in range(300)])
    size = weights[0].shape[1]
    z = x[:, :size] @ weights[0].T + weights[1]
    assert [out[i].predicted_sentiment for i in range(300)] == [names[k] for k in z.argmax(axis=1)]
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    residual = (p - (np.array(label)[:, None] == np.array(names)))[train]
    spread = x[train, :size].std(axis=0, ddof=1)
    spread[:4][spread[:4] == 0] = 1
    assert (weights[0][:, 4:] == 0).all()
    # At the optimum of the scaled features: sum of residuals times features + weights = 0.
    scaled = x[train, :4] / spread[:4]
    assert np.abs(residual.T @ scaled + weights[0][:, :4] * spread[:4]).max() < 1e-3
    assert np.abs(residual.sum(axis=0)).max() < 1e-3
