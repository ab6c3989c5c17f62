import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candlewick.llm import lattice
from candlewick.llm.pieces import MARK, Vocabulary
from candlewick.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    vocabulary = Vocabulary(PATH)
    return lattice.Lattice(vocabulary, lattice.first_weights(vocabulary))


def brute(model, word):
    """Sum over all ways to cut the word, and each piece's expected uses."""
    names = {}
    for i, text in enumerate(model.vocabulary.text):
        if text and i not in model.vocabulary.byte_id:
            names[text.decode().replace(" ", MARK)] = i
    total, uses = 0.0, Counter()
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        ids = []
        for a, b in zip(edges, edges[1:]):
            part = word[a:b]
            if part in names:
                ids.append(names[part])
            elif len(part) == 1:
                ids.extend(model.vocabulary.byte_id[list(part.encode())].tolist())
            else:
                break
        else:
            p = math.exp(sum(model.weights.pieces[i] for i in ids))
            total += p
            for i in ids:
                uses[i] += p
    return math.log(total), {i: u / total for i, u in uses.items()}


WORDS = ["the", "thing", "straße", "a", "naïve", "日本", "x🙂y", "inthe"]


def test_marginals_and_expectations(model):
    got = model.score(WORDS)
    for word, value in zip(WORDS, got):
        want, uses = brute(model, MARK + word)
        assert value == pytest.approx(want, rel=1e-9)
        expected = model.expect([word], np.array([3.0]))
        assert {i: expected[i] for i in np.flatnonzero(expected > 1e-12)} == pytest.approx({i: 3 * u for i, u in uses.items() if 3 * u > 1e-12})


def test_table_against_counts(docs, awkward, prose, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 20)
    rows = [r for r in awkward if r[0] not in (3, 4)] + [(30 + i, prose(i, 60)) for i in range(10)]
    learn = F.col("doc_id") % 3 != 2
    got = lattice.score(docs(rows), learn, PATH).collect()
    words = lambda t: (t or "").encode().lower().split()
    train = [t for i, t in rows if i is not None and i % 3 != 2]
    counts = Counter(w for t in train for w in words(t))
    n, kinds = sum(counts.values()) + len(train), len(counts) + 1
    log = lambda c: math.log10((c + 1) / (n + kinds + 1))
    want = []
    for i, t in rows:
        own = words(t)
        base = sum(log(counts[w]) for w in own) + log(len(train))
        want.append((i, not (i is not None and i % 3 != 2), len(own) + 1, sum(counts[w] > 0 for w in own) + 1, n, base))
    key = lambda r: (repr(r[0]), r[5])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r[6] < 0 for r in got)


def test_training_raises_the_likelihood(docs, prose, spark):
    text = " ".join(["ßß äöü", prose(1, 300)])
    words = lattice.word_counts(docs([text]), F.lit(True))
    vocabulary = Vocabulary(PATH)
    counts = {r["word"]: r["c"] for r in words.collect()}
    totals = []
    for rounds in (0, 1, 2):
        weights = lattice.fit(words, 1, PATH, rounds)
        scores = lattice.Lattice(vocabulary, weights).score(list(counts))
        totals.append(float((scores * np.array(list(counts.values()))).sum()))
        assert np.exp(weights.pieces).sum() + math.exp(weights.end) == pytest.approx(1.0)
    assert totals[0] < totals[1] < totals[2]


def test_plain_and_log_space_agree(model, monkeypatch, prose):
    """Long words, words that underflow a double and characters without a piece included."""
    words = [*dict.fromkeys(prose(3, 400).split()), *WORDS, "a" * 63, "a" * 64, "ab" * 90, "🙂" * 50, "🙂" * 63]
    counts = np.arange(len(words)) % 7 + 1.0
    near = model.score(words), model.expect(words, counts)
    assert np.isfinite(near[0]).all() and near[0].min() / math.log(10) < -308
    monkeypatch.setattr(lattice, "LONGEST", 0)
    far = model.score(words), model.expect(words, counts)
    assert near[0] == pytest.approx(far[0], rel=1e-12)
    assert near[1] == pytest.approx(far[1], rel=1e-9, abs=1e-12)


def test_small_batches_are_worked_out_together(monkeypatch):
    batches = [pa.RecordBatch.from_pydict({"word": [f"w{i}", "x"]}) for i in range(10)] + [pa.RecordBatch.from_pydict({"word": pa.array([], pa.string())})]
    assert [t.num_rows for t in lattice.gathered(iter(batches))] == [20]
    monkeypatch.setattr(lattice, "AT_ONCE", 7)
    tables = list(lattice.gathered(iter(batches)))
    assert [t.num_rows for t in tables] == [8, 8, 4]
    assert [w for t in tables for w in t["word"].to_pylist()] == [w for b in batches for w in b["word"].to_pylist()]
    assert list(lattice.gathered(iter([]))) == []


def test_no_rows(docs):
    assert lattice.score(docs([]), F.lit(True), PATH).collect() == []
