import os
import random

import pytest

from candlewick.llm import store


@pytest.fixture(scope="session", autouse=True)
def _settings(spark):
    store.configure(spark)


@pytest.fixture
def docs(spark):
    """documents from texts, or (doc_id, text) pairs, with the table's own columns."""

    def make(rows):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def prose():
    """Random words, the same for every run."""

    def make(seed, n, words=400):
        pick = random.Random(seed)
        stock = ["".join(pick.choices("abcdeéßü", k=pick.randint(2, 7))) for _ in range(words)]
        return " ".join(pick.choices(stock, k=n))

    return make


@pytest.fixture
def awkward(prose):
    """Nulls, empty, white space only, very long, ties and repeated rows."""
    long = prose(99, 30_000)
    return [
        (None, prose(1, 80)), (0, None), (1, ""), (2, " \n\t "), (3, long), (4, long[:90_000]),
        (5, prose(1, 80)), (5, prose(1, 80)), (6, prose(1, 80)), (7, "one"), (8, "one two"),
        (9, "ä" * 30), (10, "Ω≈ç \x00 ▁ x"), (11, prose(2, 300) + prose(1, 80)), (None, None),
    ]


@pytest.fixture
def data_dir():
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path
