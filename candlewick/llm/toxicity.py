"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms (words and the beginnings of words), hashed into a fixed
number of buckets. The score is a bias,
a weight per term and, through the terms' factor vectors, a weight for every pair of terms
that occur together: an insult beside a group mention counts for more than the two alone.

Learning reads at most ``Settings.train_rows`` labelled rows, those with the smallest id
hash, so the sample is the same on every run and its size does not follow the corpus. The
model is a fixed number of floats. Scoring reads every whole text in one pass without a shuffle.

NULL or empty text has no terms and scores the bias. Repeated rows score alike. Rows without
a label, and labels without a document, are not learnt from. If nothing can be learnt every
score is 0. Extra columns pass through `keep_clean`, whatever their names, and are ignored by
`score`. Of learnt rows that repeat an id with different texts one counts; labels that
contradict each other count as toxic. A very long text is the set of its terms, at most as many
as there are buckets. An empty table gives no scores.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

CACHE_WORDS = 500_000
# ASCII other than letters and digits separates terms; other alphabets stay as they are.
SEPARATORS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

PREFIXES = (4, 5, 6)  # bytes


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 18
    factors: int = 8
    train_rows: int = 20_000
    min_rows: int = 5
    min_chi: float = 15.0
    epochs: int = 20
    batch: int = 256
    rate: float = 0.1
    decay: float = 2e-4
    seed: int = 7


class Terms:
    """A text's distinct term buckets."""

    def __init__(self, buckets: int):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = list(set(text.lower().translate(SEPARATORS).split()))
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > CACHE_WORDS:
                self.known.clear()
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.known[words[i]] = self.buckets_of(words[i])
        return np.unique(np.frombuffer(b"".join(found), np.int32))

    def buckets_of(self, word: bytes) -> bytes:
        """Buckets of the word and of its beginnings, which inflected forms share."""
        parts = [word, *(b"^" + word[:n] for n in PREFIXES if len(word) > n)]
        return np.array([zlib.crc32(p) % self.buckets for p in parts], np.int32).tobytes()


class Machine(NamedTuple):
    """Bias, weights and factors by bucket; buckets too rare to learn stay zero."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, terms: np.ndarray) -> float:
        if not len(terms):
            return self.bias
        v = self.factors[terms]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return self.bias + float(self.weights[terms].sum()) + pairs

    def score(self, terms: np.ndarray) -> float:
        return float(sigmoid(np.float64(self.raw(terms))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def telling(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets whose rows differ in their labels beyond chance, by the chi-square statistic.

    The others would add noise that grows with the length of a text.
    """
    if not rows:
        return np.zeros(0, np.int64)
    ids = np.concatenate(rows)
    of = np.repeat(labels, [len(r) for r in rows])
    seen = np.bincount(ids, minlength=settings.buckets)
    return differing(seen, np.bincount(ids, of, settings.buckets), len(rows), labels.mean(), settings)


def differing(seen: np.ndarray, bad: np.ndarray, n: int, share: float, settings: Settings) -> np.ndarray:
    """`telling` from each bucket's rows and toxic rows."""
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = seen * share * (1 - share) * (n - seen) / n
        chi = np.where(spread > 0, (bad - seen * share) ** 2 / spread, 0.0)
    return np.flatnonzero((seen >= settings.min_rows) & (chi >= settings.min_chi))


def joint(rows: list[np.ndarray], labels: np.ndarray, scores: np.ndarray, used: np.ndarray, settings: Settings) -> np.ndarray:
    """Buckets outside ``used`` that tell only beside another one, found in rows that ``scores`` gets wrong.

    A pair counts if the share of toxic rows among those that hold both terms lies outside the
    shares of either term and of all rows by more than chance, over all pairs tested, allows
    (Chernoff's bound). Rows with the same terms are one, so that copies prove nothing.
    """
    first = sorted({hashlib.blake2b(r.tobytes(), digest_size=16).digest(): i for i, r in enumerate(rows)}.values())
    rows, labels, scores = [rows[i] for i in first], labels[first], scores[first]
    share = labels.mean()
    if not 0 < share < 1:
        return np.zeros(0, np.int64)
    # Rows are added up one by one: the driver holds no copy of all terms.
    seen = np.zeros(settings.buckets, np.int32)
    for r in rows:
        seen[r] += 1
    often = seen >= settings.min_rows
    limit = np.log(max(2.0, often.sum() ** 2 / 2)) + 3
    # Fewer rows than this cannot pass, whatever their labels.
    often &= seen >= limit / -np.log(min(share, 1 - share))
    names = np.flatnonzero(often)
    place = np.full(settings.buckets, -1, np.int32)
    place[names] = np.arange(len(names))
    d, seen = len(names), seen[names]
    toxic, missed = np.zeros(d, np.int32), np.zeros(d, np.int32)
    wrong = np.abs(labels - scores) >= 0.5
    rows = [x[x >= 0] for x in (place[r] for r in rows)]
    for i in np.flatnonzero((labels > 0) | wrong):
        toxic[rows[i]] += labels[i] > 0
        missed[rows[i]] += wrong[i]
    part = toxic / np.maximum(seen, 1)
    chosen = missed >= settings.min_rows
    holders: dict[int, array] = {t: array("i") for t in np.flatnonzero(chosen).tolist()}
    for i, own in enumerate(rows):
        for term in own[chosen[own]].tolist():
            holders[term].append(i)
    new = ~np.isin(names, used)
    found = np.zeros(d, bool)
    for term, own in holders.items():
        both, bad = np.zeros(d, np.int32), np.zeros(d, np.int32)
        for i in own:
            both[rows[i]] += 1
            if labels[i]:
                bad[rows[i]] += 1
        both[term] = 0
        at = np.flatnonzero((both >= settings.min_rows) & (new | new[term]))
        n, rate = both[at], bad[at] / both[at]
        low = np.minimum(np.minimum(share, part[term]), part[at])
        high = np.maximum(np.maximum(share, part[term]), part[at])
        base = np.clip(np.clip(rate, low, high), 1e-9, 1 - 1e-9)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(rate > 0, rate * np.log(rate / base), 0) + np.where(
                rate < 1, (1 - rate) * np.log((1 - rate) / (1 - base)), 0
            )
        hit = at[n * far >= limit]
        found[hit] = True
        found[term] |= len(hit) > 0
    return names[found & new]


def train(rows: list[np.ndarray], labels: np.ndarray, settings: Settings = Settings()) -> Machine:
    """Fit on the telling terms, and again with those that tell only in pairs if there are any."""
    used = telling(rows, labels, settings)
    machine = fit(rows, labels, used, settings)
    if not rows:
        return machine
    scores = np.array([machine.score(r) for r in rows])
    pairs = joint(rows, labels, scores, used, settings)
    return fit(rows, labels, np.union1d(used, pairs), settings) if len(pairs) else machine


def fit(rows: list[np.ndarray], labels: np.ndarray, used: np.ndarray, settings: Settings) -> Machine:
    """Fit the ``used`` buckets by mini-batches with per-parameter step sizes."""
    size, k = settings.buckets, settings.factors
    weights, factors = np.zeros(size, np.float32), np.zeros((size, k), np.float32)
    share = np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share))) if len(labels) else -30.0
    if not len(used):
        return Machine(bias, weights, factors)
    place = np.full(size, -1)
    place[used] = np.arange(len(used))
    rows = [x[x >= 0] for x in (place[r] for r in rows)]
    random = np.random.default_rng(settings.seed)
    n = len(used)
    w, v = np.zeros(n), random.normal(0, 0.02, (n, k))
    sum_w, sum_v, sum_b = np.full(n, 1e-2), np.full((n, k), 1e-2), 1e-2
    for _ in range(settings.epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), settings.batch):
            chosen = order[at : at + settings.batch]
            ids = np.concatenate([rows[i] for i in chosen]).astype(np.int64)
            of = np.repeat(np.arange(len(chosen)), [len(rows[i]) for i in chosen])
            m = len(chosen)
            vi = v[ids]
            total = np.stack([np.bincount(of, vi[:, f], m) for f in range(k)], 1)
            square = np.bincount(of, (vi * vi).sum(1), m)
            raw = bias + np.bincount(of, w[ids], m) + 0.5 * ((total**2).sum(1) - square)
            miss = sigmoid(raw) - labels[chosen]
            hit = np.unique(ids)
            step_w = np.bincount(ids, miss[of], n)[hit] / m + settings.decay * w[hit]
            slope = miss[of, None] * (total[of] - vi)
            step_v = np.stack([np.bincount(ids, slope[:, f], n)[hit] for f in range(k)], 1) / m
            step_v += settings.decay * v[hit]
            sum_w[hit] += step_w**2
            sum_v[hit] += step_v**2
            sum_b += miss.mean() ** 2
            w[hit] -= settings.rate * step_w / np.sqrt(sum_w[hit])
            v[hit] -= 0.2 * settings.rate * step_v / np.sqrt(sum_v[hit])
            bias -= settings.rate * miss.mean() / np.sqrt(sum_b)
    weights[used], factors[used] = w, v
    return Machine(float(bias), weights, factors)


def fold(doc_id: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def learn(docs: DataFrame, labels: DataFrame, held_out: Column, settings: Settings = Settings()) -> Machine:
    """Fit on the labelled rows of ``docs`` for which ``held_out`` (over doc_id) is false."""
    sample = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out)
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(settings.train_rows)
    )

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Terms(settings.buckets)
        for batch in batches:
            made = pa.array([make(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], made], ["doc_id", "toxic", "terms"])

    texts = store.documents(docs).withColumn("text", F.col("text").cast("binary"))
    rows = (
        # The sample is bounded by train_rows.
        texts.join(F.broadcast(sample), "doc_id")
        .select("doc_id", F.col("toxic").cast("int").alias("toxic"), "text")
        .mapInArrow(terms, "doc_id long, toxic int, terms array<int>")
        # Of rows that repeat an id one is learnt from, so no more than train_rows are.
        .groupBy("doc_id", "toxic")
        .agg(F.min("terms").alias("terms"))
    )
    rows = store.keep(rows, "toxicity-terms")
    used = telling_in(rows, settings)
    made, marks = collected(rows, used)
    machine = train(made, marks, settings)
    wrong = np.abs([machine.score(r) - y for r, y in zip(made, marks)]) >= 0.5 if len(made) > settings.min_rows else []
    if np.sum(wrong) < settings.min_rows:  # no term can be short of rows to explain
        return machine
    # Terms that tell only beside another one are looked for among all terms of the rows.
    every, marks = collected(rows)
    pairs = joint(every, marks, np.array([machine.score(r) for r in every]), used, settings)
    del every
    if not len(pairs):
        return machine
    both = np.union1d(used, pairs)
    return fit(*collected(rows, both), both, settings)


def telling_in(rows: DataFrame, settings: Settings) -> np.ndarray:
    """`telling` of a table of rows; one row per bucket reaches the driver."""
    counts = (
        rows.select("toxic", F.explode("terms").alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("seen"), F.sum("toxic").alias("bad"))
        .toArrow()
    )
    seen, bad = np.zeros(settings.buckets), np.zeros(settings.buckets)
    at = counts["b"].to_numpy()
    seen[at], bad[at] = counts["seen"].to_numpy(), counts["bad"].to_numpy()
    n, toxic = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    return differing(seen, bad, n, toxic / n, settings) if n else np.zeros(0, np.int64)


def collected(rows: DataFrame, chosen: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Terms (the ``chosen`` buckets, or all) and labels of at most train_rows rows, by id."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [np.intersect1d(t, chosen, assume_unique=True).astype(np.int32) for t in lists(batch["terms"])]
            yield batch.set_column(2, "terms", pa.array(made, pa.list_(pa.int32())))

    if chosen is not None:
        rows = rows.mapInArrow(only, rows.schema)
    # Sorted in the driver: a sort in Spark would run the job twice.
    table = rows.toArrow().sort_by("doc_id").combine_chunks()
    if not len(table):
        return [], np.zeros(0)
    return lists(table["terms"].chunk(0)), table["toxic"].to_numpy().astype(float)


def lists(terms: pa.ListArray) -> list[np.ndarray]:
    """Views on the values of each row."""
    flat, ends = terms.values.to_numpy(), terms.offsets.to_numpy()
    return [flat[a:z] for a, z in zip(ends, ends[1:])]


def score(docs: DataFrame, machine: Machine, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Terms(settings.buckets), Machine(*shared.value)
        for batch in batches:
            values = [model.score(make(t)) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(values, pa.float64())], ["doc_id", "score"]
            )

    texts = store.documents(docs).withColumn("text", F.col("text").cast("binary"))
    return texts.mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, machine: Machine, limit: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The documents that score below ``limit``, whole rows, in one pass."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(machine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, model = Terms(settings.buckets), Machine(*shared.value)
        for batch in batches:
            texts = (t or "" for t in batch["text"].to_pylist())
            keep = [model.score(make(t.encode())) < limit for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
