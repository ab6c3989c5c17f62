"""Language-model scores by subword lattice likelihood.

The pieces come from an existing vocabulary. A word's probability is the sum over all its
segmentations into pieces, found by a forward recursion; a document's is the
product over its words and one end mark. Words whose probability a double cannot hold safely,
and long words, are worked out in log space. Piece weights start at the vocabulary's own order
of scores and are then re-estimated on the training texts by expected counts.

Everything about a word is computed once per distinct word: counts are summed in the tasks
before they are shuffled by word, expected counts are one row per piece, and documents look
their words up. The most frequent words (a fixed number) travel to every task; the rest,
each of them rarer than all of those, meet the word table in a join.

Text is cut at space and the control characters 09 to 0D, A-Z lowered. NULL or empty text
has only its end mark. NULL ids belong to the held-out rows. Repeated rows
are scored one by one and counted as often as they occur. Without training rows the piece
weights stay at their start. Extra columns are ignored, whatever their names; an empty table
gives no rows. A very long text is scored by its words; a word's lattice costs a step per
character, so a word of a million characters is slow, not cut.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store
from candlewick.llm.pieces import BASE, MARK, Vocabulary, batches_of

FREQUENT = 1 << 16
HELD_WORDS = 400_000
AT_ONCE = 1 << 16  # words that a task works out together
AT_ONCE_BYTES = 1 << 24
CELLS = 1 << 15  # characters of equally long words whose lattices fit a core's cache
SLOT_BITS = 18
LONGEST = 64  # characters; longer words go to log space at once
LEAST = 1e-200  # all that underflows is smaller than this by a hundred powers of ten
LOG10 = math.log(10)
MICRO = 1_000_000  # expected counts are summed as whole millionths, in any order alike


class Weights(NamedTuple):
    """Natural log probability of every piece and of the end mark."""

    pieces: np.ndarray
    end: float


def first_weights(vocabulary: Vocabulary) -> Weights:
    """Weights falling with a piece's place in the vocabulary's order of scores."""
    rank = np.argsort(np.argsort(-vocabulary.scores, kind="stable"), kind="stable")
    share = 1.0 / (rank + 10.0)
    share[vocabulary.byte_id] = share.min()
    share /= share.sum() * 1.05
    return Weights(np.log(share), math.log(0.05 / 1.05))


def reweigh(expected: np.ndarray, ends: int, floor: float = 0.01) -> Weights:
    """Probabilities from expected counts, none of them zero."""
    total = expected.sum() + floor * len(expected) + ends + floor
    return Weights(np.log((expected + floor) / total), math.log((ends + floor) / total))


class Lattice:
    def __init__(self, vocabulary: Vocabulary, weights: Weights):
        self.vocabulary, self.weights = vocabulary, weights
        self.odds = np.exp(weights.pieces)
        slot = (vocabulary.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.full(1 << SLOT_BITS, -1, np.int32)  # first key of each slot of sorted keys
        self.slots[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.crowd = int(np.bincount(slot).max())

    def edges(self, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(ids, log weights) by length; characters without a piece weigh as their bytes."""
        ids = self.vocabulary.matches(codes)
        logs = [np.where(i >= 0, self.weights.pieces[i], -np.inf) for i in ids]
        for code in np.unique(codes[ids[0] < 0]):
            own = self.vocabulary.byte_id[list(chr(code).encode())]
            logs[0][(codes == code) & (ids[0] < 0)] = self.weights.pieces[own].sum()
        return ids, logs

    @staticmethod
    def forward(logs: list[np.ndarray], size: int) -> np.ndarray:
        """alpha[j]: log probability of the first j characters over all segmentations."""
        alpha = np.full((size + 1, len(logs[0])), -np.inf)
        alpha[0] = 0
        for j in range(1, size + 1):
            for length in range(1, min(j, len(logs)) + 1):
                alpha[j] = np.logaddexp(alpha[j], alpha[j - length] + logs[length - 1][:, j - length])
        return alpha

    @staticmethod
    def backward(logs: list[np.ndarray], size: int) -> np.ndarray:
        beta = np.full((size + 1, len(logs[0])), -np.inf)
        beta[size] = 0
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, len(logs)) + 1):
                beta[i] = np.logaddexp(beta[i], logs[length - 1][:, i] + beta[i + length])
        return beta

    def hits(self, columns: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place, id, probability) of the pieces of every length; a place is start * words + word.

        ``columns`` are (characters, words) code points. Most substrings are told to be no piece
        by the leading bits of their hash.
        """
        vocabulary, (size, n) = self.vocabulary, columns.shape
        prefix = np.zeros((size + 1, n), np.uint64)
        for j in range(size):
            prefix[j + 1] = prefix[j] * np.uint64(BASE) + columns[j] + np.uint64(1)
        out = []
        for length in range(1, min(vocabulary.longest, size) + 1):
            h = vocabulary.spans(prefix.T, length, prefix.T).T.ravel()
            first = self.slots[h >> np.uint64(64 - SLOT_BITS)]
            place = np.flatnonzero(first >= 0)
            own, first = h[place], first[place]
            at = np.full(len(place), -1)
            for k in range(self.crowd):
                key = np.minimum(first + k, len(vocabulary.keys) - 1)
                at = np.where(vocabulary.keys[key] == own, key, at)
            place, ids = place[at >= 0], vocabulary.ids[at[at >= 0]]
            out.append((place, ids, self.odds[ids]))
        return out

    def linear(self, columns: np.ndarray) -> tuple[list, np.ndarray, list[np.ndarray]]:
        """(hits, places of characters without a piece, probabilities by length, start and word)."""
        size, n = columns.shape
        hits = self.hits(columns)
        grids = []
        for length, (place, _, odds) in enumerate(hits, 1):
            grid = np.zeros((size - length + 1) * n)
            grid[place] = odds
            grids.append(grid)
        bare = np.ones(size * n, bool)
        bare[hits[0][0]] = False
        bare = np.flatnonzero(bare)
        flat = columns.ravel()
        for code in np.unique(flat[bare]):
            own = self.vocabulary.byte_id[list(chr(code).encode())]
            grids[0][bare[flat[bare] == code]] = np.exp(self.weights.pieces[own].sum())
        return hits, bare, [g.reshape(-1, n) for g in grids]

    @staticmethod
    def onward(grids: list[np.ndarray], size: int) -> np.ndarray:
        """``forward`` with probabilities instead of their logs, (characters, words)."""
        alpha = np.zeros((size + 1, grids[0].shape[1]))
        alpha[0] = 1
        for j in range(1, size + 1):
            for length in range(1, min(j, len(grids)) + 1):
                alpha[j] += alpha[j - length] * grids[length - 1][j - length]
        return alpha

    @staticmethod
    def homeward(grids: list[np.ndarray], size: int) -> np.ndarray:
        beta = np.zeros((size + 1, grids[0].shape[1]))
        beta[size] = 1
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, len(grids)) + 1):
                beta[i] += grids[length - 1][i] * beta[i + length]
        return beta

    def score(self, words: list[str]) -> np.ndarray:
        """Natural log of each word's marginal probability."""
        out = np.zeros(len(words))
        for rows, codes in batches_of([MARK + w for w in words], CELLS):
            rows, size = np.array(rows), codes.shape[1]
            if size <= LONGEST:
                columns = np.ascontiguousarray(codes.T)
                odds = self.onward(self.linear(columns)[2], size)[-1]
                safe = odds > LEAST
                out[rows[safe]] = np.log(odds[safe])
                rows, codes = rows[~safe], codes[~safe]
            if len(rows):
                out[rows] = self.forward(self.edges(codes)[1], size)[-1]
        return out

    def expect(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece over all segmentations of all words."""
        total = np.zeros(self.vocabulary.size)
        for rows, codes in batches_of([MARK + w for w in words], CELLS):
            rows, size = np.array(rows), codes.shape[1]
            if size <= LONGEST:
                columns = np.ascontiguousarray(codes.T)
                hits, bare, grids = self.linear(columns)
                alpha, beta = self.onward(grids, size), self.homeward(grids, size)
                safe = alpha[-1] > LEAST
                scale = np.where(safe, counts[rows] / np.where(safe, alpha[-1], 1), 0)
                before, after, n = alpha.ravel(), beta.ravel(), len(rows)
                shares = [before[p] * odds * after[p + k * n] * scale[p % n] for k, (p, _, odds) in enumerate(hits, 1)]
                total += np.bincount(np.concatenate([i for _, i, _ in hits]), np.concatenate(shares), len(total))
                flat = columns.ravel()[bare]
                mass = before[bare] * grids[0].ravel()[bare] * after[bare + n] * scale[bare % n]
                for code in np.unique(flat):
                    np.add.at(total, self.vocabulary.byte_id[list(chr(code).encode())], mass[flat == code].sum())
                rows, codes = rows[~safe], codes[~safe]
            if len(rows):
                self.expect_long(codes, counts[rows], total)
        return total

    def expect_long(self, codes: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
        """Add the expected uses in words of one length, worked out in log space."""
        ids, logs = self.edges(codes)
        size = codes.shape[1]
        alpha, beta = self.forward(logs, size), self.backward(logs, size)
        scale = np.log(counts) - alpha[-1]
        for k, (found, log) in enumerate(zip(ids, logs), 1):
            share = np.exp(alpha[: size - k + 1].T + log + beta[k:].T + scale[:, None])
            hit = found >= 0
            total += np.bincount(found[hit], share[hit], len(total))
            if k == 1 and not hit.all():
                for code in np.unique(codes[~hit]):
                    mass = share[(codes == code) & ~hit].sum()
                    np.add.at(total, self.vocabulary.byte_id[list(chr(code).encode())], mass)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in larger tables: words of one length are worked out together."""
    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= AT_ONCE or size >= AT_ONCE_BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, n, c): occurrences in all rows and in training rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, train = Counter(), Counter()

        def tables() -> Iterator[pa.RecordBatch]:
            for counter, learned in ((held, 0), (train, 1)):
                n = np.fromiter(counter.values(), np.int64, len(counter))
                words = pa.array(counter, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words, pa.array(n), pa.array(n * learned)], ["word", "n", "c"])

        for batch in batches:
            for text, learned in zip(batch["text"].to_pylist(), batch["learn"].to_pylist()):
                (train if learned else held).update(text.lower().split())
            if len(held) + len(train) > HELD_WORDS:
                yield from tables()
                held, train = Counter(), Counter()
        yield from tables()

    rows = store.documents(docs).select(
        F.col("text").cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )
    return (
        rows.mapInArrow(count, "word string, n long, c long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    )


def fit(words: DataFrame, ends: int, model: str, rounds: int = 2) -> Weights:
    """Piece weights re-estimated on the training counts of a word table."""
    weights = first_weights(Vocabulary(model))
    context = words.sparkSession.sparkContext
    for _ in range(rounds):
        # Broadcasts hold plain values: workers need not have this package.
        shared = context.broadcast(tuple(weights))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(Vocabulary(model), Weights(*shared.value))
            total = np.zeros(lattice.vocabulary.size)
            for table in gathered(batches):
                total += lattice.expect(table["word"].to_pylist(), table["c"].to_numpy().astype(float))
            used = np.flatnonzero(total)
            micro = np.rint(total[used] * MICRO).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(micro)], ["piece", "micro"])

        rows = (
            words.filter("c > 0")
            .select("word", "c")
            .mapInArrow(expect, "piece long, micro long")
            .groupBy("piece")
            .agg(F.sum("micro").alias("micro"))
            .collect()  # one row per piece of the vocabulary
        )
        if not rows:
            break
        expected = np.zeros(len(weights.pieces))
        expected[[r["piece"] for r in rows]] = [r["micro"] / MICRO for r in rows]
        weights = reweigh(expected, ends)
    return weights


def score_words(words: DataFrame, weights: Weights, model: str) -> DataFrame:
    """The word table with ``score``: log10 of the word's marginal probability."""
    shared = words.sparkSession.sparkContext.broadcast(tuple(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(Vocabulary(model), Weights(*shared.value))
        for table in gathered(batches):
            scores = lattice.score(table["word"].to_pylist()) / LOG10
            yield from table.append_column("score", pa.array(scores)).combine_chunks().to_batches()

    return words.select("word", "n", "c").mapInArrow(run, "word string, n long, c long, score double")


def score(docs: DataFrame, learn: Column, model: str, rounds: int = 2) -> DataFrame:
    """Lattice and word-unigram log10 scores of every document.

    ``learn`` is a condition over doc_id: its rows train both models.
    """
    spark = docs.sparkSession
    counted = store.keep(word_counts(docs, learn), "words")
    ends = docs.filter(learn).count()
    total, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    tokens, kinds = total + ends, distinct + (ends > 0)
    weights = fit(counted, ends, model, rounds)
    words = store.keep(score_words(counted, weights, model), "word-scores")
    store.forget(counted)
    floor = tokens + kinds + 1

    def base(c: Column) -> Column:
        return F.log10((c + 1) / F.lit(float(floor)))

    top = words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    frequent = spark.sparkContext.broadcast(
        (
            {r["word"].encode(): i for i, r in enumerate(top)},
            np.array([r["c"] > 0 for r in top], bool),
            np.array([math.log10((r["c"] + 1) / floor) for r in top]),
            np.array([r["score"] for r in top]),
        )
    )
    end = (int(ends > 0), math.log10((ends + 1) / floor), weights.end / LOG10)
    schema = "uid long, doc_id long, learn boolean, word string, n_tokens long, n_known long, base double, score double"

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, bases, scores = frequent.value
        uid = TaskContext.get().partitionId() << 36
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = batch.num_rows
            cut = [text.lower().split() for text in batch["text"].to_pylist()]
            sizes = np.array([len(c) for c in cut], np.int64)
            owner = np.repeat(np.arange(rows), sizes)
            parts = list(chain.from_iterable(cut))
            at = np.fromiter(map(index.get, parts, repeat(-1)), np.int64, len(parts))
            hit = at >= 0
            on, own = owner[hit], at[hit]
            sums = [np.bincount(on, x[own], rows) + e for x, e in zip((known, bases, scores), end)]
            uids = uid + np.arange(rows)
            columns = [pa.array(uids), batch["doc_id"], batch["learn"], pa.nulls(rows, pa.string()), pa.array(sizes + 1)]
            columns += [pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
            yield pa.RecordBatch.from_arrays(columns, names)
            left = np.flatnonzero(~hit)
            starts = np.searchsorted(owner[left], np.arange(rows + 1)).tolist()
            rare = [parts[i] for i in left.tolist()]
            found = [Counter(rare[a:b]) for a, b in zip(starts, starts[1:])]
            n = np.array([len(f) for f in found], np.int64)
            m = int(n.sum())
            words = pa.array(list(chain.from_iterable(found)), pa.binary()).cast(pa.string())
            tf = np.fromiter(chain.from_iterable(f.values() for f in found), np.int64, m)
            columns = [pa.array(np.repeat(uids, n)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), words, pa.array(tf)]
            columns += [pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m)), pa.array(np.zeros(m))]
            yield pa.RecordBatch.from_arrays(columns, names)
            uid += rows

    texts = store.documents(docs).select(
        "doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")
    )
    found = store.keep(texts.mapInArrow(look_up, schema), "scored")
    main = found.filter("word IS NULL").drop("word")
    tf = F.col("n_tokens")
    rare = (
        found.filter("word IS NOT NULL")
        .select("uid", "word", "n_tokens")
        .join(words.select("word", "c", F.col("score").alias("own")), "word")
        .groupBy("uid")
        .agg(
            F.sum(tf * (F.col("c") > 0).cast("long")).alias("rare_known"),
            F.sum(tf * base(F.col("c"))).alias("rare_base"),
            F.sum(tf * F.col("own")).alias("rare_score"),
        )
    )

    def plus(a: str, b: str) -> Column:
        return (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)

    return main.join(rare, "uid", "left").select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", plus("n_known", "rare_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        plus("base", "rare_base").alias("base_score"), plus("score", "rare_score"),
    )
