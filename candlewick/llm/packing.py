"""Best-fit decreasing packing of token sequences.

Only the multiset of piece lengths decides how many sequences are needed, and lengths are
at most the sequence length. So the placement runs on one counter per length (2048 rows,
whatever the corpus): lengths in falling order, a segment tree over the remaining
capacities finds the tightest open sequence in logarithmic time, and equal pieces that
meet equal sequences are placed in one step. The result is a table of
(length, first rank, first sequence, offset) intervals; every piece finds its interval by
its rank among the pieces of its length. Ranks come from counts per written part, so no
length, however common, is sorted in one task.

NULL text is empty and gives the single closing id. Repeated rows are packed one by one,
which keeps duplicates of a doc_id apart through their rank. An empty table gives no rows.
Pieces of one length are placed in the order of their ranks. A very long text is encoded whole
before it is cut. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candlewick.llm import store

LENGTH = 2048
CACHE_WORDS = 800_000
MARKS = b".,;:!?"


class Tightest:
    """Segment tree over capacities 0..n; a leaf is 1 while a sequence has that much room."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.open = [0] * (2 * self.width)

    def set(self, capacity: int, value: int) -> None:
        node = self.width + capacity
        self.open[node] = value
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def at_least(self, capacity: int) -> int | None:
        """The smallest capacity in use that is not below ``capacity``."""
        node = self.width + capacity
        if self.open[node]:
            return capacity
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.width
            node //= 2
        return None


def best_fit(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset) intervals of a best-fit packing.

    Sequences with equal room are held as runs of consecutive numbers. Placing pieces of
    one length into a run takes its front part; each of them gets the piece at the same offset.
    """
    tree = Tightest(length)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    plan, opened = [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.at_least(size)
            if room is None:
                # Equal pieces fill fresh sequences one after another, as best fit does.
                per = length // size
                fresh = -(-left // per)
                full = fresh - 1 if left % per else fresh
                for n, first, slots in ((full, opened, per), (fresh - full, opened + full, left % per)):
                    for j in range(slots if n else 0):
                        plan.append((size, rank, n, first, j * size))
                        rank += n
                    if n:
                        rest = length - slots * size
                        runs[rest].append((first, n))
                        tree.set(rest, 1)
                opened += fresh
                break
            first, n = runs[room].pop()
            if not runs[room]:
                tree.set(room, 0)
            # Fill whole sequences first: `per` pieces in each of `full` of them.
            per = room // size
            full = min(n, left // per)
            for j in range(per if full else 0):
                plan.append((size, rank, full, first, length - room + j * size))
                rank += full
            left -= full * per
            if full:
                runs[room - per * size].append((first, full))
                tree.set(room - per * size, 1)
            if full < n:
                some = min(left, per) if left else 0
                for j in range(some):
                    plan.append((size, rank, 1, first + full, length - room + j * size))
                    rank += 1
                left -= some
                if some:
                    runs[room - some * size].append((first + full, 1))
                    tree.set(room - some * size, 1)
                rest = n - full - (1 if some else 0)
                if rest:
                    runs[room].append((first + n - rest, rest))
                    tree.set(room, 1)
    return plan


def encoder(path: str):
    """Bytes of a text to the bytes of its 32-bit ids, one word at a time.

    The tokenizer lowers case, drops white space and never joins across it, so a text's ids
    are its words' ids in a row; words are encoded once per worker and remembered. New words
    made of letters are encoded as one text, whose ids part where a piece ends a word.
    Texts that may hold a special token's string are encoded as a whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    store_ = sys.modules.setdefault("_candlewick_words", types.ModuleType("_candlewick_words"))
    if path not in store_.__dict__:
        tokenizer = Tokenizer.from_file(path)
        ends = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, i in tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        store_.__dict__[path] = tokenizer, ends, {}
    tokenizer, ends, known = store_.__dict__[path]

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def learn(words: list[bytes]) -> None:
        """Ids of new words; ids of a letter run and of the marks behind it are independent."""
        stems = {}
        for word in words:
            stem = word.rstrip(MARKS)
            stems[word] = stem if stem and stem.decode()[-1].isalpha() else word
        new = [w for w in dict.fromkeys(stems.values()) if w not in known]
        tails = {w[len(s) :] for w, s in stems.items()} - {b""}
        new += [t for t in tails if t not in known]
        plain = [w for w in new if w.decode().isalpha()]
        if plain:
            ids = np.array(tokenizer.encode(b" ".join(plain).decode(), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(plain):
                data, edges = ids.tobytes(), [0, *(4 * cuts).tolist()]
                known.update(zip(plain, map(data.__getitem__, map(slice, edges, edges[1:]))))
        rest = [w for w in new if w not in known]
        for word, part in zip(rest, tokenizer.encode_batch([w.decode() for w in rest], add_special_tokens=False)):
            known[word] = packed(part.ids)
        for word, stem in stems.items():
            if word not in known:
                known[word] = known[stem] + known[word[len(stem) :]]

    def encode(text: bytes) -> bytes:
        if b"<|" in text:
            return packed(tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        words = text.lower().split()
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHE_WORDS:
                known.clear()
                learn(list(dict.fromkeys(words)))
            else:
                learn(list({w for w, ids in zip(words, found) if ids is None}))
            found = map(known.__getitem__, words)
        return b"".join(found)

    return encode


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, rank): ``rank`` counts within (part, length)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text) + close
                for piece, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    n = len(part) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(part), seen[n]))
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=names
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, rank long"
    texts = store.documents(docs).withColumn("text", F.col("text").cast("binary"))
    return texts.mapInArrow(cut, schema).withColumn("part", F.spark_partition_id())


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    spark = docs.sparkSession
    cuts = store.keep(pieces(docs, tokenizer, length, end_id), "pieces")
    tally = cuts.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tally.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # At most `length` rows reach the driver.
    totals = tally.groupBy("length").agg(F.sum("n").alias("n")).collect()
    plan = sorted(best_fit({r["length"]: r["n"] for r in totals}, length))
    table = np.array(plan, np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            size, rank = (batch[c].to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (size << 44) + rank, "right") - 1
            out = {c: batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out["sequence_id"] = pa.array(rows[at, 3] + rank - rows[at, 1])
            out["offset"] = pa.array(rows[at, 4])
            yield pa.RecordBatch.from_pydict(out)

    schema = (
        "doc_id long, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    return (
        cuts.join(base, ["part", "length"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
        .mapInArrow(place, schema)
    )
