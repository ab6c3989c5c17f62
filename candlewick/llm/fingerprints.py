"""One-permutation MinHash with optimal densification and packed low-order bits.

Every shingle is hashed once: part of the hash picks a bin, the rest competes for the bin's
minimum. An empty bin copies from a bin chosen by a hash of its own number and the attempt,
so each non-empty bin is equally likely and equal sets copy equally. Of each bin only the
low bits are stored; two unrelated bins agree by chance once in 2**bits, which the estimate
subtracts.

Shingles are five words, A-Z lowered; a shorter text is one shingle, and a text without
words has an empty fingerprint, which is like another empty one (1.0) and unlike any other.
The next document is that with the next row in (doc_id, text) order, NULL ids first, so
repeated ids follow each other; extra columns are ignored, whatever their names; an empty
table gives no rows. NULL text is empty. A very long text is hashed whole, in its own batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

CACHE_WORDS = 500_000
STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of words, remembered between texts up to a fixed number."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size, self.known = size, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        found = list(map(self.known.get, words))
        if None in found:
            if len(self.known) > self.size:
                self.known.clear()
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.known[words[i]] = xxhash.xxh64_intdigest(words[i])
        return np.array(found, np.uint64)


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hash of every window of ``width`` word hashes; of all words if there are fewer."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total = mix(total + words[i : n - width + 1 + i] + np.uint64(STEP))
    return total


def sketch(hashes: np.ndarray, bins: int, bits: int) -> bytes:
    """``bins`` minima cut to ``bits`` (1, 2, 4 or 8) low bits, packed; empty without hashes."""
    if not len(hashes):
        return b""
    low = np.full(bins, np.iinfo(np.uint64).max)
    where = (hashes >> np.uint64(40)) % np.uint64(bins)
    np.minimum.at(low, where.astype(np.int64), mix(hashes))
    full = np.zeros(bins, bool)
    full[where.astype(np.int64)] = True
    empty, attempt = np.flatnonzero(~full), 1
    out = low.copy()
    while len(empty):
        # The choice depends on the bin and the attempt alone, not on the text.
        start = empty.astype(np.uint64) + np.uint64(attempt * STEP & (1 << 64) - 1)
        donor = (mix(start) % np.uint64(bins)).astype(np.int64)
        hit = full[donor]
        out[empty[hit]] = low[donor[hit]]
        empty, attempt = empty[~hit], attempt + 1
    values = (out & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = (values[:, None] >> np.arange(bits, dtype=np.uint8)) & 1
    return np.packbits(planes).tobytes()


def likeness(a: bytes, b: bytes, bins: int, bits: int) -> float:
    """Bias-corrected share of agreeing bins, 0 to 1."""
    if not a or not b:
        return 1.0 if a == b else 0.0
    x, y = (np.unpackbits(np.frombuffer(v, np.uint8)).reshape(bins, bits) for v in (a, b))
    same = float((x == y).all(1).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (same - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The last half of ``text`` replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


class Fingerprinter:
    def __init__(self, bins: int, bits: int, width: int):
        self.bins, self.bits, self.width, self.hashes = bins, bits, width, WordHashes()

    def __call__(self, text: str) -> bytes:
        words = self.hashes(text.encode().lower().split())
        return sketch(shingle_hashes(words, self.width), self.bins, self.bits)

    def row(self, doc_id, text: str, mark: bytes, following: str, next_mark: bytes) -> tuple:
        changed = edited(text, following)
        changed_mark = self(changed)
        near = (likeness(mark, m, self.bins, self.bits) for m in (changed_mark, next_mark))
        digest = hashlib.sha256(changed.encode()).hexdigest()
        return (doc_id, len(text), digest, mark.hex(), changed_mark.hex(), *near)


def fingerprint(docs: DataFrame, bins: int = 256, bits: int = 8, width: int = 5) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses.

    The texts are range-partitioned by id and sorted inside the partitions, so a document's
    successor is the next row of its own partition; only the last row of each partition
    meets the first row of the next one in a second, small step.
    """
    rows = "part int, edge int, raw string, " + SCHEMA

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, held = Fingerprinter(bins, bits, width), None
        fields = pa.schema(
            [("part", pa.int32()), ("edge", pa.int32()), ("raw", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64())]
            + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
            + [("near_edited", pa.float64()), ("near_next", pa.float64())]
        )

        def table(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(fields)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields
            )

        part = None
        for batch in batches:
            out = []
            for part, doc_id, text in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "text"))):
                mark = make(text)
                if held is None:
                    out.append((part, 0, text, doc_id, None, None, mark.hex(), None, None, None))
                else:
                    out.append((part, None, None, *make.row(*held, text, mark)))
                held = doc_id, text, mark
            yield table(out)
        if held is not None:
            doc_id, text, mark = held
            yield table([(part, 1, text, doc_id, None, None, mark.hex(), None, None, None)])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(bins, bits, width)
        for batch in batches:
            out = [
                make.row(d, t, bytes.fromhex(m), follow, bytes.fromhex(fm))
                for d, t, m, follow, fm in zip(*(batch[c].to_pylist() for c in batch.schema.names))
            ]
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64()] + [pa.string()] * 3 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    texts = store.documents(docs)
    spread = texts.repartitionByRange(F.asc("doc_id"), F.xxhash64("text"))
    ordered = spread.sortWithinPartitions(F.asc("doc_id"), F.xxhash64("text"), "text")
    found = store.keep(
        ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(scan, rows),
        "fingerprints",
    )
    done = found.filter("edge IS NULL").drop("part", "edge", "raw")
    edges = found.filter("edge IS NOT NULL")
    # Two short rows for each partition: its successor is the next partition with rows.
    parts = [r[0] for r in edges.filter("edge = 0").select("part").orderBy("part").collect()]
    after = dict(zip(parts, parts[1:] + parts[:1]))
    links = docs.sparkSession.createDataFrame(list(after.items()), "part int, next int")
    tails = edges.filter("edge = 1").select("part", "doc_id", F.col("raw").alias("text"), F.col("fingerprint").alias("mark"))
    starts = edges.filter("edge = 0").select(F.col("part").alias("next"), F.col("raw").alias("follow"), F.col("fingerprint").alias("follow_mark"))
    ends = tails.join(links, "part").join(starts, "next")
    closed = ends.select("doc_id", "text", "mark", "follow", "follow_mark").mapInArrow(close, SCHEMA)
    return done.unionByName(closed)
