"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. The binary Golay code is
perfect: every 23-bit word is within 3 bits of exactly one codeword. Two fingerprints that
differ in at most 3 bits differ in at most one bit in each of some two segments. So every
fingerprint is stored under its decoded codeword indices for each pair of segments, and
looked up under all codewords within 4 bits of its segments: one if the segment is near its
codeword, six if it is 3 bits away. Whoever is one bit away decodes to one of those.

Equal fingerprints are one node. Keys are exchanged as packed runs per bucket; a bucket
verifies its candidates in numpy blocks and returns links to group heads only, at most one
per node, so a group of copies never becomes pairs. Components are found by alternating
star contraction over written tables.

NULL text is empty; texts without words share fingerprint zero and link like any other.
NULL doc_ids get the component of their text's group, NULL if the group has no id at all.
An empty table gives an empty result; extra columns are ignored, and kept by `keep_one`,
whatever their names. A very long text is hashed whole, in its own batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store
from candlewick.llm.components import components

SEED = 42
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # the Golay code's generator polynomial
BLOCK = 1 << 21


def bit_majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a UTF-8 text; A-Z count as lower case."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles, n = [b" ".join(words)], 1
    else:
        n = len(words) - width + 1
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    return bit_majority(
        np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    )


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    return signed(docs, width).select("doc_id", "fp")


def signed(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, sig, fp): with a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(t, width) for t in batch["text"].to_pylist()]
            values = np.array(marks, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["sig"], pa.array(values)], ["doc_id", "sig", "fp"]
            )

    texts = store.documents(docs).select(
        "doc_id", F.xxhash64("text").alias("sig"), F.col("text").cast("binary").alias("text")
    )
    return texts.mapInArrow(run, "doc_id long, sig long, fp long")


class Golay:
    """Decoding tables of the (23, 12) code, built from its generator."""

    def __init__(self) -> None:
        weight1 = np.array([self._rest(1 << i) for i in range(23)])
        self.low = np.array([self._fold(weight1, v, 0) for v in range(1 << 12)], np.int32)
        self.high = np.array([self._fold(weight1, v, 12) for v in range(1 << 11)], np.int32)
        leader = np.zeros(2048, np.int64)
        four: dict[int, list[int]] = {}
        for w in range(1, 5):
            for places in combinations(range(23), w):
                pattern = sum(1 << p for p in places)
                rest = 0
                for p in places:
                    rest ^= int(weight1[p])
                if w < 4:
                    leader[rest] = pattern
                else:
                    four.setdefault(rest, []).append(pattern)
        self.leader = leader
        self.far = np.bitwise_count(leader.astype(np.uint64)) == 3
        self.four = np.zeros((2048, 5), np.int64)
        for rest in np.flatnonzero(self.far):
            self.four[rest] = four[int(rest)]

    @staticmethod
    def _rest(value: int) -> int:
        for i in range(22, 10, -1):
            if value >> i & 1:
                value ^= GENERATOR << (i - 11)
        return value

    @staticmethod
    def _fold(rests: np.ndarray, value: int, shift: int) -> int:
        out = 0
        for i in range(12):
            if value >> i & 1:
                out ^= int(rests[i + shift])
        return out

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> 12]

    def nearest(self, words: np.ndarray) -> np.ndarray:
        """Index of the codeword within 3 bits."""
        return (words ^ self.leader[self.syndrome(words)]) >> 11

    def around(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(six index columns, their validity): all codewords that a word one bit away may decode to."""
        rest = self.syndrome(words)
        patterns = np.concatenate([self.leader[rest][:, None], self.four[rest]], axis=1)
        valid = np.repeat(self.far[rest][:, None], 6, axis=1)
        valid[:, 0] = True
        return (words[:, None] ^ patterns) >> 11, valid


def keys_of(code: Golay, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, row, stored?) of every fingerprint, pair of segments by pair of segments."""
    words = fps.view(np.uint64)
    parts = [((words >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [code.nearest(p) for p in parts]
    wide = [code.around(p) for p in parts]
    rows = np.arange(len(fps))
    for k, (a, b) in enumerate(PAIRS):
        yield (k << 24) + (near[a] << 12) + near[b], rows, True
        for i in range(6):
            for j in range(6):
                on = wide[a][1][:, i] & wide[b][1][:, j]
                yield (k << 24) + (wide[a][0][on, i] << 12) + wide[b][0][on, j], rows[on], False


def heads(n: int, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Lower ``label`` until both ends of every link agree; labels only fall."""
    while len(left):
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
        differ = label[left] != label[right]
        left, right = left[differ], right[differ]
    return label


def links_in(key_s, row_s, key_p, row_p, words, bits: int) -> np.ndarray:
    """Group heads within a bucket: a label per row, from verified candidates only."""
    label = np.arange(len(words))
    order = np.argsort(key_s, kind="stable")
    key_s, row_s = key_s[order], row_s[order]
    first = np.searchsorted(key_s, key_p, "left")
    count = np.searchsorted(key_s, key_p, "right") - first
    ends = np.cumsum(count)
    at = 0
    while at < len(key_p):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, "right")))
        n = count[at:stop]
        probe = np.repeat(row_p[at:stop], n)
        spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:stop], n)
        other = row_s[spot]
        close = (probe < other) & (np.bitwise_count(words[probe] ^ words[other]) <= bits)
        label = heads(len(words), probe[close], other[close], label)
        at = stop
    return label


def near_links(nodes: DataFrame, bits: int = 3, buckets: int | None = None) -> DataFrame:
    """(a, b) links between ids of ``nodes`` (id, fp; fp unique) that join all within ``bits``.

    ``bits`` is at most 3, the reach of the code. Every pair within reach is connected by
    links, though not each has its own.
    """
    if bits > 3:
        raise ValueError("the code finds at most 3 differing bits")
    if buckets is None:
        # About 90 keys of 25 bytes each; a bucket should stay near 32 MB.
        buckets = max(16, nodes.count() * 90 * 25 // (32 << 20))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            ids, fps = batch["id"].to_numpy(), batch["fp"].to_numpy()
            keys, rows, kinds = [], [], []
            for key, row, stored in keys_of(code, fps):
                keys.append(key.astype(np.uint32))
                rows.append(row)
                kinds.append(np.full(len(key), stored))
            key, row, kind = np.concatenate(keys), np.concatenate(rows), np.concatenate(kinds)
            spread = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            bucket = (spread % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, ~kind, bucket))
            key, row, kind, bucket = key[order], row[order], kind[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            out = {"bucket": [], "stored": [], "key": [], "id": [], "fp": []}
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
                out["bucket"].append(int(bucket[lo]))
                out["stored"].append(int(kind[lo:hi].sum()))
                out["key"].append(key[lo:hi].tobytes())
                used, spot = np.unique(row[lo:hi], return_inverse=True)
                out["id"].append(ids[used].tobytes() + fps[used].tobytes())
                out["fp"].append(spot.astype(np.uint16).tobytes())
            kinds_ = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out.values(), kinds_)], list(out)
            )

    def verify(table: pa.Table) -> pa.Table:
        ks, rs, kp, rp, ids, fps, base = [], [], [], [], [], [], 0
        for stored, key, node, spot in zip(
            *(table[c].to_pylist() for c in ("stored", "key", "id", "fp"))
        ):
            key, row = np.frombuffer(key, np.uint32), np.frombuffer(spot, np.uint16).astype(np.int64)
            own = np.frombuffer(node, np.int64).reshape(2, -1)
            ks.append(key[:stored])
            rs.append(row[:stored] + base)
            kp.append(key[stored:])
            rp.append(row[stored:] + base)
            ids.append(own[0])
            fps.append(own[1])
            base += own.shape[1]
        every = np.concatenate(ids)
        name, first, row_of = np.unique(every, return_index=True, return_inverse=True)
        words = np.concatenate(fps)[first].view(np.uint64)
        label = links_in(
            np.concatenate(ks), row_of[np.concatenate(rs)],
            np.concatenate(kp), row_of[np.concatenate(rp)], words, bits,
        )
        linked = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": name[label[linked]], "b": name[linked]})

    runs = nodes.select("id", "fp").mapInArrow(
        emit, "bucket int, stored int, key binary, id binary, fp binary"
    )
    return runs.groupBy("bucket").applyInArrow(verify, "a long, b long").distinct()


def grouped(marks: DataFrame, bits: int) -> DataFrame:
    """``marks`` (doc_id, fp) with `group`, a fingerprint, and `component_id`, its smallest doc_id."""
    # Fingerprints name the nodes: rows of one doc_id may have several.
    nodes = store.keep(marks.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    alike = nodes.filter("id IS NOT NULL").select(F.col("fp").alias("id"), "fp")
    links = store.keep(near_links(alike, bits), "simhash-links")
    named = components(links).select(F.col("id").alias("fp"), F.col("component").alias("group"))
    linked = store.keep(nodes.join(named, "fp"), "simhash-groups")
    least = linked.groupBy("group").agg(F.min("id").alias("least"))
    head = (
        nodes.join(linked.join(least, "group").select("fp", "group", "least"), "fp", "left")
        .select("fp", F.coalesce("group", "fp").alias("group"), F.coalesce("least", "id").alias("component_id"))
    )
    return marks.join(head, "fp")


def near_duplicates(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links."""
    marks = store.keep(fingerprints(docs, width), "simhash")
    return grouped(marks, bits).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 3, width: int = 3) -> DataFrame:
    """One document per group: that with the smallest doc_id; of its rows in the group one stays.

    Documents without an id have no group of their own and stay.
    """
    marks = store.keep(signed(docs.select("doc_id", "text"), width), "simhash")
    found = grouped(marks, bits).filter("doc_id = component_id")
    head, own, sig = store.unused(docs.columns, "head", "own", "sig")
    heads_ = found.groupBy(F.col("doc_id").alias(head), "group").agg(F.min("sig").alias(own)).drop("group")
    named = docs.filter("doc_id IS NOT NULL").withColumn(sig, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (F.col("doc_id") == F.col(head)) & (F.col(sig) == F.col(own))
    kept = named.join(heads_, same).dropDuplicates(["doc_id", sig]).drop(head, own, sig)
    return kept.unionByName(docs.filter("doc_id IS NULL"))
