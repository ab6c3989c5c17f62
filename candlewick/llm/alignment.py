"""Cross-tokenizer alignment as an Arrow pipeline.

Two tokenizers cut the same bytes differently. Where tokens of both end at one byte offset, a
group closes; two tokens are linked if their byte ranges overlap.

A batch of texts is one Arrow pipeline. Token lists are flattened, parent indices name each
token's document, and segmented cumulative sums of the token lengths give the offset of its
end. An Acero full outer join of both sides on the (document, end) key yields one row per
elementary range between neighbouring ends: exactly one row per link. A key found on both
sides closes a group. Filled backwards, the missing side of a row is the token that covers its
range. ``Table.group_by`` counts the id pairs of a batch; Spark adds the partial counts up.

A second pass needs each link's corpus-wide count. The counts of the most frequent pairs, at
most ``COMMON``, are shared with the tasks; links of all rarer pairs travel to a join on the
pair. Both add to the same sums, so no pair is left out however many there are.

Tokenizing is local to units (a single space with the word behind it): the one tokenizer never
joins over such a space, the other has no piece with a space inside, which is checked. Each
distinct unit of a batch is encoded once, and short ones are remembered by the worker.

NULL and empty texts, and texts whose tokens of either side do not spell the text, have no
tokens and zeros. Repeated rows are counted each. A very long text passes through the pipeline
in slices that end between units, so a task holds a slice, not all tokens of the text, besides
its link list. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import sys
import types
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

COMMON = 1 << 20  # pairs shared with every task, 16 bytes each
SLICE = 1 << 17  # bytes of text whose tokens are aligned at once
CHUNK = 1 << 19  # bytes of texts, one at least, that leave a task together
JOINED_BYTES = 1 << 14  # new units encoded as one text
CACHE_UNITS = 100_000
CACHE_BYTES = 48  # longer units are rare and not remembered
SPACE = 32
MARK = "▁"


class ByteTokenizer:
    """Byte-level pairs: the printable stand-in of each byte is undone for token lengths."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        stand_in = byte_stand_ins()
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = b"".join(stand_in.get(c, c.encode()) for c in token)
        self.lengths = np.array([len(b) for b in self.bytes])

    def encode(self, units: list[str]) -> list[list[int]]:
        # Without offsets, which nothing here reads.
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class PieceTokenizer:
    """Pieces with a space mark and byte fallback; the tokenizer itself adds a unit's first space."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in name.lstrip(MARK) for name in names):
            raise ValueError("a piece reaches over a space, so units are not independent")
        self.bytes = [
            bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(MARK, " ").encode()
            for i, n in enumerate(names)
        ]
        self.lengths = np.array([len(b) for b in self.bytes])

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode([u[1:] for u in units], num_threads=1)


def byte_stand_ins() -> dict[str, bytes]:
    """Printable bytes stand for themselves, the others for the characters from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in printable]
    return {chr(b): bytes([b]) for b in printable} | {chr(256 + k): bytes([b]) for k, b in enumerate(other)}


@dataclass(frozen=True)
class Side:
    """What the pipeline looks up by token id."""

    lengths: pa.Array
    # Decimal ids with a comma for the next token of the group, then all again with the mark
    # that ends the side's part of a group.
    words: pa.Array


def side_of(tokens: list[bytes], end: str) -> Side:
    words = [f"{i}{mark}".encode() for mark in (",", end) for i in range(len(tokens))]
    return Side(pa.array([len(t) for t in tokens], pa.int64()), pa.array(words, pa.large_binary()))


class Aligner:
    """Both tokenizers of a worker with the units it has seen."""

    def __init__(self, path_a: str, path_b: str):
        pa.set_cpu_count(1)
        self.a, self.b = ByteTokenizer(path_a), PieceTokenizer(path_b)
        self.side_a, self.side_b = side_of(self.a.bytes, "|"), side_of(self.b.bytes, ";")
        self.known: dict[bytes, tuple[bytes, bytes] | None] = {}

    def learn(self, units: list[bytes]) -> list[tuple[bytes, bytes] | None]:
        """Packed ids of both sides for every unit; None if a side does not spell it."""
        found = list(map(self.known.get, units))
        new = [i for i, f in enumerate(found) if f is None and units[i] not in self.known]
        if not new:
            return found
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        single, joined, size = [], [], 0
        for i in new:
            rest = units[i].decode()[1:]
            # Units whose own characters at both ends are no white space stay apart in a row.
            if not rest or rest[0].isspace() or rest[-1].isspace():
                single.append(i)
                continue
            joined.append(i)
            size += len(units[i])
            if size > JOINED_BYTES:
                single += self.encode_row(units, joined, found)
                joined, size = [], 0
        single += self.encode_row(units, joined, found)
        for i in single:
            self.encode_row(units, [i], found, alone=True)
        for i in new:
            if len(units[i]) <= CACHE_BYTES:
                self.known[units[i]] = found[i]
        return found

    def encode_row(self, units: list[bytes], at: list[int], found: list, alone: bool = False) -> list[int]:
        """Encode units as one text and part its ids; returns the units if they have to go one by one."""
        if not at:
            return []
        text = b"".join([units[i] for i in at])
        ends = np.cumsum([len(units[i]) for i in at])
        parts = []
        for tokenizer in (self.a, self.b):
            ids = tokenizer.encode([text.decode()])[0]
            if b"".join(map(tokenizer.bytes.__getitem__, ids)) != text:
                return [] if alone else at
            ids = np.array(ids, np.int32)
            upto = np.cumsum(tokenizer.lengths[ids])
            cuts = np.searchsorted(upto, ends)
            if (upto[cuts] != ends).any():
                return [] if alone else at
            data, edges = ids.tobytes(), [0, *(4 * (cuts + 1)).tolist()]
            parts.append(list(map(data.__getitem__, map(slice, edges, edges[1:]))))
        for i, *both in zip(at, *parts):
            found[i] = tuple(both)
        return []


def aligner(path_a: str, path_b: str) -> Aligner:
    kept = sys.modules.setdefault("_candlewick_aligner", types.ModuleType("_candlewick_aligner")).__dict__
    if (path_a, path_b) not in kept:
        kept[path_a, path_b] = Aligner(path_a, path_b)
    return kept[path_a, path_b]


def unit_starts(data: np.ndarray) -> np.ndarray:
    """Single spaces between two characters that are no white space, of any alphabet.

    Characters that might be white space beyond ASCII count as such: that only makes a unit longer.
    """
    if len(data) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(data[1:-1] == SPACE) + 1
    after, before = data[at + 1], data[at - 1]
    second = data[np.maximum(at - 2, 0)]
    blank_after = (after <= SPACE) | np.isin(after, [0xC2, 0xE1, 0xE2, 0xE3])
    closing = ((before == 0x85) | (before == 0xA0)) & (second == 0xC2)
    closing |= np.isin(second, [0x80, 0x81, 0x9A]) & (before >= 0x80) & (before < 0xC0)
    return at[~(blank_after | (before <= SPACE) | closing)]


def segmented_ends(lengths: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """Running sum of the lengths that starts again with every parent."""
    total = pc.cumulative_sum(pa.array(lengths)).to_numpy()
    if not len(total):
        return total
    head = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
    before = np.where(head > 0, total[head - 1], 0)
    return total - np.repeat(before, np.diff(np.append(head, len(total))))


@dataclass
class Links:
    """The links of a slice in text order, and what its groups spell."""

    parent: np.ndarray
    pair: np.ndarray
    closes: np.ndarray
    counts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # parents and ids of each side
    spelt: tuple[np.ndarray, memoryview]  # parent of every token in written order, text


def align(lists_a: pa.ListArray, lists_b: pa.ListArray, parent: np.ndarray, side_a: Side, side_b: Side) -> Links:
    """Links of token lists that lie side by side; ``parent`` names each list's document, rising."""
    ids, parents, keys = [], [], []
    for lists, side in ((lists_a, side_a), (lists_b, side_b)):
        flat = pc.list_flatten(lists)
        owner = parent[pc.list_parent_indices(lists).to_numpy()]
        ends = segmented_ends(side.lengths.take(flat).to_numpy(), owner)
        ids.append(flat)
        parents.append(owner)
        keys.append(owner * (1 << 40) + ends)
    left = pa.table({"key": keys[0], "a": ids[0]})
    right = pa.table({"key": keys[1], "b": ids[1]})
    both = left.join(right, "key", join_type="full outer", use_threads=False).sort_by("key").combine_chunks()
    closes = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"])).to_numpy()
    a, b = (pc.fill_null_backward(both[c]).to_numpy().astype(np.int64) for c in "ab")
    key = both["key"].to_numpy()
    shared = key[closes]
    return Links(
        key >> 40, a * len(side_b.lengths) + b, closes, (parents[0], ids[0], parents[1], ids[1]),
        spell(keys, ids, parents, shared, side_a, side_b),
    )


def spell(keys, ids, parents, shared, side_a: Side, side_b: Side) -> tuple[np.ndarray, memoryview]:
    """Decimal ids of all groups in written order: a group's one side, then its other."""
    group = [np.searchsorted(shared, k) for k in keys]  # the group whose end is not before the token's
    size = [np.bincount(g, minlength=len(shared)) for g in group]
    upto_a, upto_b = np.cumsum(size[0]), np.cumsum(size[1])
    place_a = np.arange(len(keys[0])) + (upto_b - size[1])[group[0]]
    place_b = np.arange(len(keys[1])) + upto_a[group[1]]
    words = []
    for side, flat, k, g in ((side_a, ids[0], keys[0], group[0]), (side_b, ids[1], keys[1], group[1])):
        at = flat.to_numpy() + np.where(k == shared[g], len(side.lengths), 0)
        words.append(side.words.take(pa.array(at)))
    order = np.empty(len(place_a) + len(place_b), np.int64)
    order[place_a] = np.arange(len(place_a))
    order[place_b] = np.arange(len(place_b)) + len(place_a)
    text = pa.concat_arrays(words).take(pa.array(order))
    owner = np.concatenate(parents)[order]
    offsets = np.frombuffer(text.buffers()[1], np.int64)
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    bounds = offsets[np.append(head, len(owner))]
    return np.column_stack([owner[head], bounds[:-1], bounds[1:]]), memoryview(text.buffers()[2] or b"")


def list_array(parts: list[bytes], width: int = 4) -> pa.ListArray:
    """Packed ids as a list array."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // width for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def batch_rows(texts: pa.Array, work: Aligner) -> tuple[dict[str, pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Per document its counts, digest and link pairs; and the batch's pair counts."""
    n = len(texts)
    # Every text gets its space in front, so that a unit starts with each document.
    none, space = (pa.scalar(x, pa.large_binary()) for x in (b"", b" "))
    texts = pc.binary_join_element_wise(none, texts.cast(pa.large_binary()), space)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[: n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    edge = np.zeros(len(data) + 1, bool)
    edge[unit_starts(data)] = edge[offsets] = True
    cuts = np.flatnonzero(edge)
    units = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = units.dictionary_encode()
    index = coded.indices.to_numpy()
    found = work.learn(coded.dictionary.to_pylist())
    owner = np.searchsorted(offsets, cuts[:-1], "right") - 1
    wrong = np.array([f is None for f in found], bool)[index]
    void = np.zeros(n, bool)
    void[owner[wrong]] = True
    void |= np.diff(offsets) == 1  # nothing but the space in front
    lists = [list_array([f[side] if f else b"" for f in found]) for side in (0, 1)]
    used = np.flatnonzero(~void[owner])
    totals = np.zeros((4, n), np.int64)
    digests: dict[int, hashlib._Hash] = {}
    pending: dict[int, bytes] = {}
    pairs, pair_of, partial = [], [], []
    sizes = np.diff(cuts)[used]
    slices = np.cumsum(sizes) // SLICE if len(used) else sizes
    for at in np.split(used, np.flatnonzero(np.diff(slices)) + 1) if len(used) else []:
        chosen = pa.array(index[at])
        got = align(lists[0].take(chosen), lists[1].take(chosen), owner[at], work.side_a, work.side_b)
        totals[0] += np.bincount(got.counts[0], minlength=n)
        totals[1] += np.bincount(got.counts[2], minlength=n)
        totals[2] += np.bincount(got.parent[got.closes], minlength=n)
        totals[3] += np.bincount(got.parent, minlength=n)
        pairs.append(got.pair)
        pair_of.append(got.parent)
        count = pa.table({"pair": got.pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        partial.append((count["pair"].to_numpy(), count["count_all"].to_numpy()))
        spans, text = got.spelt
        for doc, a, z in spans.tolist():
            # The last mark of a document is not written: it waits for what follows.
            digest = digests.setdefault(doc, hashlib.sha256())
            digest.update(pending.get(doc, b""))
            digest.update(text[a : z - 1])
            pending[doc] = b";"
    flat = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(totals[3], out=ends[1:])
    rows = {name: pa.array(totals[i]) for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
    rows["groups_sha256"] = pa.array([digests[i].hexdigest() if i in digests else "" for i in range(n)])
    rows["pairs"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    rows["times"] = pa.array([None] * n, pa.list_(pa.int64()))
    return rows, add_up(partial)


def add_up(partial: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Partial (pairs, counts) as one."""
    if not partial:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = pa.table({"pair": np.concatenate([p for p, _ in partial]), "n": np.concatenate([n for _, n in partial])})
    table = table.group_by("pair", use_threads=False).aggregate([("n", "sum")])
    return table["pair"].to_numpy(), table["n_sum"].to_numpy()


ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row per document, and after each batch one row of its pair counts (``times`` is set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        for batch in batches:
            partial = []
            sizes = pc.binary_length(batch["text"]).to_numpy().astype(np.int64)
            chunk = np.cumsum(sizes) // CHUNK
            heads = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])).tolist() if len(batch) else []
            for a, z in zip(heads, [*heads[1:], len(batch)]):
                rows, counts = batch_rows(batch["text"].slice(a, z - a), work)
                made = pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].slice(a, z - a), **rows})
                partial.append(counts)
                yield made
            if not partial:
                continue
            pair, times = add_up(partial)
            one = {f.name: pa.nulls(1, f.type) for f in made.schema}
            one["pairs"] = pa.array([pair], pa.list_(pa.int64()))
            one["times"] = pa.array([times], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(one, schema=made.schema)

    texts = store.documents(docs).withColumn("text", F.col("text").cast("binary"))
    return texts.mapInArrow(run, ROWS)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, links, best): corpus-wide links of an id pair, and whether no pair of its B id has more."""
    counts = (
        rows.filter("times IS NOT NULL")
        .select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
        .groupBy(F.col("x.pairs").alias("pair"))
        .agg(F.sum("x.times").alias("links"))
    )
    counts = store.keep(counts, "pair-counts")
    b = F.col("pair") % size_b
    most = counts.groupBy(b.alias("b")).agg(F.max("links").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def common_from(counts: DataFrame, limit: int = COMMON) -> int:
    """The smallest power of two such that no more than ``limit`` pairs have that many links."""
    sizes = counts.groupBy(F.floor(F.log2("links")).cast("int").alias("e")).agg(F.count(F.lit(1)).alias("n"))
    total, least = 0, 64
    # At most 64 rows.
    for row in sorted(sizes.collect(), key=lambda r: -r["e"]):
        total += row["n"]
        if total > limit:
            break
        least = row["e"]
    return 1 << least if least < 63 else 1 << 62


def alignments(docs: DataFrame, path_a: str, path_b: str, limit: int = COMMON) -> DataFrame:
    """Every document's tokens, groups and links, and how common its links are in the corpus."""
    size_b = len(PieceTokenizer(path_b).bytes)
    rows = store.keep(aligned(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "alignment")
    counts = store.keep(pair_counts(rows, size_b), "pair-links")
    least = common_from(counts, limit)
    # No more than `limit` rows.
    common = counts.filter(F.col("links") >= least).orderBy("pair").toArrow()
    table = tuple(common[c].to_numpy() for c in ("pair", "links", "best"))
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = shared.value
        for batch in batches:
            lists = batch["pairs"]
            flat, parent = pc.list_flatten(lists).to_numpy(), pc.list_parent_indices(lists).to_numpy()
            at = np.minimum(np.searchsorted(pair, flat), max(len(pair) - 1, 0))
            hit = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)
            sums = np.zeros((2, len(batch)), np.int64)
            np.add.at(sums[0], parent[hit], links[at[hit]])
            sums[1] = np.bincount(parent[hit][best[at[hit]]], minlength=len(batch))
            rest = pa.ListArray.from_arrays(
                pa.array(np.append(0, np.cumsum(np.bincount(parent[~hit], minlength=len(batch)))).astype(np.int32)),
                pa.array(flat[~hit]),
            )
            yield pa.RecordBatch.from_pydict(
                {"row": batch["row"], "sum": pa.array(sums[0]), "best": pa.array(sums[1]), "rest": rest}
            )

    looked = rows.filter("n_links > 0").select("row", "pairs").mapInArrow(
        look_up, "row long, sum long, best long, rest array<long>"
    )
    looked = store.keep(looked, "pair-sums")
    rare = (
        looked.select("row", F.explode("rest").alias("pair"))
        .groupBy("row", "pair")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(counts.filter(F.col("links") < least), "pair")
        .groupBy("row")
        .agg(F.sum(F.col("n") * F.col("links")).alias("sum"), F.sum(F.when(F.col("best"), F.col("n"))).alias("best"))
    )
    sums = (
        looked.select("row", "sum", "best")
        .unionByName(rare)
        .groupBy("row")
        .agg(F.sum("sum").alias("count_sum"), F.sum("best").alias("n_best"))
    )
    return rows.filter("times IS NULL").select(
        "row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"
    ).join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
