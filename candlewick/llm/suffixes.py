"""Exact removal of byte strings that an earlier document holds, by a distributed suffix merge.

Sorting every suffix of a corpus exchanges far more than the corpus. Two facts bound it.

* A string of ``span`` bytes holds a gram with the smallest hash among its grams, found from
  its content alone. It is the string's anchor, so equal strings have equal anchors. An
  anchor that occurs once cannot belong to a repeat: anchors are exchanged first, as packed
  keys, and only suffixes at shared anchors go on. Hash collisions only keep too much.
* The strings of a document with one anchor overlap. They travel as a single suffix: the
  text from the anchor to the last string's end, then the context before the anchor.

Each block of documents sorts its suffixes into runs, one per bucket of anchors, front-coded
(length of the prefix shared with the suffix before, then the rest) with equal suffixes
written once. A bucket merges its runs with a loser tree that keeps, for every suffix, how
much it shares with the last one put out: different lengths decide a match without looking
at a byte, equal lengths compare only what lies behind them. Suffixes of one anchor come out
together. If they are all equal, their smallest doc_id decides; if not, a dictionary of their
strings does, byte by byte. Anchors met more than ``HOT`` times send each string
on its own, placed by the string's own hash, so that no phrase, however common, meets in one task.

NULL or empty text and texts shorter than ``span`` lose nothing. Rows that share a doc_id do
not shorten each other. Rows without doc_id lose nothing and shorten nothing. Extra columns
pass through `dedup`, whatever their names, and are ignored by `removed`. An empty table gives
no rows. A very long text is hashed in overlapping parts and held whole by one task at a time.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

SPAN, GRAM = 50, 18
HOT = 20_000
CHUNK = 1 << 19  # bytes hashed at once
BLOCK = 24 << 20  # text bytes whose suffixes form one set of runs
BUCKET_BYTES = 16 << 20  # text bytes whose suffixes one bucket takes, on average
MOST_BUCKETS = 1 << 16
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram at every position, by doubling."""

    def power(k: int) -> np.uint64:
        return np.uint64(pow(int(BASE), k, 1 << 64))

    part, size = data.astype(np.uint64) + np.uint64(1), 1
    out, length = None, 0
    while True:
        if gram & size:
            if out is None:
                out, length = part, size
            else:
                m = len(data) - length - size + 1
                out = out[:m] * power(size) + part[length : length + m]
                length += size
        if 2 * size > gram:
            return mix(out)
        m = len(data) - 2 * size + 1
        part = part[:m] * power(size) + part[size : size + m]
        size *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray, span: int, gram: int):
    """(start, last start, anchor, key) of every run of strings with one anchor.

    ``data`` is a chunk of texts one after another, shorter than 2**20; ``ends`` are their
    ends. Strings lie within one text.
    """
    if len(data) < span:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, gram)
    spot = np.arange(len(hashes), dtype=np.uint64)
    # The leftmost of equal minima: the position is the low part of the compared value.
    ranked = (hashes & ~np.uint64((1 << 20) - 1)) | spot
    anchor = (sliding_min(ranked, span - gram + 1) & np.uint64((1 << 20) - 1)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for end in ends[:-1]:
        valid[max(0, end - span + 1) : end] = False
    change = np.ones(len(anchor), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.r_[first[1:], len(anchor)] - 1
    ok = valid[first]
    first, last = first[ok], last[ok]
    at = anchor[first]
    return first, last, at, mix(hashes[at] ^ BASE)


def chunks(texts: list[bytes], span: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """(documents, their offsets in the document, bytes, ends): long texts in overlapping parts."""
    docs, offsets, parts, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), CHUNK):
            part = text[at : at + CHUNK + span - 1]
            if len(part) < span:
                continue
            if parts and size + len(part) > CHUNK:
                yield docs, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                docs, offsets, parts, size = [], [], [], 0
            docs.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield docs, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


def records(texts: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, start, windows - 1, anchor - start, key) of all texts in order."""
    out = []
    for docs, offsets, data, ends in chunks(texts, span):
        first, last, at, key = anchors(np.frombuffer(data, np.uint8), ends, span, gram)
        own = np.searchsorted(ends, first, "right")
        shift = np.array(offsets)[own] - np.r_[0, ends[:-1]][own]
        out.append((np.array(docs)[own], first + shift, last - first, at - first, key))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value."""
    head = np.array([len(a) for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(1).compress(head + b"".join(a.tobytes() for a in arrays))


def unpack(value: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(value)
    sizes, at, out = np.frombuffer(data, np.int64, len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


# Suffix runs


def suffix_rows(data: np.ndarray, start, extra, lead, span: int, gram: int) -> np.ndarray:
    """One fixed-width row per suffix: text from the anchor, text before it, then both lengths."""
    width = 2 * span - gram + 2
    out = np.zeros((len(start), width), np.uint8)
    column = np.arange(width)
    for at in range(0, len(start), 4096):
        s, e, b = (a[at : at + 4096, None] for a in (start, extra, lead))
        size = span + e
        source = np.where(column < size - b, s + b + column, s + column - (size - b))
        rows = data[np.minimum(source, len(data) - 1)]
        rows = np.where(column < size, rows, 0)
        rows = np.where(column == size, b + 1, rows)
        out[at : at + 4096] = np.where(column == size + 1, e + 1, rows)
    return out


def front_code(rows: np.ndarray, doc: np.ndarray, start: np.ndarray) -> bytes:
    """A sorted run: shared prefix lengths, remainders, and who holds each distinct suffix."""
    full = rows.shape[1]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(1), differ.argmax(1), full)
    fresh = np.r_[True, shared < full]
    lcp = np.r_[0, shared][fresh].astype(np.uint8)
    kept = rows[fresh]
    size = full - (kept[:, ::-1] != 0).argmax(1)
    column = np.arange(full)
    tail = kept[(column >= lcp[:, None]) & (column < size[:, None])]
    holders = np.diff(np.r_[np.flatnonzero(fresh), len(rows)])
    return pack(lcp, (size - lcp).astype(np.uint8), tail, holders.astype(np.uint32), doc.astype(np.uint32), start.astype(np.uint32))


def read_run(value: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray]:
    lcp, rest, tail, holders, doc, start = unpack(value, "u1", "u1", "u1", "u4", "u4", "u4")
    body, at, last, out = tail.tobytes(), 0, b"", []
    for keep, more in zip(lcp.tolist(), rest.tolist()):
        last = last[:keep].ljust(keep, b"\0") + body[at : at + more]
        at += more
        out.append(last)
    return out, lcp.tolist(), np.r_[0, np.cumsum(holders)].astype(np.int64), doc, start


FULL = 1 << 16  # prefix length that stands for equality


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two different byte strings."""
    n = max(len(a), len(b))
    x = int.from_bytes(a.ljust(n, b"\0"), "big") ^ int.from_bytes(b.ljust(n, b"\0"), "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place, prefix shared with the one before) of all suffixes in sorted order.

    A loser tree: each inner node holds the loser of its match and how long a prefix that
    loser shares with the winner, so a comparison starts behind what is known to be equal.
    A shared prefix of FULL means equal suffixes.
    """
    k = 1
    while k < len(runs):
        k *= 2
    suffix = [r[0][0] if i < len(runs) and (r := runs[i])[0] else None for i in range(k)]
    place = [0] * k
    loser, shared = [0] * (2 * k), [0] * (2 * k)

    def match(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """(winner, its prefix with the last output, loser, its prefix with the winner)."""
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        if la < 0:
            return a, la, b, lb
        if la == FULL:
            return a, la, b, FULL
        x, y = suffix[a][la:], suffix[b][la:]
        if x == y:
            return a, la, b, FULL
        known = la + common(x, y)
        return (a, la, b, known) if x < y else (b, la, a, known)

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, -1 if suffix[node - k] is None else 0
        winner, won, loser[node], shared[node] = match(*play(2 * node), *play(2 * node + 1))
        return winner, won

    winner, won = play(1)
    while won >= 0:
        yield winner, place[winner], won
        strings, prefixes = runs[winner]
        place[winner] += 1
        at = place[winner]
        if at < len(strings):
            suffix[winner], won = strings[at], prefixes[at]
        else:
            won = -1
        node = (winner + k) // 2
        while node:
            other = shared[node]
            if other > won:
                winner, loser[node] = loser[node], winner
                shared[node], won = won, other
            elif other == won and won >= 0:
                winner, won, loser[node], shared[node] = match(winner, won, loser[node], other)
            node //= 2


def repeats(runs: list[bytes], names: list[np.ndarray], span: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(run, document, first byte, end) of bytes covered by strings of smaller documents.

    ``names[r]`` gives the doc_id of each document number of run r.
    """
    read, held_by = [], []
    for value, own in zip(runs, names):
        strings, prefixes, ends, doc, start = read_run(value)
        read.append((strings, prefixes))
        held_by.append((ends.tolist(), doc, start, own[doc]))

    def holders(members: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
        """(doc_id, run, document, start) of everyone who holds a suffix."""
        found = []
        for r, i in members:
            ends, doc, start, ids = held_by[r]
            a, z = ends[i], ends[i + 1]
            if z - a == 1:
                found.append((int(ids[a]), r, int(doc[a]), int(start[a])))
            else:
                found += zip(ids[a:z].tolist(), [r] * (z - a), doc[a:z].tolist(), start[a:z].tolist())
        return found

    def settle(group: list[tuple[bytes, list[tuple[int, int]]]]) -> Iterator[tuple[int, int, int, int]]:
        if len(group) == 1:
            text, members = group[0]
            if len(members) == 1:
                r, i = members[0]
                if held_by[r][0][i + 1] - held_by[r][0][i] == 1:
                    return  # one suffix in one document: nobody else holds its strings
            held = holders(members)
            low, end = min(held)[0], span + text[-1] - 1
            for doc_id, r, doc, start in held:
                if doc_id > low:
                    yield r, doc, start, start + end
            return
        first: dict[bytes, int] = {}
        cut = []
        for text, members in group:
            lead, windows = text[-2] - 1, text[-1]
            size = span + windows - 1
            plain = text[size - lead : size] + text[: size - lead]
            own = [plain[w : w + span] for w in range(windows)]
            held = holders(members)
            low = min(held)[0]
            for string in own:
                if first.get(string, low) >= low:
                    first[string] = low
            cut.append((own, held))
        for own, held in cut:
            limits = [first[string] for string in own]
            low, high = min(limits), max(limits)
            for doc_id, r, doc, start in held:
                if doc_id <= low:
                    continue
                left, right = 0, len(own) - 1
                if doc_id <= high:
                    # Strings of one suffix lie closer than they are long: their union has no gap.
                    while limits[left] >= doc_id:
                        left += 1
                    while limits[right] >= doc_id:
                        right -= 1
                yield r, doc, start + left, start + right + span

    group: list[tuple[bytes, list[tuple[int, int]]]] = []
    for run, place, won in merge(read):
        if won == FULL:
            group[-1][1].append((run, place))
            continue
        text = read[run][0][place]
        if group and won < gram:
            yield from settle(group)
            group = []
        group.append((text, [(run, place)]))
    if group:
        yield from settle(group)


# The Spark job


def mark() -> Column:
    """With doc_id this names a row's content, also where ids repeat."""
    return F.xxhash64("text")


def _texts(docs: DataFrame) -> DataFrame:
    rows = store.documents(docs).select("doc_id", mark().alias("sig"), F.col("text").cast("binary").alias("text"))
    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(block number, rows) of a task's batches, blocks of about BLOCK text bytes."""
    block, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in batch.schema.names)):
            rows.append(row)
            size += len(row[2])
            if size >= BLOCK:
                yield block, rows
                block, rows, size = block + 1, [], 0
    if rows:
        yield block, rows


def shared_anchors(docs: DataFrame, buckets: int, span: int, gram: int, hot: int) -> DataFrame:
    """(doc_id, sig, spots): the suffixes at anchors that occur twice or more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            doc, start, extra, lead, key = records([r[2] for r in rows], span, gram)
            bucket = (key % np.uint64(buckets)).astype(np.uint16)
            ids = np.array([r[0] for r in rows], np.int64)
            sigs = np.array([r[1] for r in rows], np.int64)
            counts = np.bincount(doc, minlength=len(rows)).astype(np.uint32)
            first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
            # Starts follow from the runs before, but for a text's own parts.
            step = np.diff(start, prepend=0)
            step[first] = start[first]
            head = pack(ids, sigs, counts, bucket, extra.astype(np.uint8), lead.astype(np.uint8), step.astype(np.uint32))
            out = [(block, -1, head)]
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            packed = (key >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    out.append((block, b, packed[own].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.binary()))],
                names=["block", "bucket", "data"],
            )

    def count(table: pa.Table) -> pa.Table:
        blocks, data = table["block"].to_pylist(), table["data"].to_pylist()
        sizes = [len(d) // 6 for d in data]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :6] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
        _, of, n = np.unique(keys.view("<u8").ravel(), return_inverse=True, return_counts=True)
        level = (n[of] > 1).astype(np.uint8) + (n[of] > hot)
        ends = np.cumsum(sizes)
        answers = [zstandard.ZstdCompressor(1).compress(level[e - s : e].tobytes()) for s, e in zip(sizes, ends)]
        return pa.table({"block": blocks, "bucket": table["bucket"], "data": pa.array(answers, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        replies = {}
        head = None
        for bucket, data in zip(table["bucket"].to_pylist(), table["data"].to_pylist()):
            if bucket < 0:
                head = unpack(data, "i8", "i8", "u4", "u2", "u1", "u1", "u4")
            else:
                replies[bucket] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
        ids, sigs, counts, bucket, extra, lead, step = head
        order = np.argsort(bucket, kind="stable")
        level = np.zeros(len(bucket), np.uint8)
        if len(bucket):
            level[order] = np.concatenate([replies[b] for b in sorted(replies)])
        out, at = {"doc_id": [], "sig": [], "spots": []}, 0
        for doc_id, sig, n in zip(ids.tolist(), sigs.tolist(), counts.tolist()):
            own = slice(at, at + n)
            at += n
            on = level[own] > 0
            if on.any():
                start = np.cumsum(step[own].astype(np.int64))[on].astype(np.uint32)
                out["doc_id"].append(doc_id)
                out["sig"].append(sig)
                out["spots"].append(
                    start.tobytes() + extra[own][on].tobytes() + lead[own][on].tobytes() + level[own][on].tobytes()
                )
        kinds = (pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    schema = "block long, bucket int, data binary"
    # Two rows of one id and text have the same anchors; one of them stands for both.
    named = _texts(docs).filter("doc_id IS NOT NULL")
    sent = store.keep(named.mapInArrow(emit, schema), "anchors")
    replies = sent.filter("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(count, schema)
    heads = sent.filter("bucket < 0")
    found = heads.unionByName(replies).groupBy("block").applyInArrow(answer, "doc_id long, sig long, spots binary")
    kept = store.keep(found.dropDuplicates(["doc_id", "sig"]), "shared-anchors")
    store.forget(sent)
    return kept


def repeated_bytes(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, sig, bytes): packed (first, end) pairs of what earlier documents hold."""
    size = _texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(8, tasks, size // BUCKET_BYTES))
    spots = shared_anchors(docs, buckets, span, gram, hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _blocks(batches):
            data = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
            base = np.r_[0, np.cumsum([len(r[2]) for r in rows])]
            cols = [[], [], [], [], []]
            for i, (_, _, _, spot) in enumerate(rows):
                n = len(spot) // 7
                start = np.frombuffer(spot, "<u4", n).astype(np.int64)
                extra, lead, level = np.frombuffer(spot, np.uint8, 3 * n, 4 * n).reshape(3, n).astype(np.int64)
                for c, v in zip(cols, (np.full(n, i), start, extra, lead, level)):
                    c.append(v)
            doc, start, extra, lead, level = (np.concatenate(c) for c in cols)
            often = level > 1
            if often.any():
                # Strings of a hot anchor travel one by one.
                n = extra[often] + 1
                each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                doc = np.r_[doc[~often], np.repeat(doc[often], n)]
                start = np.r_[start[~often], np.repeat(start[often], n) + each]
                zero = np.zeros(len(each), np.int64)
                extra, lead = np.r_[extra[~often], zero], np.r_[lead[~often], zero]
            alone = np.arange(len(doc)) >= (~often).sum()
            rows_ = suffix_rows(data, base[doc] + start, extra, lead, span, gram)
            bucket = np.zeros(len(doc), np.int64)
            for on, size in ((~alone, gram), (alone, span)):
                if on.any():
                    hashed = np.zeros(on.sum(), np.uint64)
                    for j in range(size):
                        hashed = hashed * BASE + rows_[on, j] + np.uint64(1)
                    bucket[on] = (mix(hashed) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(rows_.view(f"S{rows_.shape[1]}").ravel(), kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids = np.array([r[0] for r in rows], np.int64)
            sigs = np.array([r[1] for r in rows], np.int64)
            out = []
            for b in range(buckets):
                own = order[cuts[b] : cuts[b + 1]]
                if len(own):
                    used, number = np.unique(doc[own], return_inverse=True)
                    run = front_code(rows_[own], number, start[own])
                    out.append((b, pack(ids[used], sigs[used]), run))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))],
                names=["bucket", "names", "run"],
            )

    def combine(table: pa.Table) -> pa.Table:
        named = [unpack(n, "i8", "i8") for n in table["names"].to_pylist()]
        spans: dict[tuple[int, int], list[int]] = defaultdict(list)
        for run, doc, left, right in repeats(table["run"].to_pylist(), [n[0] for n in named], span, gram):
            spans[run, doc] += left, right
        # One value for each group of documents, not a row for each document met here.
        keys = list(spans)
        ids = np.array([named[r][0][d] for r, d in keys], np.int64)
        sigs = np.array([named[r][1][d] for r, d in keys], np.int64)
        part = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        out: dict[str, list] = {"part": [], "data": []}
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            pairs = [spans[keys[i]] for i in own]
            sizes = np.array([len(x) for x in pairs], np.uint32)
            out["part"].append(int(p))
            out["data"].append(pack(ids[own], sigs[own], sizes, np.array(list(chain.from_iterable(pairs)), np.uint32)))
        return pa.table([pa.array(out["part"], pa.int32()), pa.array(out["data"], pa.binary())], names=list(out))

    def gather(table: pa.Table) -> pa.Table:
        held: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        for data in table["data"].to_pylist():
            ids, sigs, sizes, flat = unpack(data, "i8", "i8", "u4", "u4")
            at = 0
            for key in zip(ids.tolist(), sigs.tolist(), sizes.tolist()):
                held[key[:2]].append(flat[at : at + key[2]].tobytes())
                at += key[2]
        return pa.table(
            {
                "doc_id": pa.array([k[0] for k in held], pa.int64()),
                "sig": pa.array([k[1] for k in held], pa.int64()),
                "bytes": pa.array([b"".join(v) for v in held.values()], pa.binary()),
            }
        )

    runs = (
        _texts(docs)
        .join(spots, ["doc_id", "sig"])
        .select("doc_id", "sig", "text", "spots")
        .mapInArrow(emit, "bucket int, names binary, run binary")
    )
    merged = runs.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(combine, "part int, data binary")
    found = merged.repartition(buckets, "part").groupBy("part").applyInArrow(gather, "doc_id long, sig long, bytes binary")
    kept = store.keep(found, "repeats")
    store.forget(spots)
    return kept


def without(text: bytes, found: bytes | None) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal removed runs)."""
    if not found:
        return text, 0, 0
    pairs = np.frombuffer(found, "<u4").reshape(-1, 2).astype(np.int64)
    depth = np.zeros(len(text) + 1, np.int32)
    np.add.at(depth, pairs[:, 0], 1)
    np.add.at(depth, pairs[:, 1], -1)
    gone = np.cumsum(depth[:-1]) > 0
    n_runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), n_runs


def removed(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            done = [without(t, b) for t, b in zip(texts, batch["bytes"].to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                    "n_removed": pa.array([d[1] for d in done], pa.int64()),
                    "n_spans": pa.array([d[2] for d in done], pa.int64()),
                    "kept_sha256": [hashlib.sha256(d[0]).hexdigest() for d in done],
                }
            )

    found = repeated_bytes(docs, span, gram)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    joined = _texts(docs).join(found, ["doc_id", "sig"], "left").select("doc_id", "text", "bytes")
    return joined.mapInArrow(run, schema)


def dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; ``n_chars``, if there, follows.

    Half a character that a cut leaves behind goes as well.
    """
    id_, sig_, bytes_ = store.unused(docs.columns, "id", "sig", "bytes")
    found = repeated_bytes(docs, span, gram).select(
        F.col("doc_id").alias(id_), F.col("sig").alias(sig_), F.col("bytes").alias(bytes_)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, pairs in zip(batch["text"].to_pylist(), batch[bytes_].to_pylist()):
                if pairs:
                    text = without(text.encode(), pairs)[0].decode(errors="ignore")
                texts.append(text)
            out = {c: batch[c] for c in batch.schema.names if c != bytes_}
            out["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out)

    text = F.coalesce("text", F.lit(""))
    same = (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64(text) == F.col(sig_))
    joined = docs.join(found, same, "left").select(*docs.columns, bytes_)
    cut = joined.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return cut
