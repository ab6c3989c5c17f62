"""SentencePiece encoding and decoding by batched numpy Viterbi.

No piece reaches over a space, so a text is cut into units (spaces and the word behind
them), each distinct unit is encoded once, and units of equal length advance through the
lattice together: hashes of all substrings probe the sorted piece keys, and vectorised
maxima store the back pointers. Of equally good segmentations that with the longer last
piece wins. Characters without a piece fall back to their UTF-8 bytes.

Spaces are kept, so decoding gives the text back, except that the space mark itself
(U+2581) decodes to a space. NULL or empty text has no ids. Repeated rows encode alike;
extra columns are ignored, whatever their names; an empty table gives no rows. A very long
text is encoded whole; a unit costs a step per character, so a unit of a million characters
is slow, not cut.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

MARK = "▁"
BASE = 0x9E3779B97F4A7C15
CACHE_UNITS = 600_000
CELLS = 1 << 20  # characters in one batch of equal-length units
UNKNOWN_PENALTY = 10.0


def code_points(words: list[str]) -> np.ndarray:
    """(words, length) code points of words of one length."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), -1)


def batches_of(words: list[str], cells: int = CELLS) -> Iterator[tuple[list[int], np.ndarray]]:
    """(positions, code points) of words of equal length, within a bound on cells."""
    by_length: dict[int, list[int]] = defaultdict(list)
    for i, word in enumerate(words):
        by_length[len(word)].append(i)
    for length, rows in sorted(by_length.items()):
        step = max(1, cells // length)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            yield part, code_points([words[i] for i in part])


class Vocabulary:
    """Sorted piece keys with ids and scores; bytes for what no piece covers."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.size)]
        self.text = [n.replace(MARK, " ").encode() for n in names]
        self.byte_id = np.zeros(256, np.int64)
        normal = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_id[value], self.text[i] = i, bytes([value])
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text[i] = b""
            else:
                normal.append(i)
        self.longest = max(len(names[i]) for i in normal)
        keys = np.zeros(len(normal), np.uint64)
        for rows, codes in batches_of([names[i] for i in normal]):
            keys[rows] = self.spans(codes, codes.shape[1])[:, 0]
        order = np.argsort(keys)
        self.keys = keys[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a key")
        self.ids = np.array(normal, np.int64)[order]
        scores = np.array([model.get_score(i) for i in range(self.size)], np.float32)
        self.scores = scores
        self.unknown = np.float32(scores[normal].min() - np.float32(UNKNOWN_PENALTY))

    @staticmethod
    def prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * np.uint64(BASE) + codes[:, j] + np.uint64(1)
        return out

    @classmethod
    def spans(cls, codes: np.ndarray, length: int, prefix: np.ndarray | None = None) -> np.ndarray:
        """Hash of every substring of ``length`` characters."""
        prefix = cls.prefixes(codes) if prefix is None else prefix
        power = np.uint64(pow(BASE, length, 1 << 64))
        h = prefix[:, length:] - prefix[:, : prefix.shape[1] - length] * power
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def matches(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each length from 1: the piece id at every start, -1 where there is none."""
        prefix = self.prefixes(codes)
        out = []
        for length in range(1, min(self.longest, codes.shape[1]) + 1):
            h = self.spans(codes, length, prefix)
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            out.append(np.where(self.keys[at] == h, self.ids[at], -1))
        return out

    def viterbi(self, codes: np.ndarray) -> list[np.ndarray]:
        """Ids of the best segmentation of each word."""
        n, size = codes.shape
        found = self.matches(codes)
        best = np.full((size + 1, n), -np.inf, np.float32)
        back = np.zeros((size + 1, n), np.int64)
        best[0] = 0
        for j in range(1, size + 1):
            for length in range(min(j, len(found)), 0, -1):
                ids = found[length - 1][:, j - length]
                score = np.where(ids >= 0, self.scores[ids], self.unknown if length == 1 else -np.inf)
                score = best[j - length] + score.astype(np.float32)
                better = score > best[j]
                best[j][better] = score[better]
                back[j][better] = length
        rows, at = np.arange(n), np.full(n, size)
        steps, lengths = [], []
        while len(rows):
            length = back[at[rows], rows]
            at[rows] -= length
            piece = np.full(n, -2)
            for k in np.unique(length):
                on = rows[length == k]
                piece[on] = found[k - 1][on, at[on]]
            steps.append(piece)
            lengths.append(at.copy())
            rows = rows[at[rows] > 0]
        ids = np.stack(steps[::-1], 1)
        starts = np.stack(lengths[::-1], 1)
        plain = (ids != -1).all(1)
        out = []
        for r in range(n):
            own = ids[r]
            if plain[r]:
                out.append(own[own >= 0])
                continue
            row: list[int] = []
            for piece, start in zip(own, starts[r]):
                if piece >= 0:
                    row.append(int(piece))
                elif piece == -1:
                    row.extend(self.byte_id[list(chr(codes[r, start]).encode())].tolist())
            out.append(np.array(row, np.int64))
        return out

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Packed little-endian 32-bit ids of every unit."""
        out: list[bytes] = [b""] * len(units)
        for rows, codes in batches_of(units):
            for row, ids in zip(rows, self.viterbi(codes)):
                out[row] = ids.astype("<u4").tobytes()
        return out


class Codec:
    def __init__(self, path: str):
        self.vocabulary, self.known = Vocabulary(path), {}

    @staticmethod
    def units(text: str) -> list[str]:
        if not text:
            return []
        if "  " not in text and text[0] != " " and MARK not in text:
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [u[1:] for u in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; the new units of all texts are encoded together."""
        cut = [self.units(t) for t in texts]
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        new = list({u for units in cut for u in units if u not in self.known})
        self.known.update(zip(new, self.vocabulary.encode_units([MARK + u for u in new])))
        return [b"".join(map(self.known.__getitem__, units)) for units in cut]

    def decode(self, ids: bytes) -> str:
        pieces = map(self.vocabulary.text.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(pieces)[1:].decode(errors="replace")


def worker_codec(path: str) -> Codec:
    """The codec of this Python worker: later tasks find the units of earlier ones."""
    kept = sys.modules.setdefault("_candlewick_codecs", types.ModuleType("_candlewick_codecs"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Codec(path)
    return kept.__dict__[path]


def _texts(docs: DataFrame) -> DataFrame:
    return store.documents(docs)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids): packed little-endian 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            ids = codec.encode(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _texts(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            texts = [codec.decode(b or b"") for b in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts)], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: number and crc32 of its ids, digest of the decoded text, and if it equals the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(model)
        for batch in batches:
            texts = batch["text"].to_pylist()
            ids = codec.encode(texts)
            back = [codec.decode(b) for b in ids]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "n_ids": pa.array([len(b) // 4 for b in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(b) for b in ids], pa.int64()),
                    "decoded_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in back],
                    "round_trip": [a == b for a, b in zip(texts, back)],
                }
            )

    schema = "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean"
    return _texts(docs).mapInArrow(run, schema)
