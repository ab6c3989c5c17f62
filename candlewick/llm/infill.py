"""Fill-in-middle transformation with cuts from a piecewise-linear learned rank index.

A text is cut into units (lines with their line feed). Two cuts chosen by the document's id
part it into prefix, middle and suffix, which are put out in one of two orders behind markers.

Where the k-th unit of a document starts is answered by a learned index over all unit
boundaries of a batch of texts: boundaries are ranked through the batch, segments of a line
are fitted so that no boundary lies further than ``error`` bytes from its line (greedily, each
as long as the cone of admissible slopes stays open), and the small residuals are stored. A
cut is predicted from its rank and corrected by its residual, which is exact. Cuts of all
documents of a batch are looked up together; no text is cut into a list of lines.

NULL or empty text has no units and stays plain, as does a text that holds a marker. A NULL
doc_id counts as the empty string in the hash. Repeated rows give equal rows. A very long
text is one more run of boundaries; a batch is bounded by rows and bytes. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ERROR = 1 << 10  # bytes
LINE_FEED = 10


@dataclass(frozen=True)
class Settings:
    seed: int = 7
    fim_percent: int = 100
    spm_percent: int = 50
    error: int = ERROR


class RankIndex:
    """Offset of every rank of a sorted array: segments of a line and bounded residuals."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        if not 0 < error < (1 << 15) - 1:
            raise ValueError("error must fit a 16-bit residual")
        offsets = np.asarray(offsets, np.int64)
        first, base, slope = [], [], []
        at, n = 0, len(offsets)
        while at < n:
            size, rise = self.longest(offsets, at, error)
            first.append(at)
            base.append(offsets[at])
            slope.append(rise)
            at += size
        self.first = np.array(first, np.int64)
        self.base = np.array(base, np.int64)
        self.slope = np.array(slope, np.float64)
        residual = offsets - self.predict(np.arange(n))
        if n and np.abs(residual).max() > error + 1:
            raise AssertionError("a segment left its error bound")
        self.residual = residual.astype(np.int16)

    @staticmethod
    def longest(offsets: np.ndarray, at: int, error: int) -> tuple[int, float]:
        """Size and slope of the longest segment from rank ``at`` whose cone stays open."""
        low, high, size, step = -np.inf, np.inf, 1, 64
        while at + size < len(offsets):
            end = min(len(offsets), at + size + step)
            run = np.arange(size, end - at)
            rise = offsets[at + size : end] - offsets[at]
            lows = np.maximum.accumulate(np.append(low, (rise - error) / run))[1:]
            highs = np.minimum.accumulate(np.append(high, (rise + error) / run))[1:]
            shut = np.flatnonzero(lows > highs)
            good = int(shut[0]) if len(shut) else len(run)
            if good:
                low, high, size = lows[good - 1], highs[good - 1], size + good
            if len(shut):
                break
            step *= 2
        return size, 0.0 if size == 1 else (low + high) / 2

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        part = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[part] + np.rint(self.slope[part] * (ranks - self.first[part])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets: prediction and stored residual."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit boundaries of all texts in rising order, each text's first rank and its units.

    A text with n units has n + 1 boundaries: its start, and the end of every unit.
    """
    feeds = np.flatnonzero(data == LINE_FEED) + 1
    before = np.searchsorted(feeds, starts, "right")
    upto = np.searchsorted(feeds, ends, "right")
    # A text that does not close with a line feed has one more unit, up to its end.
    open_end = (ends > starts) & (data[np.maximum(ends - 1, 0)] != LINE_FEED) if len(data) else ends > starts
    n = upto - before + open_end
    first = np.concatenate([[0], np.cumsum(n + 1)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    out = np.empty(int((n + 1).sum()), np.int64)
    out[first] = starts
    inner = np.ones(len(out), bool)
    inner[first] = False
    last = first + n
    inner[last[open_end]] = False
    out[last[open_end]] = ends[open_end]
    out[inner] = feeds[int(before[0]) : int(upto[-1])] if len(n) else feeds[:0]
    return out, first, n


def cut_batch(texts: pa.Array, h: list[np.ndarray], settings: Settings) -> dict[str, pa.Array]:
    """Units, form, both cuts in characters and the output text of every text of a batch."""
    size = len(texts)
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + size + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    starts, ends = offsets[:-1], offsets[1:]
    ranks, first, n = boundaries(data, starts, ends)
    index = RankIndex(ranks, settings.error)
    one, two = h[0] % (n + 1), h[1] % (n + 1)
    cut_a = index.offset(first + np.minimum(one, two)) if size else starts
    cut_b = index.offset(first + np.maximum(one, two)) if size else starts
    marked = np.zeros(size, bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    plain = (ends == starts) | marked | (h[2] % 100 >= settings.fim_percent)
    spm = h[3] % 100 < settings.spm_percent
    heads = (data & 0xC0) != 0x80  # bytes that begin a character
    view, p, s, m = memoryview(data), PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out, chars = [], np.zeros((2, size), np.int64)
    for at, (a, i, j, z, keep, swap) in enumerate(zip(starts, cut_a, cut_b, ends, plain, spm)):
        chars[:, at] = np.count_nonzero(heads[a:i]), np.count_nonzero(heads[i:j])
        if keep:
            out.append(bytes(view[a:z]))
        elif swap:
            out.append(b"".join((s, view[j:z], p, view[a:i], m, view[i:j])))
        else:
            out.append(b"".join((p, view[a:i], s, view[j:z], m, view[i:j])))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    return {
        "n": pa.array(n.astype(np.int64)),
        "form": pa.array(form.tolist(), pa.string()),
        "prefix_chars": pa.array(chars[0], pa.int64(), mask=plain),
        "middle_chars": pa.array(chars[1], pa.int64(), mask=plain),
        "output": pa.array(out, pa.binary()),
    }


def hashes(doc_id: Column, seed: int) -> list[Column]:
    """The first four 8-digit groups of the hexadecimal SHA-256 of ``seed:doc_id``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    digest = F.sha2(key.cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every whole text; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch[f"h{i}"].to_numpy() for i in range(4)]
            made = cut_batch(batch["text"], h, settings)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], **made})

    texts = store.documents(docs)
    keyed = texts.select(
        "doc_id",
        F.col("text").cast("binary").alias("text"),
        *[c.alias(f"h{i}") for i, c in enumerate(hashes(F.col("doc_id"), settings.seed))],
    )
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    return keyed.mapInArrow(run, schema).withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from.

    No part holds a marker, so each marker's first occurrence is where it was set.
    """
    body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
    middle = F.substring_index(body, MIDDLE, -1)
    front = F.substring_index(body, MIDDLE, 1)
    psm = F.concat(F.substring_index(front, SUFFIX, 1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring_index(front, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
