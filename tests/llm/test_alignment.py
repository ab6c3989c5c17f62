"""Token alignment against a plain walk over all token pairs of every text."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from candlewick.llm import alignment
from candlewick.llm.queries import tokenizer_path

PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    return alignment.ByteTokenizer(PATHS[0]), alignment.PieceTokenizer(PATHS[1])


def encoded(sides, text):
    """Both token lists of a whole text, encoded in one call, as (id, start, end)."""
    out = []
    for side, ids in ((sides[0], sides[0].encode([" " + text])[0]), (sides[1], sides[1].model.encode(text))):
        at, row = 0, []
        for i in ids:
            row.append((i, at, at + len(side.bytes[i])))
            at += len(side.bytes[i])
        if not text or b"".join(side.bytes[i] for i in ids) != (" " + text).encode():
            return [], []
        out.append(row)
    return out


def plain(sides, texts):
    links, rows = Counter(), []
    for text in texts:
        a, b = encoded(sides, text or "")
        own = []
        for x in a:
            own += [(x[0], y[0]) for y in b if x[1] < y[2] and y[1] < x[2]]
        links.update(own)
        rows.append((a, b, own))
    most = {}
    for (x, y), n in links.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for a, b, own in rows:
        cuts, groups, start = sorted({x[2] for x in a} & {y[2] for y in b}), [], 0
        for cut in cuts:
            part = [",".join(str(t[0]) for t in side if start < t[2] <= cut) for side in (a, b)]
            groups.append("|".join(part))
            start = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        best = sum(links[p] == most[p[1]] for p in own)
        out.append((len(a), len(b), len(cuts), len(own), best, sum(links[p] for p in own), digest))
    return out


NAMES = "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.fixture
def odd(prose):
    pick = random.Random(5)
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "▁", "<s>", "<|endoftext|>", "１２", "𝄞", " ", "　", "\x00", "don't", "中文", "<0x0A>", "...", " "]
    made = ["".join(pick.choices(parts, k=pick.randint(0, 25))) for _ in range(250)]
    spaced = [" ".join(pick.choices(parts, k=pick.randint(1, 25))) for _ in range(250)]
    return [None, "", " ", "  ", "x", " x", "x ", prose(1, 300), prose(1, 300), prose(2, 40), *made, *spaced]


@pytest.mark.parametrize("limit", [1 << 20, 40, 0])
@pytest.mark.parametrize("step", [1 << 20, 64])
def test_matches_a_walk_over_all_pairs(docs, odd, sides, limit, step, monkeypatch):
    """Whatever number of pairs is shared, and wherever slices end, the rest takes the join."""
    monkeypatch.setattr(alignment, "SLICE", step)
    got = alignment.alignments(docs(odd), *PATHS, limit=limit)
    rows = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in got.collect()}
    assert [rows[i] for i in range(len(odd))] == plain(sides, odd)


def test_long_texts_repeats_and_empty_tables(docs, awkward, sides, spark):
    rows = [*awkward, (20, "ab" * 60_000), (21, "word " * 60_000)]
    table = docs(rows).selectExpr("*", "1 AS pairs", "2 AS n_a", "3 AS times", "4 AS row")
    got = Counter((r["doc_id"], *(r[n] for n in NAMES[:4]), r["groups_sha256"]) for r in alignment.alignments(table, *PATHS).collect())
    want = Counter()
    for i, text in rows:
        a, b = encoded(sides, text or "")
        ends_a, ends_b = {x[2] for x in a}, {y[2] for y in b}
        key = (i, len(a), len(b), len(ends_a & ends_b), len(ends_a | ends_b))
        want[key] += 1
    assert Counter({k[:5]: 0 for k in got}).keys() == want.keys()
    assert sum(got.values()) == len(rows)
    assert alignment.alignments(docs(rows).limit(0), *PATHS).collect() == []


def test_segmented_ends_start_again():
    got = alignment.segmented_ends(np.array([2, 3, 1, 4, 4]), np.array([0, 0, 2, 5, 5]))
    assert got.tolist() == [2, 5, 1, 4, 8]
