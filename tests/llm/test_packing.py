import random
import zlib
from collections import Counter

import numpy as np
import pytest

from candlewick.llm import packing
from candlewick.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


def plain_best_fit(counts, length):
    rooms = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = [r for r in rooms if r >= size]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - size)
            else:
                rooms.append(length - size)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_intervals_are_a_best_fit_packing(seed):
    pick = random.Random(seed)
    length = pick.choice([10, 37, 100])
    counts = Counter(pick.choice([pick.randint(1, length), pick.randint(1, 5)]) for _ in range(300))
    bins, used = {}, Counter()
    for size, rank, n, first, offset in packing.best_fit(counts, length):
        assert used[size] == rank
        used[size] += n
        for b in range(first, first + n):
            bins.setdefault(b, []).append((offset, size))
    assert used == counts
    for parts in bins.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    assert len(bins) == plain_best_fit(counts, length)


def test_pack_matches_the_tokenizer(docs, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    want = Counter()
    for i, text in awkward:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    rows = packing.pack(docs(awkward), PATH).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    seen = {}
    for r in rows:
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 2048


def test_words_with_marks_and_other_scripts():
    from tokenizers import Tokenizer

    tokenizer, encode = Tokenizer.from_file(PATH), packing.encoder(PATH)
    for text in ["don't. it's, IT'S we'LL!", "É. Ünï,x", "a<|endoftext|>b <|STARTOFTEXT|>", "x1.2,3 4!", "ﬀ ǅ. İ ſ, Ⅷ ª.", "你好，世界。 x", "a\x85b　c. \x1cd", "", "  "]:
        ids = np.frombuffer(encode(text.encode()), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_no_rows(docs):
    assert packing.pack(docs([]), PATH).collect() == []
