import hashlib

import numpy as np
import pytest

from candlewick.llm import fingerprints as fp


def order(row):
    return (row[0] is not None, row[0] or 0)


def test_rows_follow_each_other(docs, prose, awkward):
    rows = [r for r in awkward if r[0] is not None and r[0] != 5] + [(50 + i, prose(i, 40 + i)) for i in range(40)]
    out = {r["doc_id"]: r for r in fp.fingerprint(docs(rows)).collect()}
    assert len(out) == len(rows)
    make = fp.Fingerprinter(256, 8, 5)
    ordered = sorted(((i, t or "") for i, t in rows), key=order)
    for (i, text), (_, follow) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(text) // 2
        changed = text[: len(text) - half] + follow[:half]
        r = out[i]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == make(text).hex()
        assert r["edited_fingerprint"] == make(changed).hex()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_repeated_and_missing_ids(docs, awkward):
    out = fp.fingerprint(docs(awkward)).collect()
    assert sorted((r["doc_id"] for r in out), key=repr) == sorted((i for i, _ in awkward), key=repr)


def test_one_row_and_no_rows(docs, prose):
    text = prose(1, 60)
    row = fp.fingerprint(docs([text])).first()
    half = len(text) // 2
    assert row["edited_sha256"] == hashlib.sha256((text[: len(text) - half] + text[:half]).encode()).hexdigest()
    assert row["near_next"] == 1.0
    assert fp.fingerprint(docs([])).collect() == []


def true_likeness(a, b):
    sets = [{tuple(t.lower().split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("bits", [1, 2, 4, 8])
def test_estimates_likeness(prose, bits):
    make = fp.Fingerprinter(256, bits, 5)
    misses = []
    for seed in range(12):
        a = prose(seed, 60 + 90 * seed, 4000)
        b = " ".join(a.split()[: 20 + 60 * seed] + prose(seed + 50, 40, 4000).split())
        misses.append(fp.likeness(make(a), make(b), 256, bits) - true_likeness(a, b))
    assert abs(np.mean(misses)) < 0.06 and np.abs(misses).max() < 0.3


def test_sparse_sets_are_densified_alike(prose):
    make = fp.Fingerprinter(256, 8, 5)
    assert len(make("a b c d e f")) == 256
    assert make("a b c d e f") == make("A  b\nc d E f")
    assert fp.likeness(make("a"), make("a"), 256, 8) == 1.0
    assert fp.likeness(b"", make("a"), 256, 8) == 0.0 and fp.likeness(b"", b"", 256, 8) == 1.0
