"""Repeat removal against a dictionary of every string."""

import hashlib

import pytest

from candlewick.llm import suffixes


def brute(rows, span=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in data:
        if i is not None:
            for a in range(len(t) - span + 1):
                s = t[a : a + span]
                first[s] = min(first.get(s, i), i)
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for a in range(len(t) - span + 1):
            if i is not None and first[t[a : a + span]] < i:
                gone[a : a + span] = b"\1" * span
        kept = bytes(c for c, g in zip(t, gone) if not g)
        runs = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in suffixes.removed(df).collect()), key=repr)


def test_awkward_rows(docs, awkward):
    assert got(docs(awkward)) == brute(awkward)


def test_shared_passages(docs, prose):
    passage, line = prose(5, 40), prose(6, 12)
    rows = []
    for i in range(60):
        text = prose(100 + i, 60)
        if i % 3 == 0:
            text = text[:100] + passage[i % 7 :] + text[100:]
        if i % 2:
            text += "\n" + line + text[: i * 3]
        rows.append(text)
    assert got(docs(rows)) == brute(list(enumerate(rows)))


@pytest.mark.parametrize("hot", [3, 10_000])
def test_hot_phrase_takes_either_way(docs, prose, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    phrase = prose(7, 6)[:45]
    rows = [prose(200 + i, 30) + phrase + prose(300 + i % 5, 30) for i in range(40)]
    found = suffixes.repeated_bytes(docs(rows), hot=hot)
    df = docs(rows)
    monkeypatch.setattr(suffixes, "repeated_bytes", lambda *a: found)
    assert got(df) == brute(list(enumerate(rows)))


def test_periodic_bytes(docs):
    rows = ["ab" * 200, "a" * 300, "ab" * 30, "a" * 49, "a" * 50, "ba" * 100 + "c"]
    assert got(docs(rows)) == brute(list(enumerate(rows)))


def test_long_text_in_parts(docs, prose, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    rows = [prose(8, 200), prose(9, 50) + prose(8, 200)[100:700], prose(8, 200)[3:]]
    assert got(docs(rows)) == brute(list(enumerate(rows)))


def test_empty_table_and_columns(docs, spark):
    assert got(docs([])) == []
    assert suffixes.dedup(docs([])).collect() == []


def test_dedup_keeps_rows_and_columns(docs, prose):
    rows = [prose(1, 60), "x" + prose(1, 60), None]
    df = docs(rows)
    out = {r["doc_id"]: r for r in suffixes.dedup(df).collect()}
    assert set(out) == {0, 1, 2} and out[0].asDict().keys() == set(df.columns)
    assert out[0]["text"] == rows[0] and out[1]["text"] == "x" and out[1]["n_chars"] == 1
    assert out[2]["text"] is None


def test_merge_orders_runs():
    import random

    pick = random.Random(3)
    lists = [sorted({bytes(pick.choices(b"ab", k=pick.randint(1, 6))) for _ in range(30)}) for _ in range(5)]
    runs = []
    for strings in [*lists, []]:
        lcp = [0] + [suffixes.common(a, b) for a, b in zip(strings, strings[1:])]
        runs.append((strings, lcp))
    seen = [runs[r][0][p] for r, p, _ in suffixes.merge(runs)]
    assert seen == sorted(s for strings in lists for s in strings)
