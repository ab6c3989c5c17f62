import itertools
import random

import numpy as np
import pytest
import xxhash

from candlewick.llm import simhash
from candlewick.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 3] for i in range(len(words) - 2)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(marks, bits=3):
    """Smallest id reachable for each (id, fp) row."""
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(marks)), 2):
        if (marks[a][1] ^ marks[b][1]).bit_count() <= bits:
            parent[find(a)] = find(b)
    groups = {}
    for i, (name, _) in enumerate(marks):
        groups.setdefault(find(i), []).append(name)
    least = {g: min((n for n in names if n is not None), default=None) for g, names in groups.items()}
    return sorted(((n, fp, least[find(i)]) for i, (n, fp) in enumerate(marks)), key=repr)


def test_awkward_rows(docs, awkward):
    marks = [(i, brute_fingerprint(t)) for i, t in awkward]
    out = simhash.near_duplicates(docs(awkward)).collect()
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in out), key=repr) == brute_groups(marks)


@pytest.mark.parametrize("flips", [1, 2, 3])
def test_code_meets_every_near_pair(flips):
    pick = random.Random(flips)
    code = simhash.Golay()
    a = np.array([pick.getrandbits(64) for _ in range(400)], np.uint64)
    b = np.array([int(x) ^ sum(1 << p for p in pick.sample(range(64), flips)) for x in a], np.uint64)
    stored, probed = [set() for _ in a], [set() for _ in a]
    for key, row, kept in simhash.keys_of(code, b.view(np.int64)):
        if kept:
            for k, r in zip(key.tolist(), row.tolist()):
                stored[r].add(k)
    for key, row, kept in simhash.keys_of(code, a.view(np.int64)):
        if not kept:
            for k, r in zip(key.tolist(), row.tolist()):
                probed[r].add(k)
    assert all(s & p for s, p in zip(stored, probed))


def test_code_is_perfect():
    code = simhash.Golay()
    words = np.arange(1 << 23)
    near = code.leader[code.syndrome(words)]
    assert np.bitwise_count(near.astype(np.uint64)).max() == 3
    assert len(np.unique(code.leader)) == 2048


def test_chains_dense_groups_and_buckets(spark):
    pick = random.Random(1)
    fps = {0}
    value = pick.getrandbits(64)
    for _ in range(60):  # a chain
        value ^= sum(1 << p for p in pick.sample(range(64), 3))
        fps.add(value)
    centre = pick.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(30), 2)}
    fps |= {pick.getrandbits(64) for _ in range(200)}
    marks = list(enumerate(sorted(fps)))
    signed = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in marks]
    nodes = spark.createDataFrame(signed, "id long, fp long")
    links = simhash.near_links(nodes, buckets=7)
    assert links.count() < 40 * len(marks)
    named = dict(components(links).collect())
    assert sorted((i, fp, named.get(i, i)) for i, fp in marks) == sorted(brute_groups(marks))


def test_stage_keeps_one_of_each_group(docs, prose):
    a = prose(1, 200)
    rows = [(3, a), (1, a), (1, a), (2, prose(2, 100)), (None, a), (4, None), (5, "")]
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == [1, 2, 4, None]
    assert simhash.keep_one(docs([])).collect() == []


def test_repeated_ids_with_other_texts(docs, prose):
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(7, a), (7, b), (8, b), (9, c), (7, a), (9, a), (10, b)]
    marks = [(i, brute_fingerprint(t)) for i, t in rows]
    out = simhash.near_duplicates(docs(rows)).collect()
    assert sorted(((r[0], r[1] & (1 << 64) - 1, r[2]) for r in out), key=repr) == brute_groups(marks)
    kept = simhash.keep_one(docs(rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(7, a), (7, b), (9, c)])


def test_two_fingerprints_under_one_id_keep_their_links(docs):
    marks = [(1, 0), (1, 0xFFFF), (2, 1), (3, 0xFFFE), (4, 0x7FFFFFFF0000)]
    spark = docs([]).sparkSession
    table = spark.createDataFrame(marks, "doc_id long, fp long")
    found = simhash.grouped(table, 3).collect()
    assert sorted((r["doc_id"], r["fp"], r["component_id"]) for r in found) == sorted(brute_groups(marks))
    assert len({r["group"] for r in found}) == 3


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:])), "a long, b long")
    assert {r["component"] for r in components(links).collect()} == {0}
