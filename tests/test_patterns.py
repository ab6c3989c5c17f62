from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import patterns


def items(spark, baskets, repeat=1):
    rows = [(k, i) for k, b in baskets.items() for i in b] * repeat
    return spark.createDataFrame(rows, "basket bigint, item int")


def counts(df):
    return {tuple(r["items"]): r.freq for r in df.collect()}


SMALL = {1: [1, 2, 3], 2: [2, 1], 3: [3, 2]}


def test_supports_and_rules(spark):
    src = items(spark, SMALL, repeat=3)
    sets = patterns.itemsets(patterns.encode(src), 0.0001)
    assert counts(sets) == {(1,): 2, (2,): 3, (3,): 2, (1, 2): 2, (1, 3): 1, (2, 3): 2, (1, 2, 3): 1}
    found = {
        (tuple(r.antecedents), tuple(r.consequents)): r
        for r in patterns.rules(sets, 0.2).collect()
    }
    assert len(found) == 12
    sure = found[((1,), (2,))]
    assert sure.confidence == 1.0 and sure.conviction is None and sure.lift == 1.0
    wide = found[((2,), (1, 3))]
    assert wide.confidence == pytest.approx(1 / 3)
    assert wide.leverage == pytest.approx(1 / 3 - 1 * 1 / 3)
    weak = found[((1,), (3,))]
    assert weak.conviction == pytest.approx((1 - 2 / 3) / (1 - 0.5))
    strong = patterns.significant(patterns.rules(sets), 0.9, 0.99, 0.5)
    assert {r.item for r in patterns.rule_items(strong).collect()} == {1, 3}


def test_combinations_with_one_huge_basket(spark):
    rng = np.random.default_rng(1)
    baskets = {k: rng.choice(30, rng.integers(0, 6), replace=False).tolist() for k in range(60)}
    baskets[99] = list(range(30))
    for size in (1, 2, 3):
        want = Counter(c for b in baskets.values() for c in combinations(sorted(b), size))
        got = patterns.combination_counts(patterns.encode(items(spark, baskets)), size)
        assert counts(got) == dict(want)


def test_rare_items_are_in_no_set(spark):
    sets = patterns.itemsets(patterns.encode(items(spark, SMALL | {4: [9]})), 0.5)
    assert counts(sets) == {(1,): 2, (2,): 3, (3,): 2, (1, 2): 2, (2, 3): 2}


def test_sets_and_rules_have_no_size_limit(spark):
    sets = patterns.itemsets(patterns.encode(items(spark, {1: range(7), 2: range(7), 3: [0]})), 0.5)
    assert counts(sets) == {
        c: 3 if c == (0,) else 2 for size in range(1, 8) for c in combinations(range(7), size)
    }
    assert patterns.rules(sets, 0.1).count() == sum(2**n * k - 2 * k for n, k in enumerate([0, 0, 21, 35, 35, 21, 7, 1]))


def test_item_pool(spark):
    pool = patterns.item_pool(patterns.itemsets(patterns.encode(items(spark, SMALL)), 0.0001), 2)
    assert {r.item: r.weight for r in pool.collect()} == {1: 2 + 3, 2: 2 + 2 + 3, 3: 2 + 3}


@pytest.mark.parametrize("direction", ["next", "previous"])
@pytest.mark.parametrize("block", [4, 5, 1 << 16])
def test_neighbours_against_loop(spark, direction, block):
    rng = np.random.default_rng(3)
    keys = sorted(rng.choice(500, 40, replace=False).tolist())
    baskets = {k: rng.choice(12, 3, replace=False).tolist() for k in keys}
    got = patterns.repeats_in_neighbours(items(spark, baskets), 4, direction, block).collect()
    assert len(got) == 40
    for r in got:
        i = keys.index(r.basket)
        near = keys[i + 1 : i + 5] if direction == "next" else keys[max(0, i - 4) : i]
        seen = {x for k in near for x in baskets[k]}
        want = sorted(set(baskets[r.basket]) & seen)
        assert r.appearances == len(want)
        assert r.matching_items == ", ".join(map(str, want))


def test_neighbour_direction_is_checked(spark):
    with pytest.raises(ValueError):
        patterns.repeats_in_neighbours(items(spark, SMALL), 4, "sideways")


def test_recent_hits(spark):
    got = patterns.recent_hits(items(spark, SMALL), [1, 2, 7], 2).collect()
    assert {r.item: (r.hits, r.percentage) for r in got} == {1: (1, 50.0), 2: (2, 100.0), 7: (0, 0.0)}


def test_encode_sorts_and_drops_repeats(spark):
    out = patterns.encode(items(spark, {1: [3, 1, 3]}, 2)).select(F.to_json(F.struct("items"))).first()[0]
    assert out == '{"items":[1,3]}'


def test_rules_of_a_large_set_follow_what_passes(spark):
    """25 items have 33 million subsets; with two confident consequents three rules are found."""
    items = list(range(25))
    rows = [(items, 0.1)] + [([x for x in items if x != i], 0.12 if i < 2 else 0.9) for i in items]
    rows += [(items[2:], 0.15), ([0], 0.5), ([1], 0.5), ([0, 1], 0.4)]
    sets = spark.createDataFrame(rows, "items array<int>, support double")
    got = {tuple(r.consequents): r for r in patterns.rules(sets, 0.6).collect() if len(r.antecedents) > 22}
    assert set(got) == {(0,), (1,), (0, 1)}
    assert got[(0, 1)].antecedents == items[2:] and abs(got[(0, 1)].confidence - 0.1 / 0.15) < 1e-12


def test_no_rules_without_pairs(spark):
    sets = spark.createDataFrame([([1], 0.5)], "items array<int>, support double")
    assert patterns.rules(sets).collect() == []


def test_neighbours_of_named_baskets(spark):
    rows = [("monday", 1), ("tuesday", 1), ("a", 1), ("b", 2), ("c", 2)]
    items = spark.createDataFrame(rows, "basket string, item int")
    df = patterns.repeats_in_neighbours(items, 1, "next")
    assert {r.basket: r.appearances for r in df.collect()} == {"a": 0, "b": 1, "c": 0, "monday": 1, "tuesday": 0}


def test_rule_items_leave_no_lifting_rule_out(spark, data):
    from candlewick.plans import pattern_queries as q

    found = patterns.rules(q._sets(spark, data), q.MIN_CONFIDENCE)
    wide = found.filter((F.col("confidence") > 0.2) & (F.col("lift") > 1) & (F.col("support") > 0.0001))
    want = {i for r in wide.select("antecedents").collect() for i in r.antecedents}
    assert want and {r["item"] for r in q.rule_items(spark, data).collect()} == want


def test_equal_baskets_are_mined_once(spark, monkeypatch):
    written = []

    def kept(df):
        out = settle(df)
        written.append(out.count())
        return out

    settle = patterns.settle
    monkeypatch.setattr(patterns, "settle", kept)
    many = {k: [1, 2] if k % 2 else [2, 3, 9] for k in range(500)} | {1000: [5]}
    sets = patterns.itemsets(patterns.encode(items(spark, many)), 0.01)
    assert counts(sets) == {
        (1,): 250, (2,): 500, (3,): 250, (9,): 250, (1, 2): 250, (2, 3): 250, (2, 9): 250, (3, 9): 250, (2, 3, 9): 250,
    }
    assert written and max(written) <= 10


def test_itemsets_against_loop(spark):
    rng = np.random.default_rng(5)
    baskets = {k: rng.choice(14, rng.integers(1, 8), replace=False).tolist() for k in range(200)}
    want = Counter(c for b in baskets.values() for n in range(1, 8) for c in combinations(sorted(b), n))
    for support in (0.0001, 0.02, 0.1, 1.0):
        got = counts(patterns.itemsets(patterns.encode(items(spark, baskets)), support))
        assert got == {c: n for c, n in want.items() if n / 200 >= support}
    assert patterns.itemsets(patterns.encode(items(spark, {})), 0.1).collect() == []


def test_rows_of_a_basket_move_once(spark):
    plan = patterns.encode(items(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
