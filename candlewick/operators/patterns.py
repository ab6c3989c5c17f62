"""Frequent itemsets, association rules and neighbouring-basket matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators.tables import ranked, top
from candlewick.session import settle

def encode(items: DataFrame) -> DataFrame:
    """One sorted, duplicate-free array per basket.

    Duplicates are dropped on (basket, item) first, so an array never holds more
    than the distinct items, however many rows a basket has. Rows move once: those of a
    basket meet before either step.
    """
    return (
        items.select("basket", "item")
        .repartition("basket")
        .distinct()
        .groupBy("basket")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )


def combination_counts(baskets: DataFrame, size: int) -> DataFrame:
    """Exact number of baskets holding each combination of ``size`` items.

    Combinations grow by position, are never held as a list, and go straight into a
    partial count, so the shuffle carries distinct combinations only.
    """
    sets = baskets.filter(F.size("items") >= size).select(
        "items", F.posexplode("items").alias("at", "item")
    ).select("items", "at", F.array("item").alias("chosen"))
    for _ in range(size - 1):
        later = F.sequence(F.col("at") + 1, F.size("items") - 1)
        sets = (
            sets.filter(F.col("at") + 1 < F.size("items"))
            .select("items", "chosen", F.explode(later).alias("at"))
            .select("items", "at", F.concat("chosen", F.array(F.get("items", F.col("at")))).alias("chosen"))
        )
    return sets.groupBy(F.col("chosen").alias("items")).agg(F.count(F.lit(1)).alias("freq"))


def itemsets(baskets: DataFrame, min_support: float) -> DataFrame:
    """Frequent itemsets of every size with their share of all baskets.

    Equal baskets are counted once and weighted, so mining follows the different baskets and
    not their number. Sets grow by a larger item of the same basket, one item a level; only
    baskets that hold a frequent set carry it on, and only by items that are frequent
    themselves. Counts are exact; there are as many levels as the largest frequent set has
    items, and one more.
    """
    kinds = settle(baskets.groupBy("items").agg(F.count(F.lit(1)).alias("n")))
    total = kinds.select(F.sum("n")).first()[0] or 0
    rows = kinds.select("items", "n", F.posexplode("items").alias("at", "item")).select(
        "items", "n", "at", F.array("item").alias("chosen")
    )
    found: DataFrame | None = None
    while True:
        # Support as a quotient, as it is returned.
        level = settle(
            rows.groupBy("chosen")
            .agg(F.sum("n").alias("freq"))
            .withColumn("support", F.col("freq") / F.lit(total))
            .filter(F.col("support") >= min_support)
        )
        if found is not None and level.isEmpty():
            break
        if found is None:
            found = level
            rows = _of_frequent_items(kinds, level)
        else:
            found = found.unionByName(level)
            rows = rows.join(level.select("chosen"), "chosen", "left_semi")
        rows = (
            rows.filter(F.col("at") + 1 < F.size("items"))
            .select("items", "n", "chosen", F.explode(F.sequence(F.col("at") + 1, F.size("items") - 1)).alias("at"))
            .select("items", "n", "at", F.concat("chosen", F.array(F.get("items", F.col("at")))).alias("chosen"))
        )
    return found.withColumnRenamed("chosen", "items")


def _of_frequent_items(kinds: DataFrame, level: DataFrame) -> DataFrame:
    """Baskets cut to their frequent items, equal ones counted together, one row per item."""
    frequent = level.select(F.get("chosen", F.lit(0)).alias("item"))
    keyed = kinds.withColumn("id", F.monotonically_increasing_id())
    cut = settle(
        settle(keyed.select("id", "n", F.explode("items").alias("item")))
        .join(frequent, "item")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .groupBy("items")
        .agg(F.sum("n").alias("n"))
    )
    return cut.select("items", "n", F.posexplode("items").alias("at", "item")).select(
        "items", "n", "at", F.array("item").alias("chosen")
    )


def by_size(sets: DataFrame, size: int) -> DataFrame:
    return sets.filter(F.size("items") == size)


def rules(sets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """All rules X -> Z minus X of the frequent sets Z, any split into two parts.

    Consequents grow by one item a level. A larger consequent leaves a smaller antecedent,
    which is no rarer, so confidence only falls: a consequent is tried only if the two it is
    joined from (the same items but for the last) reached ``min_confidence``. What is built
    follows the rules found, not the subsets of the sets. The lookups are equi-joins on the
    sorted arrays; the number of levels is that of the largest set.
    """
    sets = settle(sets)
    known = sets.select(F.col("items").alias("antecedents"), F.col("support").alias("sx"))
    tried = sets.filter(F.size("items") > 1).select(
        "items", "support", F.explode("items").alias("y")
    ).select("items", "support", F.array("y").alias("consequents"))
    found: DataFrame | None = None
    while True:
        level = settle(
            tried.withColumn("antecedents", F.array_except("items", "consequents"))
            .join(known, "antecedents")
            .withColumn("confidence", F.col("support") / F.col("sx"))
            .filter(F.col("confidence") >= min_confidence)
        )
        if found is not None and level.isEmpty():
            break
        found = level if found is None else found.unionByName(level)
        tried = _grown(level)
    known_y = sets.select(F.col("items").alias("consequents"), F.col("support").alias("sy"))
    return found.join(known_y, "consequents").select(
        "antecedents",
        "consequents",
        "support",
        "confidence",
        (F.col("confidence") / F.col("sy")).alias("lift"),
        (F.col("support") - F.col("sx") * F.col("sy")).alias("leverage"),
        F.try_divide(1 - F.col("sy"), 1 - F.col("confidence")).alias("conviction"),
    )


def _grown(level: DataFrame) -> DataFrame:
    """Consequents one item longer: pairs of one set that differ in their last item only.

    A set's own items bound the tails that share a prefix.
    """
    last = F.element_at("consequents", -1)
    head = F.slice("consequents", F.lit(1), F.size("consequents") - 1)
    return (
        level.groupBy("items", "support", head.alias("head"))
        .agg(F.array_sort(F.collect_list(last)).alias("tails"))
        .filter((F.size("tails") > 1) & (F.size("items") > F.size("head") + 2))
        .select("items", "support", "head", "tails", F.posexplode("tails").alias("at", "a"))
        .filter(F.col("at") + 1 < F.size("tails"))
        .select("items", "support", "head", "a", F.explode(F.slice("tails", F.col("at") + 2, F.size("tails"))).alias("b"))
        .select("items", "support", F.concat("head", F.array("a", "b")).alias("consequents"))
    )


def significant(found: DataFrame, confidence: float, lift: float, support: float) -> DataFrame:
    return found.filter(
        (F.col("confidence") > confidence) & (F.col("lift") > lift) & (F.col("support") > support)
    )


def rule_items(found: DataFrame) -> DataFrame:
    """Items that occur on the left of a rule."""
    return found.select(F.explode("antecedents").alias("item")).distinct()


def item_pool(sets: DataFrame, k: int = 6) -> DataFrame:
    """Items of the k best itemsets, pairs and triplets with a score.

    An item scores 2 per listed pair and 3 per listed triplet it belongs to.
    """
    sets = settle(sets)
    parts = [(sets, 0), (by_size(sets, 2), 2), (by_size(sets, 3), 3)]
    listed: DataFrame | None = None
    for part, points in parts:
        best = top(part, k, "freq", "items").select("items", F.lit(points).alias("points"))
        listed = best if listed is None else listed.unionByName(best)
    return (
        listed.select(F.explode("items").alias("item"), "points")
        .groupBy("item")
        .agg(F.sum("points").alias("weight"))
    )


def repeats_in_neighbours(
    items: DataFrame, reach: int = 4, direction: str = "next", block: int = 1 << 16
) -> DataFrame:
    """For each basket, which of its items occur in the ``reach`` neighbouring baskets.

    Baskets, whose ids may be of any ordered type, get a global sequence number from
    counts per range of ids. An item's
    occurrences are then compared with the one right after (or before) it inside
    blocks of the sequence; a block also receives the ``reach`` sequence numbers
    beyond its edge, so a popular item is spread over all blocks.
    """
    if direction not in ("next", "previous"):
        raise ValueError(f"direction must be 'next' or 'previous', not {direction!r}")
    baskets = ranked(items, "basket", "seq")
    rows = items.select("basket", "item").distinct().join(baskets, "basket")
    ahead = direction == "next"
    edge = F.col("seq") % block < reach if ahead else F.col("seq") % block >= block - reach
    blk = F.expr(f"seq div {block}")
    own = F.struct(blk.alias("b"), F.lit(False).alias("copy"))
    other = F.struct((blk - 1 if ahead else blk + 1).alias("b"), F.lit(True).alias("copy"))
    rows = rows.withColumn("p", F.explode(F.when(edge, F.array(own, other)).otherwise(F.array(own))))
    rows = rows.select("basket", "item", "seq", "p.b", "p.copy")
    w = Window.partitionBy("item", "b").orderBy("seq")
    gap = F.lead("seq").over(w) - F.col("seq") if ahead else F.col("seq") - F.lag("seq").over(w)
    hit = F.when(F.col("gap") <= reach, F.col("item"))
    return (
        rows.withColumn("gap", gap)
        .filter(~F.col("copy"))
        .groupBy("basket")
        .agg(
            F.count(hit).alias("appearances"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(hit)), lambda x: x.cast("string")), ", "
            ).alias("matching_items"),
        )
    )


def recent_hits(items: DataFrame, candidates: list[int], n: int = 4) -> DataFrame:
    """How often each candidate occurs in the last n baskets."""
    last = items.select("basket").distinct().orderBy(F.desc("basket")).limit(n)
    wanted = items.sparkSession.createDataFrame([(c,) for c in candidates], "item int")
    hits = items.join(last, "basket").select("basket", "item").distinct()
    total = last.select(F.count(F.lit(1)).alias("n")).scalar()
    return (
        wanted.join(hits, "item", "left")
        .groupBy("item")
        .agg(F.count("basket").alias("hits"))
        .withColumn("percentage", F.col("hits") / total * 100)
    )
