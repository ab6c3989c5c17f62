"""Connected components of a link table by alternating star contraction.

Each round points every node's larger neighbours at its smallest one (large star), then its
smaller ones (small star). Links never outnumber the input, rounds grow with the logarithm
of the longest chain, and every round is a written table. Repeated links count once; without
links there are no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlewick.llm import store


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b"), F.col("a"))).toDF("u", "v")
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    low = links.groupBy("b").agg(F.min("a").alias("m"))
    others = links.join(low, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return others.union(low.select(F.col("m").alias("a"), F.col("b")))


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every node of ``links`` (a, b); the component is its smallest id."""
    low = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    now = store.keep(links.filter("a <> b").select(*low).distinct(), "links")
    mark = None
    while True:
        new = store.keep(_small(_large(now).distinct()).distinct(), "links")
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        store.forget(now)
        now = new
        if tuple(state) == mark:
            break
        mark = tuple(state)
    heads = now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(heads)
