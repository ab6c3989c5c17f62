"""Analysis views over the base parquet tables.

Every view is a lazy DataFrame: Catalyst prunes it to the columns a query uses.
Money sums go through DECIMAL so a retried or re-ordered task gives the same bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core when a scan yields fewer splits than the cluster has slots.

    Heavy per-row work on one unsplittable file would otherwise run in one task.
    A scan that already fills the cluster is returned as it is.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


def exact_sum(column: str) -> Column:
    """Order-independent sum of a two-decimal double."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")


def bars(spark: SparkSession, root: str) -> DataFrame:
    """Daily bars, one row per (symbol, d).

    The partial aggregate collapses a hot symbol to one row per day before the
    shuffle, so a series is never longer than the calendar it covers.
    """
    return (
        table(spark, root, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("symbol"),
            F.col("o_orderdate").cast("date").alias("d"),
        )
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
            exact_sum("o_totalprice").alias("market_cap"),
        )
    )


def peg_bars(spark: SparkSession, root: str) -> DataFrame:
    """Bars whose prices hover around 1.0."""
    disc = F.col("l_discount").cast("decimal(18,2)")
    return (
        table(spark, root, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("symbol"),
            F.col("l_shipdate").cast("date").alias("d"),
        )
        .agg(
            (F.max("l_discount") + 0.95).alias("high"),
            (F.min("l_discount") + 0.95).alias("low"),
            F.round(F.sum(disc).cast("double") / F.count(F.lit(1)) + 0.95, 6).alias("close"),
            exact_sum("l_quantity").alias("volume"),
            (exact_sum("l_quantity") + 1000).alias("market_cap"),
        )
    )


def ticks(spark: SparkSession, root: str) -> DataFrame:
    """Raw observations: many rows per symbol and instant, length unbounded."""
    return table(spark, root, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        "value",
    )


def basket_items(spark: SparkSession, root: str) -> DataFrame:
    """(basket, item) rows, one per line; the operators drop repeats themselves."""
    part = table(spark, root, "part").select(
        "p_partkey", F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int").alias("item")
    )
    return (
        table(spark, root, "lineitem")
        .select("l_orderkey", "l_partkey")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("l_orderkey").alias("basket"), "item")
    )


def news(spark: SparkSession, root: str) -> DataFrame:
    """Articles with a publication day."""
    documents = table(spark, root, "documents").select("doc_id", "source", "lang", "text")
    return spread(documents, "doc_id").select(
        "doc_id",
        "source",
        "lang",
        "text",
        F.expr("date_add(DATE'2024-01-01', cast(doc_id % 30 as int))").alias("article_date"),
    )


def valence(token: Column) -> Column:
    """Stand-in valence of an invented word: one hex digit of its hash, centred.

    Digits 4 to b mean the word carries no sentiment (NULL).
    """
    first = F.substring(F.md5(token.cast("binary")), 1, 1)
    digit = F.instr(F.lit("0123456789abcdef"), first) - 1
    return F.when((digit < 4) | (digit > 11), (digit - 7.5) / 2)


def lexicon(tokens: DataFrame) -> DataFrame:
    """(token, valence) table of the sentiment-bearing words among ``tokens``."""
    return (
        tokens.select("token")
        .distinct()
        .withColumn("valence", valence(F.col("token")))
        .filter(F.col("valence").isNotNull())
    )


def risk_customers(spark: SparkSession, root: str) -> DataFrame:
    """One row per customer with the attributes the risk rules read."""
    volume = (
        table(spark, root, "orders")
        .groupBy("o_custkey")
        .agg(exact_sum("o_totalprice").alias("v"))
    )
    nation = table(spark, root, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        table(spark, root, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(volume, F.col("c_custkey") == F.col("o_custkey"), "left")
        .select(
            F.col("c_custkey").alias("id"),
            (F.col("c_custkey") % 70 + 18).cast("int").alias("age"),
            "country",
            F.col("c_mktsegment").alias("job_title"),
            F.col("c_acctbal").alias("balance"),
            F.coalesce("v", F.lit(0.0)).alias("volume"),
        )
    )
