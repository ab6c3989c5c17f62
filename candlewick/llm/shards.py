"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map.

A record hashes to one of thousands of slots for good; only the map from slots to shards
changes. Bytes are summed per slot, so a rebalance looks at one row per slot however many
records there are, and edits the map only where a shard holds more than its share.

Everything is DataFrame functions. The only broadcast is the map, whose size is the slot
count. Records are numbered inside their slot, and slots inside their shard through
sums, so no shard is sorted as a whole.

NULL text has no bytes. NULL ids share one slot. Repeated rows are numbered one by one.
An empty table gives an empty result. A very long text counts with its whole size, which no
shard divides. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candlewick.llm import store

SLOTS = 8192


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots dealt round."""
    return spark.range(slots).select(
        F.lit(0).alias("version"),
        F.col("id").cast("int").alias("slot"),
        (F.col("id") % shards).cast("int").alias("shard"),
    )


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows per slot, summed before the shuffle."""
    return records.groupBy("slot").agg(
        F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def rebalance(mapping: DataFrame, usage: DataFrame, shards: int) -> DataFrame:
    """The next version of the map for ``shards`` shards of nearly equal bytes.

    A shard keeps its largest slots as long as they fit its share; what is over is placed,
    largest first, on the shard that is then the lightest. Works on one row per slot.
    """
    used = mapping.join(F.broadcast(usage), "slot", "left").select(
        "version", "slot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")
    )
    whole = Window.partitionBy()
    inside = Window.partitionBy("shard").orderBy(F.desc("bytes"), "slot")
    marked = used.withColumns(
        {
            "fair": F.sum("bytes").over(whole) / shards,
            "filled": F.sum("bytes").over(inside),
        }
    ).withColumn("stays", (F.col("filled") <= F.col("fair")) & (F.col("shard") < shards))
    state = marked.agg(
        F.max("version").alias("version"),
        F.collect_list(F.when(F.col("stays"), F.struct("slot", "shard", "bytes"))).alias("stays"),
        F.sort_array(
            F.collect_list(F.when(~F.col("stays"), F.struct("bytes", "slot"))), asc=False
        ).alias("moves"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(
            "stays",
            F.lit(0).cast("long"),
            lambda total, x: total + F.when(x["shard"] == s, x["bytes"]).otherwise(0),
        ),
    )

    def place(acc: Column, slot: Column) -> Column:
        lightest = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(
            F.transform(
                acc["loads"],
                lambda v, s: F.when(s == lightest, v + slot["bytes"]).otherwise(v),
            ).alias("loads"),
            F.concat(acc["out"], F.array(lightest)).alias("out"),
        )

    placed = F.aggregate(
        "moves",
        F.struct(F.col("loads"), F.array().cast("array<int>").alias("out")),
        place,
        lambda acc: acc["out"],
    )
    rows = state.withColumn("loads", loads).withColumn("out", placed)
    stayed = F.transform("stays", lambda x: F.struct(x["slot"].alias("slot"), x["shard"].alias("shard")))
    moved = F.transform(
        "moves", lambda x, i: F.struct(x["slot"].alias("slot"), F.get("out", i).alias("shard"))
    )
    return rows.select(
        (F.col("version") + 1).alias("version"), F.inline(F.concat(stayed, moved))
    )


def publish(mapping: DataFrame, root: str) -> None:
    """Add a version to the stored map; earlier versions stay readable."""
    mapping.coalesce(1).write.partitionBy("version").mode("append").parquet(root)


def load_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    schema = "slot int, shard int, version int"
    return spark.read.schema(schema).parquet(root).filter(F.col("version") == version)


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """One narrow row per record: no text leaves the scan."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        slot_of(F.col("doc_id").cast("long"), slots).alias("slot"),
    )


def assign(records: DataFrame, usage: DataFrame, mapping: DataFrame) -> DataFrame:
    """``shard`` and the record's ``place`` in it, gapless from 0."""
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    layout = (
        mapping.join(F.broadcast(usage), "slot")
        .withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .select("slot", "shard", "start")
    )
    rank = Window.partitionBy("slot").orderBy("doc_id", "text_crc32", "size")
    return (
        records.withColumn("rank", F.row_number().over(rank) - 1)
        .join(F.broadcast(layout), "slot")
        .withColumn("place", F.col("start") + F.col("rank"))
        .drop("start", "rank")
    )


def shard(docs: DataFrame, shards: int = 24, slots: int = SLOTS) -> DataFrame:
    """Shards of nearly equal bytes; publishes map version 0 and its first rebalance."""
    spark = docs.sparkSession
    records = sized(docs, slots)
    usage = store.keep(slot_bytes(records), "slot-bytes")
    root = store.folder(spark, "slot-map")
    publish(first_map(spark, shards, slots), root)
    publish(rebalance(load_map(spark, root, 0), usage, shards), root)
    return assign(records, usage, load_map(spark, root, 1).select("slot", "shard"))
