"""Row selection: splits, de-duplication, unpivot, upsert, sampling."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.functions.columns import unit_hash
from candlewick.operators.series import HALO, RN, Series
from candlewick.session import settle


def chrono_split(s: Series, train: float = 0.8) -> DataFrame:
    """Tag the first part of each series 'train', the rest 'test' (rounded up)."""
    if s.lookback is None:
        s = s.add({"_n": F.count(F.lit(1)).over(Window.partitionBy(*s.key))})
    else:
        sizes = s.df.filter(~F.col(HALO)).groupBy(*s.key).agg(F.count(F.lit(1)).alias("_n"))
        s = replace(s, df=s.df.join(sizes, list(s.key)))
    test = F.ceil(F.col("_n") * F.lit(str(round(1 - train, 9))).cast("decimal(10,9)"))
    part = F.when(F.col(RN) < F.col("_n") - test, "train").otherwise("test")
    return s.add({"part": part}).rows("_n")


def hash_split(df: DataFrame, key: str, tenths: int = 8) -> DataFrame:
    """Random split decided by a hash of the key: stable across runs and engines."""
    word = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10)
    part = F.when(word.cast("long") % 10 < tenths, "train").otherwise("test")
    return df.withColumn("part", part)


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate rather than a ranking window, so copies of a hot key collapse
    before the shuffle. ``order`` plus the row itself breaks ties.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*order, *[c for c in rest if c not in order])
    return (
        df.groupBy(*keys)
        .agg(F.min(ranked).alias("_first"))
        .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def select_keys(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs in another table."""
    return df.join(chosen.select(*keys), keys, "left_semi")


def melt(df: DataFrame, ids: list[str], values: list[str], var: str, value: str) -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, values, var, value)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Merge changes into a table: the newest row per key wins, new keys are added.

    Returns the merged table; write it to a new path, never over its own input.
    Stacking and one aggregate replace a full outer join, and repeated changes of
    one key collapse on the map side.
    """
    both = current.withColumn("_src", F.lit(0)).unionByName(changes.withColumn("_src", F.lit(1)))
    rest = [c for c in current.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("_src", version))
    return (
        both.groupBy(*keys)
        .agg(newest.alias("_new"))
        .select(*keys, *[F.col(f"_new.{c}").alias(c) for c in rest])
        .select(*current.columns)
    )


def top(df: DataFrame, k: int, by: str, *tie: str) -> DataFrame:
    """The k largest rows; ties resolved by the ``tie`` columns, ascending."""
    return df.orderBy(F.desc(by), *[F.asc(t) for t in tie]).limit(k)


def weighted_pick(df: DataFrame, item: str, weight: str, k: int, seed: int = 42) -> DataFrame:
    """k items without replacement, chance proportional to weight.

    Each item draws the key -ln(u) / weight with u a hash of (seed, item); the k
    smallest keys win (Efraimidis and Spirakis 2006). Weightless items come last.
    """
    u = unit_hash(F.lit(seed), F.col(item))
    draw = F.try_divide(-F.log(u), F.col(weight).cast("double"))
    return (
        df.withColumn("draw_key", draw)
        .orderBy(F.asc_nulls_last("draw_key"), F.asc(item))
        .limit(k)
    )


def weighted_pick_replace(
    df: DataFrame, item: str, weight: str, k: int, seed: int = 42
) -> DataFrame:
    """k independent draws (draw, item), chance proportional to weight.

    Items lie side by side, each as long as its weight, in item order; a draw is a point, and
    the item it falls on is taken. Running sums of two levels place the items: one total per
    range of items, then sums inside a range. A draw finds its range among those totals and
    its item in one sort of the range's items and points, so items + k rows are handled.
    """
    items = df.filter(F.col(weight) > 0).select(
        F.col(item).alias("item"), F.col(weight).cast("double").alias("w")
    ).repartitionByRange("item")
    items = settle(items.withColumn("range", F.spark_partition_id()))
    # One row per range of items.
    sums = items.groupBy("range").agg(F.sum("w").alias("w"))
    ranges = sums.select(F.array_sort(F.collect_list(F.struct("range", "w"))).alias("r"))
    upto = F.aggregate(
        "r",
        F.array(F.lit(0.0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["w"])),
    )
    bounds = settle(ranges.select(F.col("r")["range"].alias("ranges"), upto.alias("upto")))
    point = unit_hash(F.lit(seed), F.col("draw")) * F.element_at("upto", -1)
    # `bounds` is a single row.
    draws = (
        df.sparkSession.range(1, k + 1)
        .select(F.col("id").cast("int").alias("draw"))
        .join(F.broadcast(bounds.filter(F.size("ranges") > 0)))
        .withColumn("at", point)
        .withColumn("before", F.size(F.filter("upto", lambda x: x <= F.col("at"))))
        .select(
            "draw",
            F.get("ranges", F.col("before") - 1).alias("range"),
            (F.col("at") - F.get("upto", F.col("before") - 1)).alias("at"),
        )
    )
    before = Window.partitionBy("range").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    starts = items.select("range", "item", F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("at"))
    every = starts.unionByName(draws, allowMissingColumns=True)
    # An item's start comes before a point at the same place.
    line = Window.partitionBy("range").orderBy("at", F.col("draw").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        every.withColumn("item", F.last("item", ignorenulls=True).over(line))
        .filter(F.col("draw").isNotNull())
        .select("draw", F.col("item").alias(item))
    )


def fixed_counts(df: DataFrame, column: str, labels: list[str], name: str = "n") -> DataFrame:
    """Rows per label of a fixed list; labels without rows count 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(x,) for x in labels], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias(name))
    return grid.join(counts, column, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): the distinct values and their rank in sorted order, from 0.

    The values are range-partitioned and numbered inside their ranges; what comes before a
    range is one count per range, so no task sees more than a range.
    """
    levels = df.select(column).distinct().na.drop().repartitionByRange(column)
    levels = settle(levels.select(column, F.spark_partition_id().alias("_range")))
    counts = levels.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(column)) - 1
    return (
        levels.withColumn("_rank", rank)
        .join(starts, "_range")
        .select(column, (F.col("_start") + F.col("_rank")).alias(name))
    )


def quantile_disc(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row (value): the least value with at least a share ``q`` of the rows at or below it.

    Values are range-partitioned and counted per range; only the range that holds the place is
    sorted, so no task sees more than a range.
    """
    values = df.select(F.col(column).alias("value")).na.drop().repartitionByRange("value")
    values = settle(values.withColumn("_range", F.spark_partition_id()))
    # One row per range.
    counts = values.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_range"))
    place = F.greatest(F.ceil(F.sum("_n").over(Window.partitionBy()) * F.lit(q)), F.lit(1))
    chosen = counts.select("_range", "_n", upto.alias("_upto"), place.alias("_place")).filter(
        (F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place"))
    ).select("_range", (F.col("_place") - F.col("_upto") + F.col("_n")).alias("_at"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("value"))
    return (
        values.join(F.broadcast(chosen), "_range")
        .withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_at"))
        .select("value")
    )


def label_encode(df: DataFrame, column: str, name: str) -> DataFrame:
    """Replace a category by its rank in sorted order, from 0.

    Rows without a category keep a NULL code.
    """
    return df.join(ranked(df, column, name), column, "left")


def recent_period(df: DataFrame, column: str, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (default: the newest value)."""
    anchor = as_of if as_of is not None else df.select(F.max(column).alias("m")).scalar()
    return df.filter(F.col(column) >= F.date_sub(anchor, days))
