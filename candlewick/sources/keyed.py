"""Keyed tables as files with a manifest: a merge rewrites only the files that changes touch.

A table is a folder of parquet files and one manifest per version. The manifest names every
file of its version with the least and greatest key in it. A merge finds the files whose key
range holds a changed key, rewrites those, and publishes a manifest in which all other files
stand as before; they are neither read nor copied. Rows are laid out by key range, so a
batch of changes that lies together touches few files.

A manifest is written last and in one piece: a merge that dies leaves files that no version
names, and running it again is safe. Earlier versions stay readable. Keys must not be NULL and
are unique in the table; of several changes of a key the newest wins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.tables import dedupe_first
from candlewick.session import settle

FILE_ROWS = 1 << 20


def _manifest(root: str, version: int) -> str:
    return f"{root}/manifest/{version:08d}"


def _write(df: DataFrame, root: str, key: str, files: int) -> DataFrame:
    """Write rows by key range and return (path, lo, hi, rows) of the new files."""
    path = f"{root}/data/{uuid.uuid4().hex}"
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    # Reads the key column alone.
    return written.groupBy(F.input_file_name().alias("path")).agg(
        F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("rows")
    )


def _files(rows: int, file_rows: int) -> int:
    return max(1, -(-rows // file_rows))


def create(df: DataFrame, root: str, key: str, file_rows: int = FILE_ROWS) -> None:
    """Version 0 of a table."""
    _write(df, root, key, _files(df.count(), file_rows)).coalesce(1).write.parquet(_manifest(root, 0))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions; a folder without its success mark is none."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName()) for f in found or [])


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(path, lo, hi, rows) of the files of a version, by default the newest."""
    return spark.read.parquet(_manifest(root, versions(spark, root)[-1] if version is None else version))


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    # As many paths as the version has files.
    return spark.read.parquet(*[r["path"] for r in manifest(spark, root, version).select("path").collect()])


def merge(
    spark: SparkSession, root: str, changes: DataFrame, key: str, newest: str, file_rows: int = FILE_ROWS
) -> tuple[int, int]:
    """Publish the next version; returns (files rewritten, files carried over)."""
    last = versions(spark, root)[-1]
    files = manifest(spark, root, last)
    latest = dedupe_first(changes.withColumn("_order", -F.unix_micros(F.col(newest).cast("timestamp"))), [key], ["_order"])
    # Read several times below.
    latest = settle(latest.drop("_order"))
    keys = latest.select(key)
    # One row per file: ranges meet the changed keys in the tasks that hold these.
    inside = (F.col(key) >= F.col("lo")) & (F.col(key) <= F.col("hi"))
    touched = settle(keys.join(F.broadcast(files.select("path", "lo", "hi")), inside).select("path").distinct())
    paths = [r["path"] for r in touched.collect()]
    rows = latest
    if paths:
        # Changes are the small side; Spark broadcasts their keys if they measure small.
        old = spark.read.parquet(*paths).join(keys, key, "left_anti")
        rows = old.unionByName(latest.select(*old.columns))
    kept = files.join(touched, "path", "left_anti")
    n = files.join(touched, "path").agg(F.sum("rows")).first()[0] or 0
    made = _write(rows, root, key, _files(n + latest.count(), file_rows))
    made.unionByName(kept).coalesce(1).write.mode("overwrite").parquet(_manifest(root, last + 1))
    return len(paths), kept.count()
