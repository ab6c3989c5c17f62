"""Intermediate tables in the shared folder, so lost executors re-read instead of recomputing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.session import checkpoint_root

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Texts can be long: a batch to Python is bounded by rows and by bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
    # Shuffle files go when their query has ended; what is needed later is a table.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the cluster."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back: this cuts the lineage and fixes row placement."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a kept table that no later step reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the text never NULL; other columns, whatever their names, are left out."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )


def unused(taken: list[str], *names: str) -> list[str]:
    """The names with as many underscores in front as none of the ``taken`` columns has."""
    lead, low = "_", {t.lower() for t in taken}
    while any(lead + n in low for n in names):
        lead += "_"
    return [lead + n for n in names]
