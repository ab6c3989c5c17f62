"""Session construction and the few runtime settings the operators rely on."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Beyond small files, a broadcast is chosen from sizes measured at run time.
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
}

# Read once when the JVM starts. Tracing every column expression back to its call
# site costs a round trip each, which adds up in wide indicator tables.
STARTUP = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for name, value in RUNTIME.items():
        spark.conf.set(name, value)
    return spark


def build(app: str = "candlewick", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or get) a session; cluster sizing is left to the submitter."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**STARTUP, **RUNTIME, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream state.

    The cluster names it in ``spark.checkpoint.dir`` or has set it on the context. Only a
    session running in one process on one machine may fall back to a local folder, which
    goes when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="candlewick-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(
    df: DataFrame, schema: StructType | None = None, by: Sequence[str] = (), **options: str
) -> DataFrame:
    """Write a small table that later steps read repeatedly to shared storage.

    Cuts the lineage: lost executors re-read the files instead of recomputing. As parquet
    the table keeps its columns, so later scans prune and have sizes to plan with. A
    ``schema`` reads the same files as other types of the same layout; rows that differ in
    the columns ``by`` lie in different folders, and ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/settled-{uuid.uuid4().hex}"
    df.write.options(**options).partitionBy(*by).parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove a settled table that no later step reads."""
    spark = df.sparkSession
    for path in {re.sub(r"(/settled-\w+)/.*", r"\1", f) for f in df.inputFiles()}:
        remove(spark, path)
