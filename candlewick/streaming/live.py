"""Bars and threshold signals from a growing folder of ticks."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.functions.columns import trade_signal
from candlewick.operators.series import RN, Recurrence, blocked, recurrences, share_blocks
from candlewick.session import checkpoint_root, remove

TICK_SCHEMA = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
)


def tick_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Ticks of a table as they arrive: a folder of parts, or one file."""
    reader = spark.readStream.schema(TICK_SCHEMA)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target) and store.getFileStatus(target).isFile():
        # A stream wants a folder or a pattern; this pattern names the one file.
        path = f"{path[:-1]}[{path[-1]}]"
    return reader.parquet(path).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        "value",
    )


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run's output and checkpoint, on shared storage."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def stream_bars(ticks: DataFrame, folder: str, late: str = "10 minutes") -> DataFrame:
    """Daily bars from a tick stream; returns them once the waiting files are read.

    Every trigger writes the bars it changed under its own batch number, so a
    repeated batch replaces itself; the newest version of a bar is the bar.
    """
    bar = F.window("ts", "1 day")
    at = F.struct("ts", "event_id")
    bars = (
        ticks.withWatermark("ts", late)
        .groupBy(bar.alias("w"), "symbol")
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select("symbol", F.col("w.start").cast("date").alias("d"), "open", "high", "low", "close", "volume")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/bars/batch={number}")

    # Without any tick there is no batch; the empty table is there all the same.
    spark = ticks.sparkSession
    spark.createDataFrame([], bars.schema).write.mode("overwrite").parquet(f"{folder}/bars/batch=-1")
    _run(bars.writeStream.outputMode("update"), write, folder)
    versions = spark.read.parquet(f"{folder}/bars")
    fields = ["open", "high", "low", "close", "volume"]
    return (
        versions.groupBy("symbol", "d")
        .agg(F.max_by(F.struct(*fields), "batch").alias("bar"))
        .select("symbol", "d", "bar.*")
    )


def _run(writer, write, folder: str) -> None:
    query = (
        writer.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


SIGNALS = (
    "event_id bigint, ts timestamp, symbol string, value double, forecast double, position bigint, signal string"
)


def stream_signals(
    ticks: DataFrame,
    folder: str,
    buy_at: float,
    sell_at: float,
    span: int = 14,
    block_rows: int = 1 << 16,
    late: int | None = None,
) -> DataFrame:
    """Running exponential mean per symbol as one-step forecast, with its signal.

    A mean's end value is affine in its start value, so a micro-batch is scanned
    in row blocks like any long series and then shifted by what the batch before
    left behind: one hot symbol does not end up in one task. State is one row per
    symbol, written per batch number, which makes a repeated batch harmless.

    By default batches are taken in arrival order and sorted by time inside. With ``late``
    seconds the order is that of the events: ticks wait until the newest tick is that much
    newer, and are then taken up to there in time order over all batches. A tick that comes
    after its time has been taken is dropped and counted, see ``dropped_ticks``. What still
    waits at the end is appended to the result, but stays waiting for the next run.
    """
    decay = 1 - 2 / (span + 1)
    spark = ticks.sparkSession

    def signals(rows: DataFrame, state: DataFrame) -> DataFrame:
        made = _advance(rows, state, decay, block_rows)
        return made.withColumn("signal", trade_signal(F.col("forecast"), buy_at, sell_at))

    def state_of(number: int) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], "symbol string, last double")
        return spark.read.parquet(f"{folder}/state/{number}")

    def write(batch: DataFrame, number: int) -> None:
        state = state_of(number - 1)
        if late is not None:
            batch = _in_time(spark, ticks.schema, batch, f"{folder}/waiting", number, late)
        target = f"{folder}/signals/batch={number}"
        signals(batch, state).write.mode("overwrite").parquet(target)
        done = spark.read.schema(SIGNALS).parquet(target)
        ends = done.groupBy("symbol").agg(F.max_by("forecast", "position").alias("now"))
        merged = state.join(ends, "symbol", "full").select(
            "symbol", F.coalesce("now", "last").alias("last")
        )
        merged.write.mode("overwrite").parquet(f"{folder}/state/{number}")
        # A repeated batch needs the state before it; older ones are done with.
        remove(spark, f"{folder}/state/{number - 2}")

    # Without any tick there is no batch; the empty table is there all the same.
    spark.createDataFrame([], SIGNALS).write.mode("overwrite").parquet(f"{folder}/signals/batch=-1")
    _run(ticks.writeStream.outputMode("append"), write, folder)
    taken = spark.read.parquet(f"{folder}/signals")
    if late is None:
        return taken
    last = _last_batch(spark, f"{folder}/waiting")
    if last < 0:
        return taken
    held = spark.read.schema(ticks.schema).parquet(f"{folder}/waiting/{last}/ticks")
    return taken.unionByName(signals(held, state_of(last)), allowMissingColumns=True)


def _last_batch(spark: SparkSession, folder: str) -> int:
    """Number of the newest batch that left its waiting ticks, -1 for none."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/edge/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return max((int(f.getPath().getParent().getParent().getName()) for f in found or []), default=-1)


def _in_time(spark, schema, batch: DataFrame, folder: str, number: int, late: int) -> DataFrame:
    """The ticks whose time has come, in a table of their own; the others wait under the batch number.

    ``edge`` is one row: the time up to which ticks were taken, the newest tick, and how many
    came too late so far.
    """
    now = f"{folder}/{number}"
    before = f"{folder}/{number - 1}"
    edge, newest, dropped, rows = None, None, 0, batch
    if number > 0:
        edge, newest, dropped = spark.read.parquet(f"{before}/edge").first()
        rows = batch.unionByName(spark.read.schema(schema).parquet(f"{before}/ticks"))
    top = F.max("ts").alias("top")
    behind = F.count_if(F.col("ts") <= F.lit(edge)).alias("behind") if edge else F.lit(0).alias("behind")
    top, behind = batch.agg(top, behind).first()
    newest = max((t for t in (newest, top) if t is not None), default=None)
    upto = None if newest is None else newest - dt.timedelta(seconds=late)
    if edge is not None:
        upto = max(upto, edge)
        rows = rows.filter(F.col("ts") > F.lit(edge))
    ripe = F.lit(False) if upto is None else F.col("ts") <= F.lit(upto)
    rows.filter(ripe).write.mode("overwrite").parquet(f"{now}/taken")
    rows.filter(~ripe).write.mode("overwrite").parquet(f"{now}/ticks")
    row = [(upto, newest, dropped + behind)]
    spark.createDataFrame(row, "upto timestamp, newest timestamp, dropped bigint").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{now}/edge")
    remove(spark, f"{folder}/{number - 2}")
    return spark.read.schema(schema).parquet(f"{now}/taken")


def dropped_ticks(spark: SparkSession, folder: str) -> int:
    """Ticks of a ``stream_signals`` run with ``late`` that came after their time was taken."""
    last = _last_batch(spark, f"{folder}/waiting")
    return 0 if last < 0 else spark.read.parquet(f"{folder}/waiting/{last}/edge").first()["dropped"]


def _advance(batch: DataFrame, state: DataFrame, decay: float, block_rows: int) -> DataFrame:
    """Exponential mean of one batch, continued from ``state``."""
    rows = batch.join(state, "symbol", "left")
    seed = (F.col(RN) == 0) & F.col("last").isNull()
    drive = F.when(seed, F.col("value")).otherwise(F.col("value") * (1 - decay))
    rec = Recurrence("own", drive, decay)
    s = blocked(rows, ["symbol"], ["ts", "event_id"], lookback=_reach(rec), block_rows=block_rows)
    s = recurrences(s, [rec])
    carried = F.coalesce(F.col("last") * F.pow(F.lit(decay), F.col(RN) + 1), F.lit(0.0))
    s = s.add({"forecast": F.col("own") + carried, "position": F.col(RN)})
    return s.rows("own", "last")


def _reach(rec: Recurrence) -> int:
    return 2 * share_blocks([rec])[0][0]
