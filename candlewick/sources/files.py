"""CSV, JDBC and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlewick.operators.tables import dedupe_first, upsert

EXCHANGE_SCHEMA = (
    "timeOpen timestamp, timeClose timestamp, timeHigh timestamp, timeLow timestamp, "
    "open double, high double, low double, close double, volume double, "
    "marketCap double, timestamp timestamp"
)

SENTIMENT_SCHEMA = (
    "id BIGINT, news_id STRING, content STRING, sentiment_score DECIMAL(38,18), "
    "updated_at TIMESTAMP"
)


def load_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Give a schema for large files; inferring reads them twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def load_ohlcv_csv(
    spark: SparkSession,
    path: str,
    start: str | None = None,
    end: str | None = None,
    schema: str = EXCHANGE_SCHEMA,
) -> DataFrame:
    """Raw exchange export (';' separated): seven columns, one row per opening time.

    The date range is inclusive. Among rows sharing a time the smallest wins.
    """
    raw = spark.read.option("header", True).option("sep", ";").schema(schema).csv(path)
    bars = raw.select(
        F.col("timeOpen").alias("date"), "open", "high", "low", "close", "volume", "marketCap"
    )
    if start is not None:
        bars = bars.filter(F.col("date") >= F.lit(start).cast("timestamp"))
    if end is not None:
        bars = bars.filter(F.to_date("date") <= F.lit(end).cast("date"))
    return dedupe_first(bars, ["date"], ["open", "high", "low", "close"])


def load_bars(
    source: DataFrame, symbols: list[str] | None = None, since: str = "2014-01-01"
) -> DataFrame:
    """Bars of chosen symbols from a start day; both conditions reach the scan."""
    bars = source.filter(F.col("d") >= F.lit(since).cast("date"))
    return bars.filter(F.col("symbol").isin(symbols)) if symbols else bars


def jdbc_options(
    url: str, table: str, column: str, lower: str, upper: str, partitions: int
) -> dict[str, str]:
    """Options of a partitioned JDBC read: ``partitions`` range queries on ``column``."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": column,
        "lowerBound": lower,
        "upperBound": upper,
        "numPartitions": str(partitions),
        "fetchsize": "10000",
    }


def read_jdbc(spark: SparkSession, **options: str) -> DataFrame:
    """Table from a database, read in parallel; see ``jdbc_options``."""
    return spark.read.format("jdbc").options(**options).load()


def write_csv(df: DataFrame, path: str) -> None:
    """Write a directory of CSV parts with headers, replacing what was there."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_table(
    spark: SparkSession, current: str, changes: DataFrame, keys: list[str], version: str, out: str
) -> DataFrame:
    """Merge changes into the parquet table at ``current`` and write it to ``out``."""
    if current.rstrip("/") == out.rstrip("/"):
        raise ValueError("write the merged table to a new path, not over its own input")
    upsert(spark.read.parquet(current), changes, keys, version).write.parquet(out)
    return spark.read.parquet(out)


def create_sentiment_table(
    spark: SparkSession, name: str = "news_sentiments", location: str | None = None
) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SENTIMENT_SCHEMA}) USING parquet{where}")
