"""Model scores as plain aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_scores(
    df: DataFrame, actual: str, predicted: str, by: list[str] | None = None
) -> DataFrame:
    """Mean squared error, mean absolute error and R-squared in one pass."""
    df = df.na.drop(subset=[actual, predicted])
    err = F.col(actual) - F.col(predicted)
    mse = F.avg(err * err)
    return df.groupBy(*(by or [])).agg(
        mse.alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(actual))).alias("r2"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """(actual, predicted, n) on the full label grid, zero-filled."""
    spark = df.sparkSession
    grid = spark.createDataFrame(
        [(a, p) for a in labels for p in labels], "actual string, predicted string"
    )
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return grid.join(counts, ["actual", "predicted"], "left").withColumn(
        "n", F.coalesce("n", F.lit(0))
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label; an empty denominator scores 0.

    Each row votes for its two labels, so one aggregate yields every count.
    """
    a, p = F.col(actual), F.col(predicted)
    votes = F.array(
        F.struct(a.alias("label"), (a == p).cast("int").alias("tp"), F.lit(1).alias("act"), F.lit(0).alias("pre")),
        F.struct(p.alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("act"), F.lit(1).alias("pre")),
    )
    counts = (
        df.select(F.inline(votes))
        .groupBy("label")
        .agg(F.sum("tp").alias("tp"), F.sum("act").alias("support"), F.sum("pre").alias("pre"))
    )
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.select(
        "label",
        rate(F.col("tp"), F.col("pre")).alias("precision"),
        rate(F.col("tp"), F.col("support")).alias("recall"),
        rate(2 * F.col("tp"), F.col("pre") + F.col("support")).alias("f1"),
        "support",
    )


def label_totals(df: DataFrame, actual: str, predicted: str, labels: list[str]) -> DataFrame:
    """How often each label of a fixed list was observed and predicted; 0 if never."""
    votes = F.array(
        F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")),
    )
    sums = (
        df.select(F.inline(votes))
        .groupBy("label")
        .agg(F.sum("a").alias("actual_n"), F.sum("p").alias("predicted_n"))
    )
    grid = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return grid.join(sums, "label", "left").na.fill(0, ["actual_n", "predicted_n"])


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    hit = (F.col(actual) == F.col(predicted)).cast("double")
    return df.agg(F.avg(hit).alias("accuracy"))
