"""Resampling, calendar spines and future grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators import indicators as ind
from candlewick.operators.series import whole


def week_of(day: Column) -> Column:
    """Label of the week a day belongs to: the Sunday on or after it."""
    return F.next_day(F.date_sub(day, 1), "SUN")


def _known(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.col("d"))


def weekly(df: DataFrame) -> DataFrame:
    """Weekly bars: first open, extreme prices, last close and cap, summed volume."""
    return df.groupBy("symbol", week_of(F.col("d")).alias("week")).agg(
        F.min_by("open", _known("open")).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", _known("close")).alias("close"),
        F.sum("volume").alias("volume"),
        F.max_by("market_cap", _known("market_cap")).alias("market_cap"),
    )


def spine(df: DataFrame, column: str, step: str) -> DataFrame:
    """Every step between each symbol's first and last value of ``column``."""
    return (
        df.groupBy("symbol")
        .agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        .select("symbol", F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias(column))
    )


def weekly_spine(df: DataFrame) -> DataFrame:
    """Weekly bars with empty weeks kept: volume 0, everything else NULL."""
    bars = weekly(df)
    return (
        spine(bars, "week", "7 days")
        .join(bars, ["symbol", "week"], "left")
        .withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    )


def daily_grid(df: DataFrame) -> DataFrame:
    """One row per calendar day of each series; days without data are NULL."""
    return spine(df, "d", "1 day").join(df, ["symbol", "d"], "left")


def filled_grid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Daily grid on which gaps carry the last known values."""
    return ind.forward_fill(whole(daily_grid(df)), columns).rows()


def weekly_growth(df: DataFrame) -> DataFrame:
    """Weekly bars with the cap's change in percent and in units."""
    s = whole(weekly_spine(df), order="week")
    s = ind.padded_pct_change(s, {"market_cap": "mcap_weekly_growth"})
    return s.add(
        {
            "mcap_weekly_growth": F.col("mcap_weekly_growth") * 100,
            "mcap_weekly_change": ind.diff(s, "market_cap"),
        }
    ).rows()


def weekly_typed_range(df: DataFrame, types: dict[str, list[str]], start: str, end: str) -> DataFrame:
    """Weekly growth of chosen symbols, tagged by group and cut to a date range.

    The range applies after the growth columns, so the first week kept still has
    its change against the week before. Symbols prune the scan.
    """
    wanted = [x for group in types.values() for x in group]
    tag = F.lit(None).cast("string")
    for name, group in types.items():
        tag = F.when(F.col("symbol").isin(group), name).otherwise(tag)
    return (
        weekly_growth(df.filter(F.col("symbol").isin(wanted)))
        .withColumn("type", tag)
        .filter(F.col("week").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    )


def future_grid(df: DataFrame, horizon: int) -> DataFrame:
    """The ``horizon`` days after each series' last day, with their step number."""
    return (
        df.groupBy("symbol")
        .agg(F.max("d").alias("last_d"))
        .select("symbol", "last_d", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
        .select("symbol", F.date_add("last_d", F.col("step")).alias("d"), "step")
    )


def days_since_start(df: DataFrame) -> DataFrame:
    """Days between each row and its series' first day."""
    first = df.groupBy("symbol").agg(F.min("d").alias("_first"))
    return (
        df.join(first, "symbol")
        .withColumn("days_since_start", F.datediff("d", "_first"))
        .drop("_first")
    )
