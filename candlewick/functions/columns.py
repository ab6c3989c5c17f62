"""Row-level expressions: price shapes, rules, labels, signals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero: no operator here emits NaN or infinity."""
    return F.try_divide(a, b)


def price_features() -> dict[str, Column]:
    """Change, range and mean price of one bar."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "price_change": c - o,
        "price_range": h - l,
        "typical_price": (o + h + l + c) / 4,
        "hlc_price": (h + l + c) / 3,
    }


def peg_features(peg: float = 1.0) -> dict[str, Column]:
    """Distance of the close from the value it is meant to hold."""
    gap = F.abs(F.col("close") - peg)
    return {
        "price_deviation": gap,
        "percentage_deviation": gap / peg * 100,
        "true_range": F.col("high") - F.col("low"),
        "volume_to_market_cap_ratio": ratio(F.col("volume"), F.col("market_cap")),
    }


def round_numeric(df: DataFrame, places: int = 2) -> DataFrame:
    """Round every fractional column, halves to even."""
    return df.select(
        *[
            F.bround(F.col(f"`{n}`"), places).alias(n)
            if t in ("double", "float") or t.startswith("decimal")
            else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def concat_text(*parts: str, sep: str = ". ") -> Column:
    """Join columns with a separator; a NULL part counts as empty text."""
    pieces: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            pieces.append(F.lit(sep))
        pieces.append(F.coalesce(F.col(part), F.lit("")))
    return F.concat(*pieces)


def row_total(columns: Iterable[str]) -> Column:
    """Sum across columns, skipping NULLs."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0))
    return total


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0, "positive").when(score < 0, "negative").otherwise("neutral")


def trade_signal(forecast: Column, buy_at: Column | float, sell_at: Column | float) -> Column:
    """'buy' at or below one threshold, 'sell' at or above the other, else NULL."""
    return F.when(forecast <= buy_at, "buy").when(forecast >= sell_at, "sell")


def country_risk(country: Column, prohibited: list[str], high: list[str]) -> Column:
    return (
        F.when(country.isin(prohibited), "Prohibited")
        .when(country.isin(high), "High")
        .otherwise("Low")
    )


def age_risk(age: Column) -> Column:
    """Above 70 High, 60 to 69 Medium, the rest (70 itself included) Low."""
    return F.when(age > 70, "High").when(age.between(60, 69), "Medium").otherwise("Low")


def job_risk(job: Column, exposed: list[str]) -> Column:
    return F.when(job.isin(exposed), "High").otherwise("Low")


def risk_level(country: Column, age: Column, job: Column) -> Column:
    """Strongest of the three partial ratings; only age can yield Medium."""
    return (
        F.when(country == "Prohibited", "Prohibited")
        .when((country == "High") | (age == "High") | (job == "High"), "High")
        .when(age == "Medium", "Medium")
        .otherwise("Low")
    )


def unit_hash(*parts: Column) -> Column:
    """Deterministic number in (0, 1) from an md5 of the parts."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    word = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (word + 0.5) / 4294967296.0
