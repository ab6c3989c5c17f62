"""Technical indicators over a laid-out series.

Builders return Columns, so a caller adds many of them in one step and Catalyst
folds equal window specifications into one operator. Functions that need an
intermediate column take and return a ``Series``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.functions.columns import price_features, ratio
from candlewick.operators.series import (
    RN,
    Recurrence,
    Series,
    first_values,
    forward_fill,
    gap_means,
    recurrences,
    running_sums,
    seeded,
)


def _full(s: Series, column: str, n: int, value: Column) -> Column:
    """NULL until the frame holds n known values."""
    return F.when(F.count(column).over(s.last(n)) >= n, value)


def lag(s: Series, column: str, n: int = 1) -> Column:
    s.need(n)
    return F.lag(column, n).over(s.ordered)


def diff(s: Series, column: str, n: int = 1) -> Column:
    return F.col(column) - lag(s, column, n)


def pct_change(s: Series, column: str) -> Column:
    """Relative change from the previous row; NULL on row one and on a zero base."""
    return ratio(F.col(column), lag(s, column)) - 1


def padded_pct_change(s: Series, columns: dict[str, str]) -> Series:
    """Relative change after carrying the last known value over NULLs."""
    work = {f"_p_{c}": F.col(c) for c in columns}
    s = forward_fill(s.add(work), list(work))
    s = s.add({out: pct_change(s, f"_p_{c}") for c, out in columns.items()})
    return s.drop(*work)


def sma(s: Series, column: str, n: int, full: bool = False) -> Column:
    mean = F.avg(column).over(s.last(n))
    return _full(s, column, n, mean) if full else mean


def rolling_std(
    s: Series, column: str, n: int, full: bool = False, population: bool = False
) -> Column:
    std = (F.stddev_pop if population else F.stddev_samp)(column).over(s.last(n))
    return _full(s, column, n, std) if full else std


def wma(s: Series, column: str, n: int) -> Column:
    """Linearly weighted mean, newest row heaviest, NULL until n rows.

    sum(k * x) over the frame is sum(position * x) shifted by the frame's start,
    so two plain window sums suffice whatever n is. Positions count from the start
    of the block, which keeps the shift small against the values.

    """
    frame = s.last(n)
    shift = s.position - n
    weighted = F.sum(s.position * F.col(column)).over(frame) - shift * F.sum(column).over(frame)
    return _full(s, column, n, weighted / (n * (n + 1) / 2))


def emas(s: Series, columns: dict[str, tuple[str, int]]) -> Series:
    """Exponential means: name -> (column, span). The first row is the seed.

    A NULL has no place in the recurrence and would count as 0, so it is an error: drop
    such rows, fill them first, or take ``emas_over_gaps``.
    """

    def known(column: str) -> Column:
        stop = F.raise_error(F.lit(f"exponential mean: NULL in {column}; drop or fill it first"))
        return F.coalesce(F.col(column), stop.cast("double"))

    return recurrences(
        s,
        [
            Recurrence(name, seeded(known(c), 1 - 2 / (span + 1)), 1 - 2 / (span + 1))
            for name, (c, span) in columns.items()
        ],
    )


def emas_over_gaps(s: Series, columns: dict[str, tuple[str, int]]) -> Series:
    """Exponential means where values may be missing: name -> (column, span).

    A missing value leaves the mean as it is, and the past fades over the gap.
    """
    return gap_means(s, {name: (c, 2 / (span + 1)) for name, (c, span) in columns.items()})


def cumulative_vwap(s: Series, price: str = "typical_price", name: str = "vwap") -> Series:
    """Running sum of price times volume over running volume."""
    s = running_sums(s, {"_pv": F.col(price) * F.col("volume"), "_v": F.col("volume")})
    s = s.add({name: ratio(F.col("_pv"), F.col("_v"))})
    return s.drop("_pv", "_v")


def rolling_vwap(s: Series, price: str = "hlc_price", n: int = 14) -> Column:
    frame = s.last(n)
    traded = F.sum(F.col(price) * F.col("volume")).over(frame)
    return _full(s, price, n, ratio(traded, F.sum("volume").over(frame)))


def cumulative_return(s: Series, column: str = "close", name: str = "cumulative_return") -> Series:
    """Compounded change since the first row; the product telescopes to a ratio."""
    s = first_values(s, [column])
    value = ratio(F.col(column), F.col(f"first_{column}")) - 1
    s = s.add({name: F.when(F.col(RN) > 0, value)})
    return s.drop(f"first_{column}")


def true_range(s: Series, previous_close: str = "previous_close") -> Column:
    """Largest of high-low and the two gaps to the previous close."""
    h, l, pc = F.col("high"), F.col("low"), F.col(previous_close)
    return F.greatest(h - l, F.abs(h - pc), F.abs(l - pc))


def atr_wilder_drive(s: Series, tr: str, n: int = 14) -> Column:
    """Drive of Wilder's average: nothing before row n, its mean there, then tr/n."""
    return (
        F.when(F.col(RN) < n - 1, 0.0)
        .when(F.col(RN) == n - 1, F.avg(tr).over(s.last(n)))
        .otherwise(F.col(tr) / n)
    )


def atr_wilder(s: Series, tr: str = "tr", n: int = 14, name: str = "atr") -> Series:
    s = s.add({"_drive": atr_wilder_drive(s, tr, n)})
    s = recurrences(s, [Recurrence(name, F.col("_drive"), 1 - 1 / n)])
    s = s.add({name: F.when(F.col(RN) >= n - 1, F.col(name))})
    return s.drop("_drive")


def gain_loss(change: str) -> dict[str, Column]:
    """Upward and downward parts of a change; an unknown change counts as none."""
    x = F.coalesce(F.col(change), F.lit(0.0))
    return {"gain": F.greatest(x, F.lit(0.0)), "loss": F.greatest(-x, F.lit(0.0))}


def rsi_value(gain: Column, loss: Column, flat: float | None = None) -> Column:
    """100 without losses, ``flat`` when nothing moved at all."""
    return (
        F.when((loss == 0) & (gain == 0), F.lit(flat).cast("double"))
        .when(loss == 0, 100.0)
        .otherwise(100 - 100 / (1 + F.try_divide(gain, loss)))
    )


def rsi(s: Series, n: int = 14, full: bool = False, name: str = "rsi") -> Series:
    """Strength index from plain means of the ``gain`` and ``loss`` columns."""
    frame = s.last(n)
    s = s.add({"_ag": F.avg("gain").over(frame), "_al": F.avg("loss").over(frame)})
    value = rsi_value(F.col("_ag"), F.col("_al"))
    s = s.add({name: F.when(F.col(RN) >= n - 1, value) if full else value})
    return s.drop("_ag", "_al")


def rsi_wilder_recs(n: int = 14) -> list[Recurrence]:
    b = 1 - 1 / n
    return [Recurrence(f"_w{c}", seeded(F.col(c), b), b) for c in ("gain", "loss")]


def rsi_wilder_value(n: int = 14) -> Column:
    """NULL before n rows; no downward move at all reads 100."""
    return F.when(F.col(RN) >= n - 1, rsi_value(F.col("_wgain"), F.col("_wloss"), flat=100.0))


def rsi_wilder(s: Series, n: int = 14, name: str = "rsi") -> Series:
    s = recurrences(s, rsi_wilder_recs(n)).add({name: rsi_wilder_value(n)})
    return s.drop("_wgain", "_wloss")


def bollinger(
    s: Series,
    column: str = "close",
    n: int = 20,
    width: float = 2.0,
    full: bool = False,
    population: bool = False,
) -> dict[str, Column]:
    mid = sma(s, column, n, full)
    std = rolling_std(s, column, n, full, population)
    return {"middle_band": mid, "upper_band": mid + width * std, "lower_band": mid - width * std}


def macd(
    s: Series,
    column: str = "close",
    fast: int = 12,
    slow: int = 26,
    signal: int | None = None,
) -> Series:
    """Fast minus slow exponential mean, NULL before ``slow`` rows.

    With ``signal`` also its own exponential mean, seeded on the first known
    value, and the histogram between the two.
    """
    s = emas(s, {"_fast": (column, fast), "_slow": (column, slow)})
    s = s.add({"macd": F.when(F.col(RN) >= slow - 1, F.col("_fast") - F.col("_slow"))})
    s = s.drop("_fast", "_slow")
    if signal is None:
        return s
    b = 1 - 2 / (signal + 1)
    drive = (
        F.when(F.col(RN) < slow - 1, 0.0)
        .when(F.col(RN) == slow - 1, F.col("macd"))
        .otherwise(F.col("macd") * (1 - b))
    )
    s = recurrences(s, [Recurrence("macd_signal", drive, b)])
    s = s.add({"macd_signal": F.when(F.col(RN) >= slow + signal - 2, F.col("macd_signal"))})
    return s.add({"macd_hist": F.col("macd") - F.col("macd_signal")})


SMA_SPANS = (20, 50, 100, 200)
EMA_SPANS = (7, 14, 20, 28, 50, 100)
WMA_SPANS = (5, 7, 12, 14, 20, 26)
STD_SPANS = (20, 50)


def indicator_set(
    s: Series,
    sma_spans: Sequence[int] = SMA_SPANS,
    ema_spans: Sequence[int] = EMA_SPANS,
    wma_spans: Sequence[int] = WMA_SPANS,
    std_spans: Sequence[int] = STD_SPANS,
) -> Series:
    """The full daily indicator table.

    Three window passes over one shuffle: everything that reads raw bars, then
    what reads those results, then all recurrences in one block scan.
    """
    s = s.add(price_features())
    s = s.add(
        {
            "previous_close": lag(s, "close"),
            "price_momentum": diff(s, "close"),
            "volume_change": diff(s, "volume"),
            "mkcap_change": diff(s, "market_cap"),
            "daily_return": pct_change(s, "close"),
            **{f"ma_{n}": sma(s, "close", n) for n in sma_spans},
            **{f"wma_{n}": wma(s, "close", n) for n in wma_spans},
            **{f"std_{n}": rolling_std(s, "close", n) for n in std_spans},
            **{
                k: v
                for k, v in bollinger(s, "close", 20, population=True).items()
                if k != "middle_band"
            },
            "vwap": rolling_vwap(s),
        }
    )
    s = cumulative_return(s)
    s = s.add({"tr": true_range(s), **gain_loss("price_momentum")})
    s = s.add({"_atr": atr_wilder_drive(s, "tr")})
    spans = {f"ema_{n}": n for n in ema_spans} | {"_fast": 12, "_slow": 26}
    recs = [
        Recurrence(name, seeded(F.col("close"), 1 - 2 / (n + 1)), 1 - 2 / (n + 1))
        for name, n in spans.items()
    ]
    s = recurrences(s, [*recs, *rsi_wilder_recs(), Recurrence("atr", F.col("_atr"), 1 - 1 / 14)])
    s = s.add(
        {
            "atr": F.when(F.col(RN) >= 13, F.col("atr")),
            "rsi": rsi_wilder_value(),
            "macd": F.when(F.col(RN) >= 25, F.col("_fast") - F.col("_slow")),
        }
    )
    drop = ("_atr", "_fast", "_slow", "_wgain", "_wloss", "gain", "loss", "hlc_price")
    return s.drop(*drop)


def feature_set(s: Series) -> Series:
    """The second indicator table: simple-mean RSI, sample-std bands, running VWAP."""
    s = s.add(price_features())
    s = s.add({"_pc": lag(s, "close"), **gain_loss("price_change")})
    s = s.add({"tr": true_range(s, "_pc")})
    s = s.add(
        {
            "price_momentum": diff(s, "close"),
            "volume_change": diff(s, "volume"),
            "mkcap_change": diff(s, "market_cap"),
            "daily_return": pct_change(s, "close"),
            **{f"ma_{n}": sma(s, "close", n) for n in SMA_SPANS},
            **{f"wma_{n}": wma(s, "close", n) for n in (20, 50, 100, 200)},
            **{f"std_{n}": rolling_std(s, "close", n) for n in STD_SPANS},
            "atr_ma14": sma(s, "tr", 14, full=True),
        }
    )
    s = rsi(cumulative_return(cumulative_vwap(s)))
    s = emas(
        s,
        {f"ema_{n}": ("close", n) for n in (20, 50, 100, 200)} | {"atr_ema14": ("tr", 14)},
    )
    s = s.add(
        {
            "bollinger_upper": F.col("ma_20") + 2 * F.col("std_20"),
            "bollinger_lower": F.col("ma_20") - 2 * F.col("std_20"),
        }
    )
    return s.drop("_pc", "hlc_price")


def forecast_features(s: Series) -> DataFrame:
    """Inputs of the forecasting models; rows still warming up are dropped."""
    s = s.add(
        {
            "price_change": F.col("close") - F.col("open"),
            "high_low_diff": F.col("high") - F.col("low"),
            "moving_avg": sma(s, "close", 3, full=True),
            "prev_close": lag(s, "close"),
            "prev_volume": lag(s, "volume"),
            "_delta": diff(s, "close"),
            **bollinger(s, "close", 20, full=True),
        }
    )
    s = s.add(gain_loss("_delta") | {"prev_price_change": lag(s, "price_change")})
    s = rsi(s)
    needed = ["moving_avg", "rsi", "middle_band", "prev_close", "prev_price_change", "prev_volume"]
    return s.rows("_delta", "gain", "loss").na.drop(subset=needed)
