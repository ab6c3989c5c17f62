"""Structured Streaming jobs, run to the end of the waiting files."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.plans.registry import query, snap, sql_columns
from candlewick.plans.series_queries import TNUM, ema_rec, recursive
from candlewick.streaming import live

BUY, SELL = 20.0, 60.0


@query(
    "stream_bars",
    """SELECT event_type AS symbol, CAST(ts AS DATE) AS d, arg_min(value, (ts, event_id)) AS open,
      max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
    FROM events GROUP BY 1, 2""",
)
def stream_bars(spark, root):
    ticks = live.tick_stream(spark, f"{root}/events.parquet")
    return live.stream_bars(ticks, live.work_folder(spark, "bars"))


@query(
    "stream_signal",
    f"""WITH RECURSIVE {TNUM}, {recursive({"f": ema_rec("value", 14)})}
    SELECT n.event_id, n.symbol, {sql_columns({"forecast": "f"})},
      CASE WHEN f <= {BUY} THEN 'buy' WHEN f >= {SELL} THEN 'sell' END AS signal
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def stream_signal(spark, root):
    ticks = live.tick_stream(spark, f"{root}/events.parquet")
    out = live.stream_signals(ticks, live.work_folder(spark, "signals"), BUY, SELL)
    return out.select("event_id", "symbol", snap(F.col("forecast")).alias("forecast"), "signal")


@query(
    "stream_signal_in_time",
    f"""WITH RECURSIVE {TNUM}, {recursive({"f": ema_rec("value", 14)})}
    SELECT n.event_id, n.symbol, {sql_columns({"forecast": "f"})},
      CASE WHEN f <= {BUY} THEN 'buy' WHEN f >= {SELL} THEN 'sell' END AS signal
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def stream_signal_in_time(spark, root):
    """Ticks wait an hour for those before them."""
    ticks = live.tick_stream(spark, f"{root}/events.parquet")
    out = live.stream_signals(ticks, live.work_folder(spark, "timed"), BUY, SELL, late=3600)
    return out.select("event_id", "symbol", snap(F.col("forecast")).alias("forecast"), "signal")
