import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.streaming import live


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(5)
    at, rows = dt.datetime(2024, 1, 1), []
    for i in range(400):
        at += dt.timedelta(minutes=float(rng.uniform(1, 20)))
        rows.append((i, at, 1, "hot" if i % 4 else "cold", float(rng.uniform(0, 80)), "{}"))
    df = spark.createDataFrame(rows, live.TICK_SCHEMA)
    for part in range(4):
        low, high = part * 100, part * 100 + 99
        df.filter(F.col("event_id").between(low, high)).coalesce(1).write.mode("append").parquet(
            f"{tmp_path}/ticks"
        )
    return f"{tmp_path}", df


def test_stream_bars_equal_batch(spark, folder):
    root, df = folder
    ticks = live.tick_stream(spark, f"{root}/ticks", files=1)
    got = live.stream_bars(ticks, f"{root}/work", late="10 days").toPandas()
    want = df.toPandas()
    want["d"] = want.ts.dt.date
    groups = want.groupby(["event_type", "d"]).value
    assert len(got) == len(groups)
    for r in got.itertuples():
        g = groups.get_group((r.symbol, r.d))
        assert (r.open, r.high, r.low, r.close, r.volume) == (g.iloc[0], g.max(), g.min(), g.iloc[-1], len(g))


def test_stream_signal_equals_batch_mean(spark, folder):
    root, df = folder
    ticks = live.tick_stream(spark, f"{root}/ticks", files=1)
    out = live.stream_signals(ticks, f"{root}/work", 30.0, 50.0, span=5, block_rows=256).toPandas()
    assert out.batch.nunique() == 4 and len(out) == 400
    for symbol, g in df.toPandas().groupby("event_type"):
        want = g.set_index("event_id").value.ewm(span=5, adjust=False).mean()
        mine = out[out.symbol == symbol].set_index("event_id").sort_index()
        np.testing.assert_allclose(mine.forecast, want.sort_index(), rtol=1e-12)
        assert set(mine.signal[mine.forecast <= 30]) <= {"buy"}
        assert set(mine.signal[mine.forecast >= 50]) <= {"sell"}


def test_one_file_a_folder_and_no_ticks(spark, folder, tmp_path):
    root, df = folder
    df.coalesce(1).write.parquet(f"{root}/single")
    part = next((tmp_path / "single").glob("*.parquet"))
    part.rename(tmp_path / "events.parquet")
    schema_only = df.limit(0)
    schema_only.write.parquet(f"{root}/none")
    bars = {}
    for name in ("ticks", "events.parquet", "none"):
        ticks = live.tick_stream(spark, f"{root}/{name}")
        bars[name] = sorted(map(tuple, live.stream_bars(ticks, f"{root}/b-{name}", late="10 days").collect()))
        live.stream_signals(ticks, f"{root}/s-{name}", 30.0, 50.0, span=5, block_rows=256)
    assert bars["ticks"] == bars["events.parquet"] != []
    assert bars["none"] == []
    assert spark.read.parquet(f"{root}/s-none/signals").count() == 0


def test_old_state_goes(spark, folder, tmp_path):
    root, _ = folder
    live.stream_signals(live.tick_stream(spark, f"{root}/ticks", files=1), f"{root}/work", 30.0, 50.0, span=5, block_rows=256)
    assert sorted(p.name for p in (tmp_path / "work/state").iterdir() if p.is_dir()) == ["2", "3"]


def test_signals_in_event_time(spark, folder, tmp_path):
    """Parts that overlap in time by up to two hours give the batch result; later ticks are counted."""
    _, df = folder
    shuffled = df.withColumn("part", (F.unix_seconds(F.col("ts").cast("timestamp")) + 7200 * F.rand(3)).cast("long"))
    edges = [r[0] for r in shuffled.selectExpr("explode(percentile_approx(part, array(0.25, 0.5, 0.75)))").collect()]
    for i, (lo, hi) in enumerate(zip([0, *edges], [*edges, 1 << 60])):
        out = shuffled.filter((F.col("part") > lo) & (F.col("part") <= hi)).drop("part")
        out.coalesce(1).write.parquet(f"{tmp_path}/mixed/{i}")
    names = f"{tmp_path}/mixed/*"
    ticks = live.tick_stream(spark, names, files=1)
    got = live.stream_signals(ticks, f"{tmp_path}/w1", 20.0, 60.0, late=7200).toPandas()
    plain = live.stream_signals(live.tick_stream(spark, f"{tmp_path}/ticks", files=1), f"{tmp_path}/w2", 20.0, 60.0).toPandas()
    assert live.dropped_ticks(spark, f"{tmp_path}/w1") == 0
    a, b = (t.sort_values("event_id").set_index("event_id")["forecast"] for t in (got, plain))
    np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), rtol=1e-12)
    hasty = live.stream_signals(ticks, f"{tmp_path}/w3", 20.0, 60.0, late=0).toPandas()
    lost = live.dropped_ticks(spark, f"{tmp_path}/w3")
    assert lost > 0 and len(hasty) == 400 - lost
    none = live.tick_stream(spark, f"{tmp_path}/ticks").filter("false")
    assert live.stream_signals(none, f"{tmp_path}/w4", 20.0, 60.0, late=60).count() == 0
