import datetime as dt

import numpy as np
import pandas as pd
import pytest
from helpers import column
from pyspark.sql import functions as F

from candlewick.functions.columns import price_features
from candlewick.operators import indicators as ind
from candlewick.operators import series
from candlewick.operators.series import (
    RN,
    Recurrence,
    blocked,
    forward_fill,
    recurrences,
    running_sums,
    share_blocks,
    whole,
)

RNG = np.random.default_rng(7)


def ticks(spark, sizes, nulls=False):
    rows, k = [], 0
    for symbol, n in sizes.items():
        at = dt.datetime(2024, 1, 1)
        for _ in range(n):
            # uneven gaps: bursts inside one hour and jumps over many hours
            at += dt.timedelta(seconds=float(RNG.choice([1, 40, 9000])))
            v = None if nulls and RNG.random() < 0.5 else float(RNG.uniform(1, 100))
            rows.append((k, at, symbol, v))
            k += 1
    return spark.createDataFrame(rows, "event_id bigint, ts timestamp, symbol string, close double")


def frame(df):
    return {k: g.reset_index(drop=True) for k, g in
            df.toPandas().sort_values(["symbol", "ts", "event_id"]).groupby("symbol")}


@pytest.mark.parametrize("block_rows,grain", [(128, [3600]), (257, [3600, 1]), (1 << 16, [1000000, 86400, 60])])
def test_blocks_equal_whole_series(spark, block_rows, grain):
    df = ticks(spark, {"HOT": 900, "b": 130, "c": 1})
    s = blocked(df, lookback=min(block_rows, 120), block_rows=block_rows,
                grains=[F.expr(f"unix_seconds(ts) div {g}") for g in grain])
    s = s.add({
        "lag1": ind.lag(s, "close"),
        "ma": ind.sma(s, "close", 50),
        "std": ind.rolling_std(s, "close", 20, full=True),
        "wma": ind.wma(s, "close", 14),
        "rn": F.col(RN),
    })
    s = ind.emas(s, {"ema": ("close", 3)})
    s = running_sums(s, {"total": F.col("close")})
    s = ind.cumulative_return(s)
    out = frame(s.rows())
    assert sum(len(g) for g in out.values()) == 1031
    w = np.arange(1, 15)
    for g in out.values():
        x = g.close
        assert list(g.rn) == list(range(len(g)))
        pd.testing.assert_series_equal(g.lag1, x.shift(1), check_names=False)
        np.testing.assert_allclose(g.ma, x.rolling(50, min_periods=1).mean())
        np.testing.assert_allclose(g["std"], x.rolling(20).std(), rtol=1e-9)
        np.testing.assert_allclose(
            g.wma, x.rolling(14).apply(lambda v: v @ w / w.sum(), raw=True), rtol=1e-9)
        np.testing.assert_allclose(g.ema, x.ewm(span=3, adjust=False).mean(), rtol=1e-12)
        np.testing.assert_allclose(g.total, x.cumsum())
        np.testing.assert_allclose(g.cumulative_return[1:], (x / x[0] - 1)[1:])


def test_block_fill_carries_over_empty_blocks(spark):
    df = ticks(spark, {"a": 300}, nulls=True)
    df = df.withColumn("close", F.when(F.col("event_id").between(60, 190), None).otherwise(F.col("close")))
    s = blocked(df, lookback=4, block_rows=32)
    s = forward_fill(s.add({"filled": F.col("close")}), ["filled"])
    s = ind.padded_pct_change(s, {"close": "change"})
    g = frame(s.rows())["a"]
    want = g.close.ffill()
    pd.testing.assert_series_equal(g.filled, want, check_names=False)
    pd.testing.assert_series_equal(g.change, want.pct_change(fill_method=None), check_names=False)


def test_grains_follow_the_busiest_hour(spark, monkeypatch):
    df = ticks(spark, {"a": 300})
    assert len(series.time_grains(df, ["symbol"], "ts")) == 1
    coarse = blocked(df, lookback=2).rows().count()
    monkeypatch.setattr(series, "CELL_ROWS", 3)
    assert len(series.time_grains(df, ["symbol"], "ts")) == 2
    s = blocked(df, lookback=2)
    fine = frame(s.add({"rn": F.col(RN)}).rows())["a"]
    assert len(fine) == coarse and list(fine.rn) == list(range(300))


def test_halo_too_short_is_refused(spark):
    s = blocked(ticks(spark, {"a": 5}), lookback=10, block_rows=32)
    with pytest.raises(ValueError):
        ind.sma(s, "close", 50)
    with pytest.raises(ValueError):
        ind.emas(s, {"e": ("close", 50)})
    with pytest.raises(ValueError):
        whole(ticks(spark, {"a": 5}), order="ts")


def test_recurrence_groups_share_a_block():
    recs = [Recurrence(str(b), F.lit(1.0), b) for b in (0.05, 0.5, 0.8, 0.9, 0.98)]
    groups = share_blocks(recs)
    assert sum(len(m) for _, m in groups) == 5
    for length, members in groups:
        for r in members:
            assert r.decay**length < 1e-17
            assert -length * np.log10(r.decay) <= 260


def test_mixed_decays_against_loop(spark, closes):
    x = RNG.uniform(1, 9, 700)
    s = whole(closes(a=x))
    decays = (0.05, 0.5, 0.93, 0.99)
    s = recurrences(s, [Recurrence(f"y{i}", F.col("close"), b) for i, b in enumerate(decays)])
    g = s.rows().orderBy("d").toPandas()
    for i, b in enumerate(decays):
        y, want = 0.0, []
        for v in x:
            y = b * y + v
            want.append(y)
        np.testing.assert_allclose(g[f"y{i}"], want, rtol=1e-12)


def test_single_row(closes):
    s = whole(closes(a=[5], b=[7, 9]))
    out = ind.indicator_set(s).rows()
    for name, want in {
        "std_20": None, "price_momentum": None, "daily_return": None, "cumulative_return": None,
        "ema_7": 5.0, "ma_20": 5.0, "tr": 0.0, "atr": None, "rsi": None, "macd": None,
    }.items():
        assert column(out, "a", name) == [want], name
    assert column(out, "b", "price_momentum") == [None, 2.0]


def test_pct_change_pads_and_avoids_zero(closes):
    s = ind.padded_pct_change(whole(closes(a=[1, None, 2, 0, 3])), {"close": "r"})
    assert column(s.rows(), "a", "r") == [None, 0.0, 1.0, -1.0, None]


def test_flat_and_rising_rsi(closes):
    s = whole(closes(flat=[5] * 20, up=range(1, 21)))
    s = s.add({"delta": ind.diff(s, "close")})
    s = s.add(ind.gain_loss("delta"))
    plain = ind.rsi(s).rows()
    wilder = ind.rsi_wilder(s).rows()
    assert column(plain, "flat", "rsi") == [None] * 20
    assert column(wilder, "flat", "rsi") == [None] * 13 + [100.0] * 7
    assert column(plain, "up", "rsi")[1:] == [100.0] * 19
    assert column(wilder, "up", "rsi")[13:] == [100.0] * 7
    bands = s.add(ind.bollinger(s)).rows()
    assert column(bands, "flat", "upper_band")[1:] == [5.0] * 19


@pytest.mark.parametrize("n", [13, 14, 25, 26])
def test_warm_up_edges(closes, n):
    s = whole(closes(a=np.linspace(10, 20, n)))
    s = s.add({"previous_close": ind.lag(s, "close")})
    s = s.add({"tr": ind.true_range(s)})
    atr = column(ind.atr_wilder(s).rows(), "a", "atr")
    macd = column(ind.macd(s).rows(), "a", "macd")
    assert [v is None for v in atr] == [i < 13 for i in range(n)]
    assert [v is None for v in macd] == [i < 25 for i in range(n)]


def test_wilder_atr_against_loop(closes):
    x = RNG.uniform(10, 20, 80)
    s = whole(closes(a=x))
    s = s.add({"previous_close": ind.lag(s, "close")})
    s = s.add({"tr": ind.true_range(s)})
    out = ind.atr_wilder(s).rows()
    tr, got = column(out, "a", "tr"), column(out, "a", "atr")
    want = np.mean(tr[:14])
    for i in range(13, 80):
        if i > 13:
            want = (13 * want + tr[i]) / 14
        assert got[i] == pytest.approx(want, rel=1e-12)


def test_zero_volume_vwap(closes):
    df = closes(a=[1, 2, 3]).withColumn("volume", F.lit(0.0))
    s = ind.cumulative_vwap(whole(df).add(price_features()))
    assert column(s.rows(), "a", "vwap") == [None] * 3


def gappy(pick, n, share):
    """Values with single gaps, runs of gaps and a late start."""
    v = pick.uniform(1, 100, n)
    v[pick.random(n) > share] = np.nan
    v[n // 2 : n // 2 + n // 5] = np.nan
    v[: n // 50] = np.nan
    return v


@pytest.mark.parametrize("span", [2, 7, 26, 120])
@pytest.mark.parametrize("share", [0.95, 0.3, 0.02])
def test_means_over_gaps_equal_pandas(spark, span, share):
    n, pick = 3000, np.random.default_rng(span)
    values = {"a": gappy(pick, n, share), "b": np.full(40, np.nan), "c": gappy(pick, 50, share)}
    rows = [
        (k, dt.date(2000, 1, 1) + dt.timedelta(days=i), None if np.isnan(x) else float(x))
        for k, v in values.items() for i, x in enumerate(v)
    ]
    df = spark.createDataFrame(rows, "symbol string, d date, close double")
    s = ind.emas_over_gaps(whole(df), {"ema": ("close", span)})
    got = s.rows().toPandas().sort_values("d").groupby("symbol")["ema"]
    for k, v in values.items():
        want = pd.Series(v).ewm(span=span, adjust=False).mean()
        np.testing.assert_allclose(got.get_group(k).to_numpy(float), want.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("block_rows", [400, 1 << 16])
def test_means_over_gaps_in_blocks(spark, block_rows):
    n, pick = 5000, np.random.default_rng(1)
    v = gappy(pick, n, 0.4)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=i), "a", None if np.isnan(x) else float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, symbol string, close double")
    s = blocked(df, lookback=400, block_rows=block_rows, grains=[F.expr("unix_seconds(ts) div 3600")])
    s = ind.emas_over_gaps(s, {"ema": ("close", 7)})
    got = s.rows().orderBy("event_id").toPandas()["ema"].to_numpy(float)
    np.testing.assert_allclose(got, pd.Series(v).ewm(span=7, adjust=False).mean().to_numpy(), rtol=1e-9)
    with pytest.raises(ValueError, match="rows of history"):
        ind.emas_over_gaps(s, {"slow": ("close", 500)})


def test_first_values_join_on_blocks(spark):
    df = ticks(spark, {"HOT": 700, "b": 5})
    s = blocked(df, lookback=10, block_rows=64, grains=[F.expr("unix_seconds(ts) div 3600")])
    s = series.first_values(s, ["close"])
    for g in frame(s.rows()).values():
        assert (g["first_close"] == g["close"].iloc[0]).all()
    assert "_blk" in s.df._jdf.queryExecution().optimizedPlan().toString().split("Join")[1]
