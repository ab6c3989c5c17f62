"""Bars, windows and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlewick.functions.columns import peg_features, price_features, trade_signal
from candlewick.operators import bars as bar_ops
from candlewick.operators import indicators as ind
from candlewick.operators import tables
from candlewick.operators.series import RN, blocked, running_sums, whole
from candlewick.plans.registry import (
    BARS,
    NUM,
    PEG_BARS,
    TICKS,
    query,
    snap,
    snapped,
    sql_columns,
    sql_snap,
)
from candlewick.sources import files, views

KEY = ["symbol", "d"]

# ---------------------------------------------------------------- resampling

WEEKLY = BARS + """, weekly AS (
  SELECT symbol, CAST(date_trunc('week', d) + INTERVAL 6 DAY AS DATE) AS week,
         arg_min(open, d) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, d) AS close, sum(volume) AS volume, arg_max(market_cap, d) AS market_cap
  FROM bars GROUP BY 1, 2)"""

SPINE = WEEKLY + """, ends AS (SELECT symbol, min(week) AS lo, max(week) AS hi FROM weekly GROUP BY 1),
spine AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week FROM ends),
full_weeks AS (
  SELECT s.symbol, s.week, open, high, low, close, coalesce(volume, 0.0) AS volume, market_cap
  FROM spine s LEFT JOIN weekly w ON w.symbol = s.symbol AND w.week = s.week),
padded AS (
  SELECT *, last_value(market_cap IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY week
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS known FROM full_weeks),
growth AS (
  SELECT symbol, week, open, high, low, close, volume, market_cap,
         (known / lag(known) OVER w - 1) * 100 AS mcap_weekly_growth,
         market_cap - lag(market_cap) OVER w AS mcap_weekly_change
  FROM padded WINDOW w AS (PARTITION BY symbol ORDER BY week))"""


@query("weekly_ohlcv", f"WITH {WEEKLY} SELECT * FROM weekly")
def weekly_ohlcv(spark, root):
    return bar_ops.weekly(views.bars(spark, root))


@query("weekly_spine", f"WITH {SPINE} SELECT * FROM full_weeks")
def weekly_spine(spark, root):
    return bar_ops.weekly_spine(views.bars(spark, root))


GROWTH_COLUMNS = f"""symbol, week, open, high, low, close, volume, market_cap,
  {sql_columns({"mcap_weekly_growth": "mcap_weekly_growth"}, 6)},
  {sql_columns({"mcap_weekly_change": "mcap_weekly_change"}, 2)}"""


def _growth_out(df):
    return df.withColumns(
        {
            "mcap_weekly_growth": snap(F.col("mcap_weekly_growth"), 6),
            "mcap_weekly_change": snap(F.col("mcap_weekly_change"), 2),
        }
    )


@query("weekly_growth", f"WITH {SPINE} SELECT {GROWTH_COLUMNS} FROM growth")
def weekly_growth(spark, root):
    return _growth_out(bar_ops.weekly_growth(views.bars(spark, root)))


TYPES = {"urgent": ["1-URGENT", "2-HIGH"], "calm": ["4-NOT SPECIFIED", "5-LOW"]}


@query(
    "weekly_typed_range",
    f"""WITH {SPINE} SELECT {GROWTH_COLUMNS},
      CASE WHEN symbol IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'calm' END AS type
    FROM growth WHERE symbol IN ('1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW')
      AND week BETWEEN DATE '1996-01-01' AND DATE '1997-09-15'""",
)
def weekly_typed_range(spark, root):
    return _growth_out(
        bar_ops.weekly_typed_range(views.bars(spark, root), TYPES, "1996-01-01", "1997-09-15")
    )


@query(
    "daily_grid",
    f"""WITH {BARS}, ends AS (SELECT symbol, min(d) AS lo, max(d) AS hi FROM bars GROUP BY 1),
    spine AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM ends)
    SELECT s.symbol, s.d, open, high, low, close, volume, market_cap
    FROM spine s LEFT JOIN bars b ON b.symbol = s.symbol AND b.d = s.d""",
)
def daily_grid(spark, root):
    return bar_ops.daily_grid(views.bars(spark, root))


@query(
    "future_grid",
    f"""WITH {BARS}, ends AS (SELECT symbol, max(d) AS hi FROM bars GROUP BY 1)
    SELECT symbol, CAST(hi + CAST(step AS INT) AS DATE) AS d, CAST(step AS INT) AS step
    FROM ends, (SELECT unnest(generate_series(1, 30)) AS step)""",
)
def future_grid(spark, root):
    return bar_ops.future_grid(views.bars(spark, root), 30)


@query(
    "bars_since",
    f"""WITH {BARS} SELECT * FROM bars
    WHERE symbol IN ('1-URGENT', '3-MEDIUM') AND d >= DATE '1997-01-01'""",
)
def bars_since(spark, root):
    return files.load_bars(views.bars(spark, root), ["1-URGENT", "3-MEDIUM"], "1997-01-01")


@query(
    "days_since_start",
    f"""WITH {BARS} SELECT symbol, d, close,
      CAST(d - min(d) OVER (PARTITION BY symbol) AS INT) AS days_since_start FROM bars""",
)
def days_since_start(spark, root):
    return bar_ops.days_since_start(views.bars(spark, root)).select(
        *KEY, "close", "days_since_start"
    )


# ---------------------------------------------------------------- row features


@query(
    "price_features",
    f"""WITH {BARS} SELECT symbol, d, {sql_columns({
        "price_change": "close - open", "price_range": "high - low",
        "typical_price": "(open + high + low + close) / 4",
        "hlc_price": "(high + low + close) / 3"})} FROM bars""",
)
def price_features_query(spark, root):
    df = views.bars(spark, root).withColumns(price_features())
    return snapped(df.select(*KEY, *price_features()), KEY)


@query(
    "peg_deviation",
    f"""WITH {PEG_BARS} SELECT symbol, d, {sql_columns({
        "price_deviation": "abs(close - 1)", "percentage_deviation": "abs(close - 1) * 100",
        "true_range": "high - low"}, 5)},
      {sql_columns({"volume_to_market_cap_ratio": "volume / market_cap"}, 9)} FROM peg_bars""",
)
def peg_deviation(spark, root):
    df = views.peg_bars(spark, root).withColumns(peg_features())
    return snapped(df.select(*KEY, *peg_features()), KEY, 5, volume_to_market_cap_ratio=9)


@query(
    "rolling_peg_vol",
    f"""WITH {PEG_BARS} SELECT symbol, d, {sql_columns({
        "rolling_std_dev": '''stddev_samp(close) OVER (PARTITION BY symbol ORDER BY d
            ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)'''}, 8)},
      {sql_columns({
        "volume_change": "volume / lag(volume) OVER w - 1",
        "market_cap_change": "market_cap / lag(market_cap) OVER w - 1"}, 8)}
    FROM peg_bars WINDOW w AS (PARTITION BY symbol ORDER BY d)""",
)
def rolling_peg_vol(spark, root):
    s = whole(views.peg_bars(spark, root))
    s = s.add({"rolling_std_dev": ind.rolling_std(s, "close", 10)})
    s = ind.padded_pct_change(s, {"volume": "volume_change", "market_cap": "market_cap_change"})
    out = s.rows().select(*KEY, "rolling_std_dev", "volume_change", "market_cap_change")
    return snapped(out, KEY, 8)


# ---------------------------------------------------------------- windows

W = "OVER (PARTITION BY symbol ORDER BY d)"


def rows(n: int, key: str = "symbol", order: str = "d") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def upto(key: str = "symbol", order: str = "d") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def full(n: int, column: str, expr: str, **kw: str) -> str:
    return f"CASE WHEN count({column}) {rows(n, **kw)} >= {n} THEN {expr} END"


def _bars(spark, root):
    return whole(views.bars(spark, root))


def _over_bars(columns: dict[str, str], places: int = 4, source: str = "bars", **override: int) -> str:
    return (
        f"WITH {NUM} SELECT symbol, d, {sql_columns(columns, places, **override)} "
        f"FROM {source if source != 'bars' else 'num'}"
    )


@query(
    "returns",
    _over_bars(
        {
            "daily_return": f"close / lag(close) {W} - 1",
            "cumulative_return": f"CASE WHEN rn > 0 THEN close / first_value(close) {upto()} - 1 END",
        },
        8,
    ),
)
def returns(spark, root):
    s = ind.padded_pct_change(_bars(spark, root), {"close": "daily_return"})
    out = ind.cumulative_return(s).rows()
    return snapped(out.select(*KEY, "daily_return", "cumulative_return"), KEY, 8)


@query(
    "diffs",
    _over_bars(
        {
            "price_momentum": f"close - lag(close) {W}",
            "volume_change": f"volume - lag(volume) {W}",
            "mkcap_change": f"market_cap - lag(market_cap) {W}",
        },
        2,
    ),
)
def diffs(spark, root):
    s = _bars(spark, root)
    names = {"price_momentum": "close", "volume_change": "volume", "mkcap_change": "market_cap"}
    out = s.add({n: ind.diff(s, c) for n, c in names.items()}).rows()
    return snapped(out.select(*KEY, *names), KEY, 2)


@query(
    "lags",
    _over_bars(
        {
            "prev_close": f"lag(close) {W}",
            "prev_price_change": f"lag(close - open) {W}",
            "prev_volume": f"lag(volume) {W}",
        },
        2,
    ),
)
def lags(spark, root):
    s = _bars(spark, root).add({"price_change": F.col("close") - F.col("open")})
    cols = {
        "prev_close": "close",
        "prev_price_change": "price_change",
        "prev_volume": "volume",
    }
    out = s.add({n: ind.lag(s, c) for n, c in cols.items()}).rows()
    return snapped(out.select(*KEY, *cols), KEY, 2)


@query("sma_partial", _over_bars({f"ma_{n}": f"avg(close) {rows(n)}" for n in ind.SMA_SPANS}))
def sma_partial(spark, root):
    s = _bars(spark, root)
    cols = {f"ma_{n}": ind.sma(s, "close", n) for n in ind.SMA_SPANS}
    return snapped(s.add(cols).rows().select(*KEY, *cols), KEY)


FULL_SPANS = (3, 7, 20, 30)


@query(
    "sma_full",
    _over_bars({f"ma_{n}": full(n, "close", f"avg(close) {rows(n)}") for n in FULL_SPANS}),
)
def sma_full(spark, root):
    s = _bars(spark, root)
    cols = {f"ma_{n}": ind.sma(s, "close", n, full=True) for n in FULL_SPANS}
    return snapped(s.add(cols).rows().select(*KEY, *cols), KEY)


@query(
    "rolling_std",
    _over_bars(
        {f"std_{n}": f"stddev_samp(close) {rows(n)}" for n in (10, 20, 50)}
        | {"std_full_20": full(20, "close", f"stddev_samp(close) {rows(20)}")},
        2,
    ),
)
def rolling_std(spark, root):
    s = _bars(spark, root)
    cols = {f"std_{n}": ind.rolling_std(s, "close", n) for n in (10, 20, 50)}
    cols["std_full_20"] = ind.rolling_std(s, "close", 20, full=True)
    return snapped(s.add(cols).rows().select(*KEY, *cols), KEY, 2)


ALL_WMA = (5, 7, 12, 14, 20, 26, 50, 100, 200)


def _wma_sql(n: int, x: str = "close", key: str = "symbol", order: str = "d") -> str:
    return full(
        n,
        x,
        f"(sum(rn * {x}) {rows(n, key, order)} - (rn - {n}) * sum({x}) {rows(n, key, order)})"
        f" / {n * (n + 1) // 2}",
        key=key,
        order=order,
    )


@query("wma", _over_bars({f"wma_{n}": _wma_sql(n) for n in ALL_WMA}, 2))
def wma(spark, root):
    s = _bars(spark, root)
    cols = {f"wma_{n}": ind.wma(s, "close", n) for n in ALL_WMA}
    return snapped(s.add(cols).rows().select(*KEY, *cols), KEY, 2)


def recursive(columns: dict[str, tuple[str, str, str]], source: str = "num") -> str:
    """CTE ``rec``: name -> (start value, drive, decay), one pass over row numbers."""
    start = ", ".join(f"CAST({a} AS DOUBLE) AS {n}" for n, (a, _, _) in columns.items())
    step = ", ".join(f"({w}) + r.{n} * {b}" for n, (_, w, b) in columns.items())
    return f"""rec AS (
  SELECT symbol, rn, {start} FROM {source} n WHERE rn = 0
  UNION ALL
  SELECT n.symbol, n.rn, {step} FROM rec r JOIN {source} n
    ON n.symbol = r.symbol AND n.rn = r.rn + 1)"""


def ema_rec(x: str, span: int) -> tuple[str, str, str]:
    return (f"n.{x}", f"n.{x} * (2.0::DOUBLE / {span + 1})", f"(1 - 2.0::DOUBLE / {span + 1})")


def alpha_rec(x: str, n: int) -> tuple[str, str, str]:
    return (f"n.{x}", f"n.{x} * (1.0::DOUBLE / {n})", f"(1 - 1.0::DOUBLE / {n})")


EMA_ALL = (7, 14, 20, 28, 50, 100, 200)


@query(
    "ema",
    f"""WITH RECURSIVE {NUM}, {recursive({f"ema_{n}": ema_rec("close", n) for n in EMA_ALL})}
    SELECT n.symbol, n.d, {sql_columns({f"ema_{n}": f"ema_{n}" for n in EMA_ALL}, 2)}
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def ema(spark, root):
    s = ind.emas(_bars(spark, root), {f"ema_{n}": ("close", n) for n in EMA_ALL})
    return snapped(s.rows().select(*KEY, *[f"ema_{n}" for n in EMA_ALL]), KEY, 2)


GAP_SPANS = (7, 26)


def _gap_ema_sql() -> str:
    keep = {n: f"pow({1 - 2 / (n + 1)!r}::DOUBLE, r.gap)" for n in GAP_SPANS}
    alpha = {n: f"{2 / (n + 1)!r}::DOUBLE" for n in GAP_SPANS}
    steps = ", ".join(
        f"CASE WHEN g.close IS NULL THEN r.ema_{n} "
        f"ELSE ({keep[n]} * r.ema_{n} + {alpha[n]} * g.close) / ({keep[n]} + {alpha[n]}) END"
        for n in GAP_SPANS
    )
    return f"""WITH RECURSIVE {BARS}, ends AS (SELECT symbol, min(d) AS lo, max(d) AS hi FROM bars GROUP BY 1),
    spine AS (SELECT symbol, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d FROM ends),
    grid AS MATERIALIZED (
      SELECT s.symbol, s.d, close, row_number() OVER (PARTITION BY s.symbol ORDER BY s.d) AS rn
      FROM spine s LEFT JOIN bars b ON b.symbol = s.symbol AND b.d = s.d),
    rec AS (
      SELECT symbol, d, rn, 1 AS gap, {", ".join(f"close AS ema_{n}" for n in GAP_SPANS)} FROM grid WHERE rn = 1
      UNION ALL
      SELECT g.symbol, g.d, g.rn, CASE WHEN g.close IS NULL THEN r.gap + 1 ELSE 1 END, {steps}
      FROM rec r JOIN grid g ON g.symbol = r.symbol AND g.rn = r.rn + 1)
    SELECT symbol, d, {sql_columns({f"ema_{n}": f"ema_{n}" for n in GAP_SPANS}, 2)} FROM rec"""


@query("ema_over_gaps", _gap_ema_sql())
def ema_over_gaps(spark, root):
    """On the daily grid, whose days without a bar have no close."""
    s = whole(bar_ops.daily_grid(views.bars(spark, root)).select(*KEY, "close"))
    s = ind.emas_over_gaps(s, {f"ema_{n}": ("close", n) for n in GAP_SPANS})
    return snapped(s.rows().select(*KEY, *[f"ema_{n}" for n in GAP_SPANS]), KEY, 2)


@query(
    "macd",
    f"""WITH RECURSIVE {NUM},
    {recursive({"f": ema_rec("close", 12), "s": ema_rec("close", 26)})},
    m AS MATERIALIZED (SELECT symbol, rn - 25 AS rn, f - s AS macd FROM rec WHERE rn >= 25),
    sig AS (
      SELECT symbol, rn, macd AS signal FROM m WHERE rn = 0
      UNION ALL
      SELECT m.symbol, m.rn, m.macd * 0.2::DOUBLE + g.signal * 0.8::DOUBLE
      FROM sig g JOIN m ON m.symbol = g.symbol AND m.rn = g.rn + 1),
    j AS (SELECT n.symbol, n.d, m.macd, CASE WHEN g.rn >= 8 THEN g.signal END AS macd_signal
      FROM num n LEFT JOIN m ON m.symbol = n.symbol AND m.rn + 25 = n.rn
      LEFT JOIN sig g ON g.symbol = n.symbol AND g.rn + 25 = n.rn)
    SELECT symbol, d, {sql_columns({"macd": "macd", "macd_signal": "macd_signal",
                                    "macd_hist": "macd - macd_signal"}, 2)} FROM j""",
)
def macd(spark, root):
    s = ind.macd(_bars(spark, root), signal=9)
    return snapped(s.rows().select(*KEY, "macd", "macd_signal", "macd_hist"), KEY, 2)


# ---------------------------------------------------------------- volume, ranges


@query(
    "vwap_cumulative",
    _over_bars(
        {"vwap": f"sum((open + high + low + close) / 4 * volume) {upto()} / sum(volume) {upto()}"}, 2
    ),
)
def vwap_cumulative(spark, root):
    s = ind.cumulative_vwap(_bars(spark, root).add(price_features()))
    return snapped(s.rows().select(*KEY, "vwap"), KEY, 2)


VWAP14 = full(
    14, "close", f"sum((high + low + close) / 3 * volume) {rows(14)} / sum(volume) {rows(14)}"
)


@query("vwap_rolling", _over_bars({"vwap": VWAP14}, 2))
def vwap_rolling(spark, root):
    s = _bars(spark, root).add(price_features())
    return snapped(s.add({"vwap": ind.rolling_vwap(s)}).rows().select(*KEY, "vwap"), KEY, 2)


TR = NUM + f""", tr AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr
  FROM (SELECT *, lag(close) {W} AS pc FROM num)),
tr14 AS MATERIALIZED (SELECT *, {full(14, "tr", f"avg(tr) {rows(14)}")} AS atr_ma14 FROM tr)"""


def _tr(spark, root):
    s = _bars(spark, root)
    s = s.add({"previous_close": ind.lag(s, "close")})
    return s.add({"tr": ind.true_range(s)})


@query("true_range", f"WITH {TR} SELECT symbol, d, {sql_columns({'tr': 'tr'}, 2)} FROM tr")
def true_range(spark, root):
    return snapped(_tr(spark, root).rows().select(*KEY, "tr"), KEY, 2)


@query("atr_sma", f"WITH {TR} SELECT symbol, d, {sql_columns({'atr_ma14': 'atr_ma14'})} FROM tr14")
def atr_sma(spark, root):
    s = _tr(spark, root)
    s = s.add({"atr_ma14": ind.sma(s, "tr", 14, full=True)})
    return snapped(s.rows().select(*KEY, "atr_ma14"), KEY)


@query(
    "atr_ema",
    f"""WITH RECURSIVE {TR}, {recursive({"atr_ema14": ema_rec("tr", 14)}, "tr")}
    SELECT n.symbol, n.d, {sql_columns({"atr_ema14": "atr_ema14"}, 2)}
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def atr_ema(spark, root):
    s = ind.emas(_tr(spark, root), {"atr_ema14": ("tr", 14)})
    return snapped(s.rows().select(*KEY, "atr_ema14"), KEY, 2)


ATR_REC = (
    "0",
    "CASE WHEN n.rn < 13 THEN 0 WHEN n.rn = 13 THEN n.atr_ma14 ELSE n.tr / 14 END",
    "(13.0::DOUBLE / 14)",
)


@query(
    "atr_wilder",
    f"""WITH RECURSIVE {TR}, {recursive({"atr": ATR_REC}, "tr14")}
    SELECT n.symbol, n.d, {sql_columns({"atr": "CASE WHEN n.rn >= 13 THEN atr END"}, 2)}
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def atr_wilder(spark, root):
    return snapped(ind.atr_wilder(_tr(spark, root)).rows().select(*KEY, "atr"), KEY, 2)


# ---------------------------------------------------------------- strength index


def rsi_sql(g: str, l: str, flat: str = "NULL") -> str:
    return (
        f"CASE WHEN {g} = 0 AND {l} = 0 THEN {flat} WHEN {l} = 0 THEN 100.0 "
        f"ELSE 100 - 100 / (1 + {g} / {l}) END"
    )


def gl(change: str) -> str:
    return f"""{NUM}, chg AS (SELECT *, coalesce({change}, 0) AS c FROM num),
    gl AS MATERIALIZED (SELECT *, greatest(c, 0) AS gain, greatest(-c, 0) AS loss FROM chg),
    m AS (SELECT symbol, d, rn, avg(gain) {rows(14)} AS g, avg(loss) {rows(14)} AS l FROM gl)"""


@query(
    "rsi_intraday",
    f"WITH {gl('close - open')} SELECT symbol, d, {sql_columns({'rsi': rsi_sql('g', 'l')})} FROM m",
)
def rsi_intraday(spark, root):
    s = _bars(spark, root).add({"price_change": F.col("close") - F.col("open")})
    s = ind.rsi(s.add(ind.gain_loss("price_change")))
    return snapped(s.rows().select(*KEY, "rsi"), KEY)


DELTA = f"close - lag(close) {W}"


def _delta(spark, root):
    s = _bars(spark, root)
    s = s.add({"delta": ind.diff(s, "close")})
    return s.add(ind.gain_loss("delta"))


@query(
    "rsi_partial",
    f"WITH {gl(DELTA)} SELECT symbol, d, {sql_columns({'rsi': rsi_sql('g', 'l')})} FROM m",
)
def rsi_partial(spark, root):
    return snapped(ind.rsi(_delta(spark, root)).rows().select(*KEY, "rsi"), KEY)


@query(
    "rsi_full",
    f"""WITH {gl(DELTA)} SELECT symbol, d,
    {sql_columns({'rsi': f"CASE WHEN rn >= 13 THEN {rsi_sql('g', 'l')} END"})} FROM m""",
)
def rsi_full(spark, root):
    return snapped(ind.rsi(_delta(spark, root), full=True).rows().select(*KEY, "rsi"), KEY)


@query(
    "rsi_wilder",
    f"""WITH RECURSIVE {gl(DELTA)}, {recursive({"g": alpha_rec("gain", 14), "l": alpha_rec("loss", 14)}, "gl")}
    SELECT n.symbol, n.d,
      {sql_columns({"rsi": f"CASE WHEN n.rn >= 13 THEN {rsi_sql('g', 'l', '100.0')} END"})}
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def rsi_wilder(spark, root):
    return snapped(ind.rsi_wilder(_delta(spark, root)).rows().select(*KEY, "rsi"), KEY)


# ---------------------------------------------------------------- bands


def bands_sql(std: str, is_full: bool) -> dict[str, str]:
    mid, dev = f"avg(close) {rows(20)}", f"{std}(close) {rows(20)}"
    wrap = (lambda e: full(20, "close", e)) if is_full else (lambda e: e)
    return {
        "middle_band": wrap(mid),
        "upper_band": wrap(f"{mid} + 2 * {dev}"),
        "lower_band": wrap(f"{mid} - 2 * {dev}"),
    }


def _bands(spark, root, **kw):
    s = _bars(spark, root)
    cols = ind.bollinger(s, **kw)
    return snapped(s.add(cols).rows().select(*KEY, *cols), KEY, 2)


@query("bollinger_sample", _over_bars(bands_sql("stddev_samp", False), 2))
def bollinger_sample(spark, root):
    return _bands(spark, root)


@query("bollinger_pop", _over_bars(bands_sql("stddev_pop", False), 2))
def bollinger_pop(spark, root):
    return _bands(spark, root, population=True)


@query("bollinger_full", _over_bars(bands_sql("stddev_samp", True), 2))
def bollinger_full(spark, root):
    return _bands(spark, root, full=True)


# ---------------------------------------------------------------- composites

SET_PLAIN = {
    "price_change": "close - open",
    "price_range": "high - low",
    "price_momentum": f"close - lag(close) {W}",
    "volume_change": f"volume - lag(volume) {W}",
    "mkcap_change": f"market_cap - lag(market_cap) {W}",
    "vwap": VWAP14,
    "daily_return": f"close / lag(close) {W} - 1",
    "cumulative_return": f"CASE WHEN rn > 0 THEN close / first_value(close) {upto()} - 1 END",
    **{f"ma_{n}": f"avg(close) {rows(n)}" for n in ind.SMA_SPANS},
    **{f"wma_{n}": _wma_sql(n) for n in ind.WMA_SPANS},
    **{f"std_{n}": f"stddev_samp(close) {rows(n)}" for n in ind.STD_SPANS},
    "upper_band": bands_sql("stddev_pop", False)["upper_band"],
    "lower_band": bands_sql("stddev_pop", False)["lower_band"],
}
SET_RECS = {
    **{f"ema_{n}": ema_rec("close", n) for n in ind.EMA_SPANS},
    "f": ema_rec("close", 12),
    "s": ema_rec("close", 26),
    "g": alpha_rec("gain", 14),
    "l": alpha_rec("loss", 14),
    "atr": ATR_REC,
}


@query(
    "indicator_set",
    f"""WITH RECURSIVE {TR},
    gl AS MATERIALIZED (SELECT *, greatest(c, 0) AS gain, greatest(-c, 0) AS loss
      FROM (SELECT *, coalesce(close - pc, 0) AS c FROM tr14)),
    {recursive(SET_RECS, "gl")},
    plain AS (SELECT symbol, d, rn, tr, {", ".join(f"{e} AS {n}" for n, e in SET_PLAIN.items())} FROM gl)
    SELECT p.symbol, p.d, {sql_columns({
        **{n: f"coalesce(p.{n}, 0)" for n in [*SET_PLAIN, "tr"]},
        **{f"ema_{n}": f"r.ema_{n}" for n in ind.EMA_SPANS},
        "macd": "CASE WHEN p.rn >= 25 THEN r.f - r.s ELSE 0 END",
        "atr": "CASE WHEN p.rn >= 13 THEN r.atr ELSE 0 END",
        "rsi": f"CASE WHEN p.rn >= 13 THEN {rsi_sql('r.g', 'r.l', '100.0')} ELSE 0 END"}, 2)}
    FROM plain p JOIN rec r ON r.symbol = p.symbol AND r.rn = p.rn""",
)
def indicator_set(spark, root):
    out = ind.indicator_set(_bars(spark, root)).rows()
    keep = [
        *SET_PLAIN,
        "tr",
        *[f"ema_{n}" for n in ind.EMA_SPANS],
        "macd",
        "atr",
        "rsi",
    ]
    return snapped(out.select(*KEY, *keep).na.fill(0.0), KEY, 2)


FEATURES = {
    "vwap": f"sum((open + high + low + close) / 4 * volume) {upto()} / sum(volume) {upto()}",
    **{f"wma_{n}": _wma_sql(n) for n in (20, 50, 100, 200)},
    "bollinger_upper": bands_sql("stddev_samp", False)["upper_band"],
    "bollinger_lower": bands_sql("stddev_samp", False)["lower_band"],
}


@query(
    "feature_set",
    f"""WITH RECURSIVE {TR}, {recursive({
        **{f"ema_{n}": ema_rec("close", n) for n in (20, 50, 100, 200)},
        "atr_ema14": ema_rec("tr", 14)}, "tr14")},
    gl AS (SELECT symbol, d, rn, avg(greatest(close - open, 0)) {rows(14)} AS g,
                  avg(greatest(open - close, 0)) {rows(14)} AS l FROM num),
    plain AS (SELECT symbol, d, rn, atr_ma14, {", ".join(f"{e} AS {n}" for n, e in FEATURES.items())}
      FROM tr14)
    SELECT p.symbol, p.d, {sql_columns({
        **{n: f"p.{n}" for n in [*FEATURES, "atr_ma14"]},
        **{f"ema_{n}": f"r.ema_{n}" for n in (20, 50, 100, 200)},
        "atr_ema14": "r.atr_ema14", "rsi": rsi_sql("x.g", "x.l")}, 2)}
    FROM plain p JOIN rec r ON r.symbol = p.symbol AND r.rn = p.rn
    JOIN gl x ON x.symbol = p.symbol AND x.rn = p.rn""",
)
def feature_set(spark, root):
    out = ind.feature_set(_bars(spark, root)).rows()
    keep = [
        *FEATURES,
        "atr_ma14",
        *[f"ema_{n}" for n in (20, 50, 100, 200)],
        "atr_ema14",
        "rsi",
    ]
    return snapped(out.select(*KEY, *keep), KEY, 2)


@query(
    "forecast_features",
    f"""WITH {gl(DELTA)}, f AS (
      SELECT n.symbol, n.d, {full(3, "close", f"avg(close) {rows(3)}")} AS moving_avg,
        {", ".join(f"{e} AS {n}" for n, e in bands_sql("stddev_samp", True).items())},
        lag(close) {W} AS prev_close, lag(close - open) {W} AS prev_price_change,
        lag(volume) {W} AS prev_volume FROM num n),
    r AS (SELECT symbol, d, {rsi_sql('g', 'l')} AS rsi FROM m)
    SELECT f.symbol, f.d, {sql_columns({c: c for c in (
        "moving_avg", "middle_band", "upper_band", "lower_band", "prev_close",
        "prev_price_change", "prev_volume", "rsi")}, 2)}
    FROM f JOIN r ON r.symbol = f.symbol AND r.d = f.d
    WHERE moving_avg IS NOT NULL AND rsi IS NOT NULL AND middle_band IS NOT NULL
      AND prev_close IS NOT NULL""",
)
def forecast_features(spark, root):
    out = ind.forecast_features(_bars(spark, root))
    keep = [
        "moving_avg",
        "middle_band",
        "upper_band",
        "lower_band",
        "prev_close",
        "prev_price_change",
        "prev_volume",
        "rsi",
    ]
    return snapped(out.select(*KEY, *keep), KEY, 2)


# ---------------------------------------------------------------- long series
# The same operators on raw ticks, whose series have no length bound: row blocks
# with halos instead of one window partition per symbol.

TNUM = TICKS + """, num AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, event_id) - 1 AS rn FROM ticks)"""
TORD = {"key": "symbol", "order": "rn"}


def _ticks(spark, root, lookback):
    df = views.ticks(spark, root).withColumnRenamed("value", "close")
    return blocked(df, ["symbol"], ["ts", "event_id"], lookback=lookback)


def _tick_out(df, places=4):
    keep = [c for c in df.columns if c not in ("ts", "close")]
    return snapped(df.select(*keep), ["symbol", "event_id"], places)


@query(
    "tick_windows",
    f"""WITH {TNUM} SELECT symbol, event_id, {sql_columns({
        "change": "value / lag(value) OVER (PARTITION BY symbol ORDER BY rn) - 1",
        "ma_50": f"avg(value) {rows(50, **TORD)}",
        "std_20": f"stddev_samp(value) {rows(20, **TORD)}",
        "wma_26": _wma_sql(26, "value", "symbol", "rn")})} FROM num""",
)
def tick_windows(spark, root):
    s = _ticks(spark, root, 64)
    s = s.add(
        {
            "change": ind.pct_change(s, "close"),
            "ma_50": ind.sma(s, "close", 50),
            "std_20": ind.rolling_std(s, "close", 20),
            "wma_26": ind.wma(s, "close", 26),
        }
    )
    return _tick_out(s.rows())


@query(
    "tick_ema",
    f"""WITH RECURSIVE {TNUM}, {recursive({f"ema_{n}": ema_rec("value", n) for n in (7, 14, 28)})}
    SELECT n.symbol, n.event_id, {sql_columns({f"ema_{n}": f"ema_{n}" for n in (7, 14, 28)})}
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def tick_ema(spark, root):
    s = ind.emas(_ticks(spark, root, 1200), {f"ema_{n}": ("close", n) for n in (7, 14, 28)})
    return _tick_out(s.rows())


@query(
    "tick_rsi",
    f"""WITH RECURSIVE {TNUM}, gl AS MATERIALIZED (
      SELECT *, greatest(c, 0) AS gain, greatest(-c, 0) AS loss FROM (
        SELECT *, coalesce(value - lag(value) OVER (PARTITION BY symbol ORDER BY rn), 0) AS c FROM num)),
    {recursive({"g": alpha_rec("gain", 14), "l": alpha_rec("loss", 14)}, "gl")}
    SELECT n.symbol, n.event_id,
      {sql_columns({"rsi": f"CASE WHEN n.rn >= 13 THEN {rsi_sql('g', 'l', '100.0')} END"})}
    FROM rec r JOIN num n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def tick_rsi(spark, root):
    s = _ticks(spark, root, 1200)
    s = s.add({"delta": ind.diff(s, "close")})
    s = ind.rsi_wilder(s.add(ind.gain_loss("delta")))
    return _tick_out(s.rows("delta", "gain", "loss"))


@query(
    "tick_running_mean",
    f"""WITH {TNUM} SELECT symbol, event_id, {sql_columns({
        "running_mean": f"sum(value) {upto('symbol', 'rn')} / count(*) {upto('symbol', 'rn')}",
        "since_first": f"CASE WHEN rn > 0 THEN value / first_value(value) {upto('symbol', 'rn')} - 1 END"})}
    FROM num""",
)
def tick_running_mean(spark, root):
    s = _ticks(spark, root, 1)
    s = running_sums(s, {"_s": F.col("close"), "_n": F.lit(1.0)})
    s = ind.cumulative_return(s.add({"running_mean": F.col("_s") / F.col("_n")}), name="since_first")
    return _tick_out(s.rows("_s", "_n"))


@query(
    "threshold_signal",
    f"""WITH {NUM} SELECT symbol, d, {sql_snap("close", 2)} AS close,
      CASE WHEN close <= 50000 THEN 'buy' WHEN close >= 250000 THEN 'sell' END AS signal
    FROM num""",
)
def threshold_signal(spark, root):
    df = views.bars(spark, root)
    return df.select(
        *KEY,
        snap(F.col("close"), 2).alias("close"),
        trade_signal(F.col("close"), 50000.0, 250000.0).alias("signal"),
    )


@query(
    "chrono_split",
    f"""WITH {NUM} SELECT symbol, d,
      CASE WHEN rn < n - CAST(ceil(n * 0.2) AS BIGINT) THEN 'train' ELSE 'test' END AS part
    FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM num)""",
)
def chrono_split(spark, root):
    return tables.chrono_split(_bars(spark, root)).select(*KEY, "part")


@query(
    "test_rows",
    f"""WITH {NUM}, t AS (SELECT symbol, d, rn, count(*) OVER (PARTITION BY symbol) AS n FROM num)
    SELECT * FROM bars b SEMI JOIN (SELECT * FROM t WHERE rn >= n - CAST(ceil(n * 0.2) AS BIGINT)) t
      ON t.symbol = b.symbol AND t.d = b.d""",
)
def test_rows(spark, root):
    split = tables.chrono_split(_bars(spark, root)).filter(F.col("part") == "test")
    return tables.select_keys(views.bars(spark, root), split, KEY)


@query(
    "ewma_vol",
    f"""WITH RECURSIVE {NUM}, ret AS MATERIALIZED (
      SELECT symbol, d, rn - 1 AS rn, x * x AS r2
      FROM (SELECT *, close / lag(close) {W} - 1 AS x FROM num) WHERE rn > 0),
    {recursive({"v": ("n.r2", "n.r2 * 0.06::DOUBLE", "0.94::DOUBLE")}, "ret")}
    SELECT n.symbol, n.d, {sql_columns({"ewma_vol": "sqrt(v)"}, 6)}
    FROM rec r JOIN ret n ON n.symbol = r.symbol AND n.rn = r.rn""",
)
def ewma_vol(spark, root):
    from candlewick.operators.volatility import ewma_volatility

    out = ewma_volatility(_bars(spark, root))
    return snapped(out.select(*KEY, "ewma_vol"), KEY, 6)
