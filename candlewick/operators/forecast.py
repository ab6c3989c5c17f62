"""Forecasts for many daily series at once.

Two-stage least squares (Hannan and Rissanen 1982): a long autoregression yields
residuals, then the series is regressed on its own lags, residual lags, seasonal
lags and outside columns. Spark builds the lagged rows and their Gram sums; what
reaches Python is one small row per symbol. Series are daily, so the calendar
bounds their length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewick.operators import indicators as ind
from candlewick.operators.bars import filled_grid
from candlewick.operators.regress import gram, per_key, solve_scaled
from candlewick.operators.series import RN, Series, whole
from candlewick.operators.tables import chrono_split
from candlewick.operators.volatility import garch_fit, garch_forecast, garch_path
from candlewick.session import settle

Z95 = 1.96


@dataclass(frozen=True)
class Order:
    """Orders of a seasonal model; ``exog`` names outside columns."""

    p: int = 1
    d: int = 1
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0
    exog: tuple[str, ...] = field(default=())

    @property
    def ar_lags(self) -> list[int]:
        return _lags(self.p, self.P, self.s)

    @property
    def ma_lags(self) -> list[int]:
        return _lags(self.q, self.Q, self.s)

    @property
    def difference(self) -> np.ndarray:
        """Coefficients of (1 - B)^d (1 - B^s)^D."""
        poly = np.array([1.0])
        for _ in range(self.d):
            poly = np.convolve(poly, [1.0, -1.0])
        for _ in range(self.D):
            poly = np.convolve(poly, [1.0, *[0.0] * (self.s - 1), -1.0])
        return poly

    @property
    def long_ar(self) -> int:
        """Length of the first-stage autoregression."""
        return max(20, max(self.ma_lags, default=0) + 4)


def _lags(n: int, seasonal: int, period: int) -> list[int]:
    own = range(1, n + 1)
    far = [period * k + j for k in range(1, seasonal + 1) for j in (0, *own)]
    return sorted({*own, *far})


def _differenced(s: Series, column: str, poly: np.ndarray) -> Column:
    value = F.col(column)
    for k, c in enumerate(poly):
        if k and c:
            value = value + float(c) * ind.lag(s, column, k)
    return value


@dataclass(frozen=True)
class Fitted:
    """Laid-out rows with ``w``, ``e`` and ``resid``, and one coefficient row per symbol."""

    series: Series
    coef: DataFrame
    order: Order


def _solve(df: DataFrame, k: int) -> DataFrame:
    """Least squares from Gram rows whose last entry is the target."""

    def solve(row: pd.Series) -> dict:
        g, n = np.asarray(row["g"]).reshape(k + 1, k + 1), int(row["n"])
        a, b = g[:k, :k], g[:k, k]
        beta, rank = solve_scaled(a, b)
        sse = max(float(g[k, k] - 2 * beta @ b + beta @ a @ beta), 0.0)
        return {
            "symbol": row["symbol"],
            "n": n,
            "rank": rank,
            "beta": beta,
            "sigma2": sse / max(n - rank, 1),
        }

    schema = "symbol string, n bigint, rank int, beta array<double>, sigma2 double"
    return settle(per_key(gram(df), solve, schema))


def _dot(a: Column, b: Column) -> Column:
    product = F.zip_with(a, b, lambda x, y: x * y)
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def _history(s: Series, column: str, n: int) -> Column:
    """The n values before the current row, newest first; shorter if unknown."""
    return F.reverse(F.collect_list(column).over(s.ordered.rowsBetween(-n, -1)))


def _complete(column: str, n: int) -> Column:
    return F.col(column) if n == 0 else F.when(F.size(column) == n, F.col(column))


def fit(df: DataFrame, order: Order, target: str = "close") -> Fitted:
    """Estimate ``order`` for every symbol of a gap-free daily table."""
    s = whole(df.select("symbol", "d", F.col(target).alias("y"), *order.exog))
    poly = order.difference
    s = s.add(
        {
            "w": _differenced(s, "y", poly),
            **{f"x_{c}": _differenced(s, c, poly) for c in order.exog},
        }
    )
    # Differences without a full history are NULL, so history arrays stay short there.
    outside = [F.col(f"x_{c}") for c in order.exog]
    if order.ma_lags:
        k = order.long_ar
        s = s.add({"_h": _history(s, "w", k)})
        s = s.add({"_x": F.when(F.size("_h") == k, F.concat(F.array(F.lit(1.0)), "_h"))})
        rows = s.df.filter(F.col("_x").isNotNull())
        long = _solve(rows.select("symbol", F.concat("_x", F.array("w")).alias("x")), k + 1)
        phi = long.select("symbol", F.col("beta").alias("_phi"))
        joined = s.df.join(phi, "symbol", "left").withColumn(
            "e", F.col("w") - _dot(F.col("_x"), F.col("_phi"))
        )
        s = Series(joined.drop("_h", "_x", "_phi"), s.key, s.order, s.parts)
    else:
        s = s.add({"e": F.lit(None).cast("double")})
    top_ar, top_ma = max(order.ar_lags, default=0), max(order.ma_lags, default=0)
    s = s.add({"_hw": _history(s, "w", max(top_ar, 1)), "_he": _history(s, "e", max(top_ma, 1))})
    ready = (F.size("_hw") >= top_ar) & (F.size("_he") >= top_ma)
    vector = F.array(
        F.lit(1.0),
        *[F.get("_hw", F.lit(i - 1)) for i in order.ar_lags],
        *[F.get("_he", F.lit(j - 1)) for j in order.ma_lags],
        *outside,
    )
    known = ready & F.col("w").isNotNull()
    for c in outside:
        known = known & c.isNotNull()
    s = s.add({"_v": F.when(known, vector)}).drop("_hw", "_he")
    design = s.df.filter(F.col("_v").isNotNull())
    k = 1 + len(order.ar_lags) + len(order.ma_lags) + len(order.exog)
    coef = _solve(design.select("symbol", F.concat("_v", F.array("w")).alias("x")), k)
    joined = s.df.join(coef.select("symbol", "beta", "sigma2"), "symbol", "left").withColumn(
        "resid", F.col("w") - _dot(F.col("_v"), F.col("beta"))
    )
    return Fitted(Series(joined.drop("_v", "beta"), s.key, s.order, s.parts), coef, order)


def in_sample(model: Fitted) -> DataFrame:
    """One-step predictions over the history with a 95 % band."""
    band = Z95 * F.sqrt("sigma2")
    predicted = F.col("y") - F.col("resid")
    return model.series.rows().filter(F.col("resid").isNotNull()).select(
        "symbol",
        "d",
        F.col("y").alias("actual"),
        predicted.alias("predicted_price"),
        (predicted - band).alias("lower_conf_int"),
        (predicted + band).alias("upper_conf_int"),
    )


def _tail(model: Fitted, horizon: int) -> DataFrame:
    """The few last rows of each symbol a forecast starts from, as one array."""
    order = model.order
    need = max(
        [len(order.difference), horizon + len(order.difference), *order.ar_lags, *order.ma_lags]
    )
    ends = model.series.df.groupBy("symbol").agg(F.max(RN).alias("_end"))
    fields = ["y", "w", "e", *order.exog]
    return (
        model.series.df.join(ends, "symbol")
        .filter(F.col(RN) > F.col("_end") - need)
        .groupBy("symbol")
        .agg(
            F.max("d").alias("last_d"),
            F.array_sort(F.collect_list(F.struct(RN, *fields))).alias("tail"),
        )
        .select("symbol", "last_d", *[F.col("tail").getField(f).alias(f"t_{f}") for f in fields])
    )


def psi_weights(ar: dict[int, float], ma: dict[int, float], poly: np.ndarray, n: int) -> np.ndarray:
    """Weights of past shocks in a forecast, differencing included."""
    own = np.zeros(max(ar, default=0) + 1)
    own[0] = 1.0
    for lag, v in ar.items():
        own[lag] = -v
    full = np.convolve(own, poly)
    psi = np.zeros(n)
    psi[0] = 1.0
    for j in range(1, n):
        back = min(j, len(full) - 1)
        psi[j] = ma.get(j, 0.0) - full[1 : back + 1] @ psi[j - 1 :: -1][:back]
    return psi


def forecast(model: Fitted, horizon: int) -> DataFrame:
    """(symbol, d, step, predicted_price, lower_conf_int, upper_conf_int).

    Outside columns repeat their last ``horizon`` rows as the future. A symbol with too few
    rows for the order keeps its dates, with NULL forecasts.
    """
    order, poly = model.order, model.order.difference
    na, nm = len(order.ar_lags), len(order.ma_lags)

    def solve(row: pd.Series) -> list[dict]:
        beta = np.asarray(row["beta"], dtype=float)
        ar = dict(zip(order.ar_lags, beta[1 : 1 + na]))
        ma = dict(zip(order.ma_lags, beta[1 + na : 1 + na + nm]))
        y = [float(v) for v in row["t_y"]]
        w = [0.0 if v is None or v != v else float(v) for v in row["t_w"]]
        e = [0.0 if v is None or v != v else float(v) for v in row["t_e"]]
        drift = np.full(horizon, beta[0])
        for c, b in zip(order.exog, beta[1 + na + nm :]):
            level = np.asarray(row[f"t_{c}"], dtype=float)
            path = np.concatenate([level, level[-horizon:]])
            moved = np.convolve(path, poly)[len(level) : len(level) + horizon]
            drift = drift + b * moved[:horizon]
        psi = psi_weights(ar, ma, poly, horizon)
        out = []
        for h in range(horizon):
            step = drift[h]
            step += sum(v * w[-k] for k, v in ar.items() if k <= len(w))
            step += sum(v * e[-k] for k, v in ma.items() if k <= len(e))
            value = step - sum(c * y[-k] for k, c in enumerate(poly) if k and k <= len(y))
            w.append(step)
            e.append(0.0)
            y.append(value)
            band = Z95 * np.sqrt(row["sigma2"] * np.sum(psi[: h + 1] ** 2))
            out.append(
                {
                    "symbol": row["symbol"],
                    "d": row["last_d"] + pd.Timedelta(days=h + 1),
                    "step": h + 1,
                    "predicted_price": value,
                    "lower_conf_int": value - band,
                    "upper_conf_int": value + band,
                }
            )
        return out

    tail = settle(_tail(model, horizon))
    rows = model.coef.select("symbol", "beta", "sigma2").join(tail, "symbol")
    bounds = "predicted_price double, lower_conf_int double, upper_conf_int double"
    ahead = per_key(rows, solve, f"symbol string, d date, step int, {bounds}").drop("d")
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    dates = tail.select("symbol", "last_d", steps)
    return dates.join(ahead, ["symbol", "step"], "left").select(
        "symbol",
        F.date_add("last_d", F.col("step")).alias("d"),
        "step",
        "predicted_price",
        "lower_conf_int",
        "upper_conf_int",
    )


def backtest(df: DataFrame, order: Order, target: str = "close") -> DataFrame:
    """Fit on the first 80 % of each series and forecast all of the rest.

    One row per test row, with what happened beside the forecast.
    """
    parts = settle(chrono_split(whole(df)))
    train = parts.filter(F.col("part") == "train").drop("part")
    actual = parts.filter(F.col("part") == "test").select(
        "symbol", "d", F.col(target).alias("actual")
    )
    longest = actual.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    ahead = forecast(fit(train, order, target), longest or 1)
    return actual.join(ahead, ["symbol", "d"], "left")


def ar1(df: DataFrame, column: str = "close") -> DataFrame:
    """First-order autoregression of the differenced series, in built-in aggregates."""
    s = whole(df)
    s = s.add({"w": ind.diff(s, column)})
    s = s.add({"w1": ind.lag(s, "w")})
    return s.df.groupBy("symbol").agg(
        F.regr_slope("w", "w1").alias("phi"),
        F.regr_intercept("w", "w1").alias("const"),
        F.regr_count("w", "w1").alias("n"),
    )


def ar1_in_sample(df: DataFrame, column: str = "close") -> DataFrame:
    """One-step predictions of ``ar1``: previous value plus the expected change."""
    s = whole(df)
    s = s.add({"w1": ind.lag(s, column) - ind.lag(s, column, 2), "prev": ind.lag(s, column)})
    predicted = F.col("prev") + F.col("const") + F.col("phi") * F.col("w1")
    return (
        s.rows()
        .join(ar1(df, column), "symbol")
        .select("symbol", "d", F.col(column).alias("actual"), predicted.alias("predicted"))
        .filter(F.col("predicted").isNotNull())
    )


# ------------------------------------------------------------------ named models

# The orders and outside columns of the named models.
EXOG = ("rsi", "upper_band", "lower_band", "volume")
MODELS: dict[str, Order] = {
    "ARIMA": Order(1, 1, 30),
    "SARIMA": Order(1, 1, 1, 1, 1, 1, 24),
    "SARIMAX": Order(1, 1, 7, 1, 1, 1, 12, EXOG),
    "SARIMAX_GARCH": Order(1, 1, 7, exog=EXOG),
}


def prepare(bars: DataFrame, columns: Sequence[str] = ("close",)) -> DataFrame:
    """Indicator features on a gap-free daily grid, written once for several passes."""
    features = ind.forecast_features(whole(bars))
    return settle(filled_grid(features.select("symbol", "d", *columns), list(columns)))


def forecast_garch_band(bars: DataFrame, horizon: int) -> DataFrame:
    """Regression mean with a band from a GARCH fit of its scaled residuals."""
    order = MODELS["SARIMAX_GARCH"]
    model = fit(prepare(bars, ("close", *order.exog)), order)
    resid = model.series.rows().filter(F.col("resid").isNotNull()).select("symbol", "d", "resid")
    scale = resid.groupBy("symbol").agg(F.stddev_samp("resid").alias("scale"))
    scaled = resid.join(scale, "symbol").withColumn("resid", F.try_divide("resid", "scale"))
    path = (
        garch_path(settle(garch_fit(scaled.na.drop(subset=["resid"]))), horizon)
        .join(scale, "symbol")
        .select("symbol", "step", (F.sqrt("variance") * F.col("scale")).alias("volatility"))
    )
    band = Z95 * F.coalesce("volatility", F.lit(0.0))
    return (
        forecast(model, horizon)
        .drop("lower_conf_int", "upper_conf_int")
        .join(path, ["symbol", "step"], "left")
        .withColumn("lower_conf_int", F.col("predicted_price") - band)
        .withColumn("upper_conf_int", F.col("predicted_price") + band)
        .drop("volatility")
    )


def run(bars: DataFrame, model: str = "ARIMA", horizon: int = 7) -> DataFrame:
    """Forecast every symbol with a named model."""
    if model == "GARCH":
        return garch_forecast(bars, horizon)
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; choose from {sorted([*MODELS, 'GARCH'])}")
    if model == "SARIMAX_GARCH":
        return forecast_garch_band(bars, horizon)
    order = MODELS[model]
    return forecast(fit(prepare(bars, ("close", *order.exog)), order), horizon)


def integration_order(df: DataFrame, column: str = "close") -> DataFrame:
    """(symbol, order): the fewest differences, at least one, that look stationary.

    Differencing goes on while some series is not stationary and long enough to test. A
    series too short for the test gets one difference.
    """
    from candlewick.operators.regress import adf

    left, poly, n = whole(df.select("symbol", "d", column)), np.array([1.0]), 0
    found = df.select("symbol", F.lit(None).cast("int").alias("order")).distinct()
    while True:
        n, poly = n + 1, np.convolve(poly, [1.0, -1.0])
        moved = left.add({"_w": _differenced(left, column, poly)}).rows()
        test = settle(adf(moved, "_w").select("symbol", "stationary"))
        found = found.unionByName(test.filter("stationary").select("symbol", F.lit(n).alias("order")))
        open_ = test.filter("NOT stationary").select("symbol")
        if open_.isEmpty():
            break
        left = whole(df.select("symbol", "d", column).join(open_, "symbol", "left_semi"))
    return found.groupBy("symbol").agg(F.coalesce(F.min("order"), F.lit(1)).alias("order"))


def auto_seasonal_backtest(df: DataFrame, column: str = "close") -> DataFrame:
    """Backtest of (5, d, 3)(1, 1, 1, 7) with each symbol's own d.

    Symbols sharing an order are fitted together: one job per order that occurs.
    """
    df = settle(df)
    orders = settle(integration_order(df, column))
    out: DataFrame | None = None
    for (d,) in sorted(map(tuple, orders.select("order").distinct().collect())):
        group = df.join(orders.filter(F.col("order") == d).select("symbol"), "symbol", "left_semi")
        part = backtest(group, Order(5, d, 3, 1, 1, 1, 7), column).withColumn("order", F.lit(d))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return backtest(df, Order(5, 1, 3, 1, 1, 1, 7), column).withColumn("order", F.lit(1))
    return out
