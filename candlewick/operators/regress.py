"""Linear models for many series at once, from small sufficient statistics.

Spark reduces the rows of each symbol to one triangle (or, for lagged designs, one Gram
matrix); only that k by k system is solved in Python. Fits, predictions, collinearity,
feature elimination and the unit-root test all start from such a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import indicators as ind
from candlewick.operators.bars import days_since_start
from candlewick.operators.series import whole
from candlewick.operators.tables import chrono_split

# ------------------------------------------------------------------ sufficient statistics


def triangles(df: DataFrame, columns: Sequence[str], key: str = "symbol") -> DataFrame:
    """(key, n, r): the triangular factor of each key's rows [1, columns], row by row.

    Rows never meet as products, so the condition number is not squared. Every task folds its
    rows into one triangle per key; triangles of a key are stacked and reduced again, first
    in groups of tasks and then over the groups, so no task merges more than a share of them.
    """
    p = len(columns) + 1
    schema = f"{key} string, part int, n bigint, r array<double>"

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str | None, tuple[int, np.ndarray]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(
                {
                    key: list(acc),
                    "part": part,
                    "n": [n for n, _ in acc.values()],
                    "r": [r.ravel() for _, r in acc.values()],
                }
            )
            acc.clear()
            return out

        for batch in batches:
            part = int(batch["part"].iloc[0]) if len(batch) else 0
            for name, rows in batch.groupby(key, sort=False, dropna=False):
                x = rows[list(columns)].to_numpy(np.float64)
                n, r = acc.get(name, (0, np.zeros((0, p))))
                acc[name] = n + len(x), _triangle(np.vstack([r, np.column_stack([np.ones(len(x)), x])]))
            if len(acc) * p * p > 4_000_000:
                yield flush()
        if acc:
            yield flush()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        r = _triangle(np.concatenate(rows["r"].to_numpy()).reshape(-1, p))
        return pd.DataFrame(
            {key: [rows[key].iloc[0]], "part": [0], "n": [int(rows["n"].sum())], "r": [r.ravel()]}
        )

    numbers = [F.col(c).cast("double").alias(c) for c in columns]
    folded = (
        df.na.drop(subset=list(columns))
        .select(key, (F.spark_partition_id() % MERGE_GROUPS).alias("part"), *numbers)
        .mapInPandas(partials, schema)
    )
    once = folded.groupBy(key, "part").applyInPandas(merge, schema)
    return once.groupBy(key).applyInPandas(merge, schema).select(key, "n", "r")


MERGE_GROUPS = 64


def _triangle(rows: np.ndarray) -> np.ndarray:
    """Triangular factor of ``rows``, square also where there are few rows."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((r.shape[1] - len(r), r.shape[1]))]) if len(r) < r.shape[1] else r


class Design:
    """A key's centred columns as a triangle with unit columns, from a ``triangles`` row."""

    def __init__(self, row: pd.Series):
        self.n = int(row["n"])
        p = int(round(len(row["r"]) ** 0.5))
        r = np.asarray(row["r"], float).reshape(p, p)
        self.means = r[0, 1:] / r[0, 0]
        centred, length = r[1:, 1:], np.linalg.norm(r[:, 1:], axis=0)
        self.norms = np.linalg.norm(centred, axis=0)
        # What rounding alone leaves of a column whose values do not vary.
        noise = 64 * np.finfo(float).eps * length
        self.live = self.norms > noise
        self.norms = np.where(self.live, self.norms, 0.0)
        safe = np.where(self.live, self.norms, 1.0)
        self.unit = np.where(self.live, centred / safe, 0.0)
        self.blur = np.where(self.live, noise / safe, 0.0)

    def tolerance(self, columns: Sequence[int]) -> float:
        """Lengths of unit columns below this are rounding."""
        return max(1e-12, 4 * float(self.blur[list(columns)].max(initial=0.0)))

    def solve(self, features: Sequence[int], target: int) -> tuple[np.ndarray, int, float, float]:
        """Coefficients, rank, squared error and squared spread of ``target`` on ``features``.

        Of equally good coefficients those are taken whose scaled values are smallest.
        """
        features = list(features)
        a, y = self.unit[:, features], self.unit[:, target] * self.norms[target]
        x, _, rank, _ = np.linalg.lstsq(a, y, rcond=self.tolerance(features))
        left = y - a @ x
        safe = np.where(self.live[features], self.norms[features], 1.0)
        return x / safe, int(rank), float(left @ left), float(y @ y)

    def inflation(self, column: int, others: Sequence[int]) -> float | None:
        """1 / the squared distance of a unit column from the span of others; None if it lies inside."""
        others = [c for c in others if self.live[c]]
        a, y = self.unit[:, others], self.unit[:, column]
        limit = self.tolerance([column, *others])
        left = y - a @ np.linalg.lstsq(a, y, rcond=limit)[0] if others else y
        gap = float(np.linalg.norm(left))
        return 1 / gap**2 if gap > 10 * limit else None

    def constant_inflation(self, columns: Sequence[int]) -> float | None:
        """The inflation of the constant; None if a combination of the columns is a constant other than 0."""
        columns = [c for c in columns if self.live[c]]
        if not columns:
            return 1.0
        z = self.means[columns] * self.n**0.5 / self.norms[columns]
        _, s, v = np.linalg.svd(self.unit[:, columns], full_matrices=False)
        along = v @ z
        held = s > self.tolerance(columns) * s[0]
        if np.linalg.norm(along[~held]) > 1e-8 * np.linalg.norm(z):
            return None
        return 1 + float(((along[held] / s[held]) ** 2).sum())


def gram(df: DataFrame, vector: str = "x", key: str = "symbol") -> DataFrame:
    """(key, n, g): the flattened sum of x x' over each key's rows.

    Every task adds up its own rows as matrix products and emits one partial per
    key, so what is shuffled depends on keys and columns, not on rows.
    """

    def partials(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[str, tuple[int, np.ndarray]] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame(
                {
                    key: list(acc),
                    "n": [n for n, _ in acc.values()],
                    "g": [g.ravel() for _, g in acc.values()],
                }
            )
            acc.clear()
            return out

        held = 0
        for batch in batches:
            for name, rows in batch.groupby(key, sort=False)[vector]:
                x = np.stack(rows.to_numpy())
                n, g = acc.get(name, (0, 0.0))
                acc[name] = (n + len(x), g + x.T @ x)
                held = len(acc) * x.shape[1] ** 2
            if held > 4_000_000:
                yield flush()
                held = 0
        if acc:
            yield flush()

    parts = df.select(key, vector).mapInPandas(partials, f"{key} string, n bigint, g array<double>")
    cells = (
        parts.select(key, "n", F.posexplode("g").alias("i", "v"))
        .groupBy(key, "i")
        .agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("i", "v")))
    return cells.groupBy(key).agg(F.max("n").alias("n"), ordered.getField("v").alias("g"))


def per_key(rows: DataFrame, solve: Callable[[pd.Series], dict | list[dict]], schema: str) -> DataFrame:
    """Apply a small solver to each row of a one-row-per-key table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[dict] = []
            for _, row in batch.iterrows():
                got = solve(row)
                out.extend(got if isinstance(got, list) else [got])
            if out:
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def solve_scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    """Least-squares solution of a symmetric system after unit scaling."""
    scale = np.sqrt(np.clip(np.diag(a), 0, None))
    scale[scale == 0] = 1.0
    x, _, rank, _ = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)
    return x / scale, int(rank)


# ------------------------------------------------------------------ ordinary least squares

FIT = (
    "symbol string, n bigint, rank int, intercept double, coef array<double>, "
    "means array<double>, y_mean double, mse double, r2 double"
)


def ols(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row per symbol: intercept, coefficients in feature order, fit quality."""
    k = len(features)

    def solve(row: pd.Series) -> dict:
        design = Design(row)
        coef, rank, sse, spread = design.solve(range(k), k)
        mu = design.means
        return {
            "symbol": row["symbol"],
            "n": row["n"],
            "rank": rank,
            "intercept": float(mu[k] - coef @ mu[:k]),
            "coef": coef,
            "means": mu[:k],
            "y_mean": float(mu[k]),
            "mse": sse / design.n,
            "r2": 1 - sse / spread if spread > 0 else None,
        }

    return per_key(triangles(df, [*features, target]), solve, FIT)


def linear_value(features: Sequence[str]) -> Column:
    """intercept + coef . features, for rows joined with an ``ols`` table."""
    value = F.col("intercept")
    for i, f in enumerate(features):
        value = value + F.get("coef", F.lit(i)) * F.col(f)
    return value


def predict(df: DataFrame, fit: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``predicted`` from each symbol's own coefficients."""
    return (
        df.join(fit.select("symbol", "intercept", "coef"), "symbol", "left")
        .withColumn("predicted", linear_value(features))
        .drop("intercept", "coef")
    )


TREND_FEATURES = ("open", "high", "low", "volume", "days_since_start", "ma_7", "ma_30")


def trend_model(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Multi-feature trend regression on the first 80 % of each series.

    Returns the scored rows (part, predicted, trend_line) and one row per symbol
    with the direction. On standardised inputs the trend line is the mean target
    plus the day coefficient times the centred day; scaling cancels out.
    """
    s = whole(days_since_start(bars))
    s = s.add({f"ma_{n}": ind.sma(s, "close", n, full=True) for n in (7, 30)})
    ready = s.rows().na.drop(subset=[*TREND_FEATURES, "close"])
    parts = chrono_split(whole(ready))
    fit = ols(parts.filter(F.col("part") == "train"), TREND_FEATURES, "close")
    at = TREND_FEATURES.index("days_since_start")
    day, centre = F.get("coef", F.lit(at)), F.get("means", F.lit(at))
    scored = (
        parts.join(fit.select("symbol", "intercept", "coef", "means", "y_mean"), "symbol")
        .withColumn("predicted", linear_value(TREND_FEATURES))
        .withColumn("trend_line", F.col("y_mean") + day * (F.col("days_since_start") - centre))
        .drop("intercept", "coef", "means", "y_mean")
    )
    trend = F.when(day > 0, "upward").otherwise("downward")
    return scored, fit.select("symbol", "n", day.alias("slope"), trend.alias("trend"), "r2")


def simple_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope, intercept and direction of y on x, entirely in built-in aggregates."""
    return (
        df.groupBy("symbol")
        .agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
        .withColumn("trend", F.when(F.col("slope") > 0, "upward").otherwise("downward"))
    )


# ------------------------------------------------------------------ diagnostics


def vif(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Variance inflation per feature and for the constant; above 10 is flagged.

    Features of any scale count alike. A feature that the others determine exactly has no
    finite inflation: NULL, and flagged. One that does not vary has none either: NULL, and
    neither flagged nor cleared.
    """
    k, names = len(features), list(features)

    def solve(row: pd.Series) -> list[dict]:
        design = Design(row)
        values = [("const", True, design.constant_inflation(range(k)))]
        for i, name in enumerate(names):
            live = bool(design.live[i])
            others = [j for j in range(k) if j != i]
            values.append((name, live, design.inflation(i, others) if live else None))
        return [
            {
                "symbol": row["symbol"],
                "feature": name,
                "vif": value,
                "collinear": (value is None or value > 10) if live else None,
            }
            for name, live, value in values
        ]

    schema = "symbol string, feature string, vif double, collinear boolean"
    return per_key(triangles(df, names), solve, schema)


def rfe(df: DataFrame, features: Sequence[str], target: str, keep: int = 3) -> DataFrame:
    """Recursive elimination of the smallest absolute coefficient, down to ``keep``.

    The rows are read once; every refit is a sub-matrix of the same triangle.
    """
    k, names = len(features), list(features)

    def solve(row: pd.Series) -> list[dict]:
        design = Design(row)
        active, dropped = list(range(k)), []
        while len(active) > keep:
            coef = design.solve(active, k)[0]
            dropped.append(active.pop(int(np.argmin(np.abs(coef)))))
        coef = design.solve(active, k)[0]
        kept = {f: float(c) for f, c in zip(active, coef)}
        return [
            {
                "symbol": row["symbol"],
                "feature": names[f],
                "selected": f in kept,
                "ranking": 1 if f in kept else k - keep + 1 - dropped.index(f),
                "coef": kept.get(f),
            }
            for f in range(k)
        ]

    schema = "symbol string, feature string, selected boolean, ranking int, coef double"
    return per_key(triangles(df, [*names, target]), solve, schema)


# Asymptotic unit-root critical values, constant only (MacKinnon 2010).
CRITICAL = {"1%": -3.43035, "5%": -2.86154, "10%": -2.56677}


def lag_limit(n: Column) -> Column:
    """The usual largest lag count for n values: 12 (n / 100)^(1/4), at most half of them."""
    return F.least(F.ceil(12 * F.pow(n / 100, 0.25)), F.floor(n / 2) - 2).cast("int")


def adf(df: DataFrame, column: str, max_lag: int | None = None) -> DataFrame:
    """Augmented Dickey-Fuller test per symbol, lag count chosen by AIC.

    The largest lag count follows each series' length unless given. One Gram row per symbol
    holds the regression for every lag count, since a shorter regression is a sub-matrix;
    it is centred, which stands for the constant, and scaled before it is solved.
    Stationary means the statistic is below the 5 % critical value. A series too short for
    the test has a NULL statistic.
    """
    rows = df.select("symbol", "d", column).na.drop()
    sizes = rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("_n"))
    limit = F.greatest(lag_limit(F.col("_n")), F.lit(0)) if max_lag is None else F.lit(max_lag)
    top = max_lag if max_lag is not None else sizes.agg(F.max(limit)).first()[0] or 0
    s = whole(rows)
    count = F.count(F.lit(1)).over(Window.partitionBy(*s.key))
    s = s.add({"_dy": ind.diff(s, column), "_y1": ind.lag(s, column), "_n": count})
    none = F.array().cast("array<double>")
    history = F.collect_list("_dy").over(s.ordered.rowsBetween(-top, -1)) if top else none
    s = s.add({"_lags": F.reverse(history)}).add({"_own": limit})
    # Lags beyond a series' own limit are zero in its Gram row and never used.
    padded = F.transform(
        F.sequence(F.lit(0), F.lit(top)),
        lambda i: F.when(i < F.col("_own"), F.get("_lags", i)).otherwise(0.0),
    )
    design = (
        s.rows()
        .filter((F.size("_lags") >= F.col("_own")) & F.col("_y1").isNotNull())
        .select(
            "symbol",
            F.concat(
                F.array(F.lit(1.0), F.col("_y1"), F.col("_own").cast("double")),
                F.slice(padded, 1, top) if top else none,
                F.array("_dy"),
            ).alias("x"),
        )
    )

    def solve(row: pd.Series) -> dict:
        k = top + 4
        g, n = np.asarray(row["g"]).reshape(k, k), int(row["n"])
        own = int(round(g[0, 2] / n)) if n else 0
        centred = g - np.outer(g[0], g[0]) / n
        best = None
        for lags in range(own + 1):
            use = [1, *range(3, 3 + lags)]
            a, b = centred[np.ix_(use, use)], centred[use, k - 1]
            beta, _ = solve_scaled(a, b)
            sse = float(centred[k - 1, k - 1] - 2 * beta @ b + beta @ a @ beta)
            free = n - len(use) - 1
            if free <= 0 or sse <= 0 or a[0, 0] <= 0:
                continue
            aic = n * np.log(sse / n) + 2 * (len(use) + 1)
            if best is None or aic < best[0]:
                scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
                inverse = np.linalg.pinv(a / np.outer(scale, scale), hermitian=True)
                var = sse / free * inverse[0, 0] / scale[0] ** 2
                best = (aic, lags, beta[0] / np.sqrt(var))
        stat = float(best[2]) if best else None
        return {
            "symbol": row["symbol"],
            "n": n,
            "used_lags": best[1] if best else None,
            "adf_stat": stat,
            "stationary": bool(stat < CRITICAL["5%"]) if best else None,
        }

    schema = "symbol string, n bigint, used_lags int, adf_stat double, stationary boolean"
    return per_key(gram(design), solve, schema)


def lag_features(bars: DataFrame) -> DataFrame:
    """Three-day mean and previous close; warm-up rows dropped."""
    s = whole(bars)
    s = s.add(
        {"moving_avg": ind.sma(s, "close", 3, full=True), "prev_close": ind.lag(s, "close")}
    )
    return s.rows().na.drop(subset=["moving_avg", "prev_close"])
