"""Volatility of many series: exponential weighting and GARCH(1,1)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlewick.operators import indicators as ind
from candlewick.operators.series import RN, Recurrence, Series, recurrences, whole
from candlewick.session import settle

LAMBDA = 0.94


def ewma_volatility(s: Series, column: str = "close", lam: float = LAMBDA) -> DataFrame:
    """Root of the exponentially weighted mean of squared returns.

    The first return seeds the mean, so the first row of a series drops out.
    """
    s = s.add({"_r": ind.pct_change(s, column)})
    r2 = F.coalesce(F.col("_r") * F.col("_r"), F.lit(0.0))
    drive = F.when(F.col(RN) == 1, r2).otherwise(r2 * (1 - lam))
    s = recurrences(s, [Recurrence("_v", drive, lam)])
    s = s.add({"ewma_vol": F.when(F.col(RN) > 0, F.sqrt("_v"))})
    return s.rows("_r", "_v").filter(F.col("ewma_vol").isNotNull())


ALPHAS = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
BETAS = (0.1, 0.3, 0.5, 0.6, 0.7, 0.76, 0.8, 0.84, 0.88, 0.91, 0.94, 0.97)
ALPHA_RANGE, BETA_RANGE = (0.005, 0.5), (0.05, 0.985)
PERSISTENCE = 0.995
AROUND = (-2, -1, 0, 1, 2)
PASSES = 7  # the widest first step of 0.1 ends below 0.001


def first_steps(points: tuple[float, ...]) -> dict[float, float]:
    """Half the wider gap beside each coarse point: two steps reach both neighbours."""
    gaps = [b - a for a, b in zip(points, points[1:])]
    return {
        p: round(max(gaps[max(i - 1, 0)], gaps[min(i, len(gaps) - 1)]) / 2, 6)
        for i, p in enumerate(points)
    }


def step_sql(column: str, points: tuple[float, ...]) -> str:
    """The first step of a coarse point, in words both engines read."""
    cases = " ".join(f"WHEN {column} < {p + 0.001!r} THEN {s!r}" for p, s in first_steps(points).items())
    return f"CAST(CASE {cases} END AS DOUBLE)"


def _variance(alpha: str, beta: str, i: int) -> str:
    """SQL of the conditional variance from the decayed sum of past squares.

    With the long-run variance targeted, h[t] splits into a part that depends on
    t alone and alpha times the sum over past squares; the sum depends on beta
    only, so one recurrence (``_s<i>``, weight of the start ``_f<i>``) serves
    every alpha.
    """
    constant = f"(1D - {alpha} - {beta}) * var * (1D - _f{i}) / (1D - {beta}) + _f{i} * var"
    return f"({constant} + {alpha} * _s{i})"


def _nll(h: str) -> str:
    return f"sum(ln({h}) + r2 / {h})"


def garch_fit(residuals: DataFrame, value: str = "resid") -> DataFrame:
    """GARCH(1,1) per symbol by quasi-likelihood on ever finer grids.

    ``residuals``: (symbol, d, value) with one row per day. The coarse grid is
    evaluated without multiplying rows: twelve decay recurrences share two sorts
    and one aggregate holds a likelihood per (alpha, beta). Each pass then looks two
    steps around every symbol's best point, with per-symbol decays, and halves the
    step, so neighbouring passes overlap and no part of the range is left out.
    """
    residuals = settle(residuals.select("symbol", "d", value))
    stats = residuals.groupBy("symbol").agg(
        F.avg(value).alias("mu"), F.var_pop(value).alias("var")
    )
    base = residuals.join(stats, "symbol").filter(F.col("var") > 0)
    base = base.withColumn("r2", F.pow(F.col(value) - F.col("mu"), 2))
    s = whole(base.select("symbol", "d", "r2", "var", "mu"))
    s = s.add({"_p2": F.coalesce(ind.lag(s, "r2"), F.lit(0.0))})
    s = replace(s, df=settle(s.df))
    plain = s.df
    s = recurrences(s, [Recurrence(f"_s{i}", F.col("_p2"), b) for i, b in enumerate(BETAS)])
    s = s.add({f"_f{i}": F.pow(F.lit(b), F.col(RN)) for i, b in enumerate(BETAS)})
    points = [
        (a, b, i) for i, b in enumerate(BETAS) for a in ALPHAS if a + b <= PERSISTENCE
    ]
    cells = ", ".join(
        f"struct({_nll(_variance(f'{a}D', f'{b}D', i))} AS nll, {a}D AS alpha, {b}D AS beta)"
        for a, b, i in points
    )
    costs = s.df.groupBy("symbol").agg(F.expr(f"array_min(array({cells}))").alias("p"))
    best = costs.select(
        "symbol",
        F.col("p.alpha").alias("a0"),
        F.col("p.beta").alias("b0"),
        F.expr(step_sql("p.alpha", ALPHAS)).alias("sa"),
        F.expr(step_sql("p.beta", BETAS)).alias("sb"),
    )
    for number in range(PASSES):
        centre = settle(best)
        fit = _refine(plain, centre)
        if number == PASSES - 1:
            return fit
        best = fit.join(centre, "symbol").select(
            "symbol",
            F.col("alpha").alias("a0"),
            F.col("beta").alias("b0"),
            (F.col("sa") / 2).alias("sa"),
            (F.col("sb") / 2).alias("sb"),
        )


def _clamped(centre: str, step: str, k: int, bounds: tuple[float, float]) -> Column:
    value = F.col(centre) + k * F.col(step)
    return F.least(F.greatest(value, F.lit(bounds[0])), F.lit(bounds[1]))


def _refine(rows: DataFrame, centre: DataFrame) -> DataFrame:
    """Local grid around (a0, b0), with each symbol's own decay and block length."""
    df = rows.join(centre, "symbol")
    betas = [_clamped("b0", "sb", k, BETA_RANGE) for k in AROUND]
    # The fastest and slowest decay of one local grid differ too little to
    # overflow, so the slowest sets one block length per symbol.
    length = F.ceil(F.lit(41.45) / -F.log(betas[-1])).cast("long")
    df = df.withColumn("_len", length)
    df = df.withColumns(
        {
            "_c": F.floor(F.col(RN) / F.col("_len")),
            "_p": F.col(RN) % F.col("_len"),
            **{f"_b{i}": b for i, b in enumerate(betas)},
        }
    )
    df = scan(df, {f"_s{i}": (F.col("_p2"), F.col(f"_b{i}")) for i in range(len(betas))})
    df = df.withColumns(
        {f"_f{i}": F.pow(F.col(f"_b{i}"), F.col(RN)) for i in range(len(betas))}
        | {f"_a{j}": _clamped("a0", "sa", k, ALPHA_RANGE) for j, k in enumerate(AROUND)}
    )
    cells = []
    for i in range(len(betas)):
        for j in range(len(AROUND)):
            a, b = f"_a{j}", f"_b{i}"
            h = _variance(a, b, i)
            cells.append(
                f"struct(CASE WHEN max({a} + {b}) <= {PERSISTENCE}D "
                f"THEN sum(CASE WHEN {a} + {b} <= {PERSISTENCE}D THEN ln({h}) + r2 / {h} END) END AS nll, "
                f"max({a}) AS alpha, max({b}) AS beta, max_by({h}, {RN}) AS h_last)"
            )
    best = F.expr(f"array_min(filter(array({', '.join(cells)}), x -> x.nll IS NOT NULL))")
    return (
        df.groupBy("symbol")
        .agg(
            best.alias("p"),
            F.max_by("r2", RN).alias("r2_last"),
            F.max("var").alias("var"),
            F.max("mu").alias("mu"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(
            "symbol",
            "n",
            "mu",
            "var",
            F.col("p.alpha").alias("alpha"),
            F.col("p.beta").alias("beta"),
            ((1 - F.col("p.alpha") - F.col("p.beta")) * F.col("var")).alias("omega"),
            F.col("p.h_last").alias("h_last"),
            "r2_last",
        )
    )


def scan(df: DataFrame, recs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Block scan with per-row decay columns; expects ``_c``, ``_p`` and ``_len``."""
    inside = (
        Window.partitionBy("symbol", "_c")
        .orderBy(RN)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    previous = Window.partitionBy("symbol").orderBy("_c").rangeBetween(-1, -1)
    p = F.col("_p")
    df = df.withColumns(
        {f"_l{n}": F.pow(b, p) * F.sum(w * F.pow(b, -p)).over(inside) for n, (w, b) in recs.items()}
    )
    at_end = p == F.col("_len") - 1
    df = df.withColumns(
        {
            n: F.col(f"_l{n}")
            + F.coalesce(F.max(F.when(at_end, F.col(f"_l{n}"))).over(previous), F.lit(0.0))
            * F.pow(b, p + 1)
            for n, (_, b) in recs.items()
        }
    )
    return df.drop(*[f"_l{n}" for n in recs])


def garch_path(fit: DataFrame, horizon: int) -> DataFrame:
    """Variance forecasts for steps 1..horizon, decaying to the long-run level."""
    first = F.col("omega") + F.col("alpha") * F.col("r2_last") + F.col("beta") * F.col("h_last")
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    fade = F.pow(F.col("alpha") + F.col("beta"), F.col("step") - 1)
    return fit.withColumn("h1", first).select("*", steps).select(
        "symbol",
        "step",
        "mu",
        (F.col("var") + fade * (F.col("h1") - F.col("var"))).alias("variance"),
    )


def garch_history(bars: DataFrame) -> DataFrame:
    """(symbol, d, mean, variance): what the fitted model says of every past day."""
    s = whole(bars.select("symbol", "d", "close"))
    s = s.add({"resid": ind.pct_change(s, "close")})
    ret = settle(s.rows().filter(F.col("resid").isNotNull()).select("symbol", "d", "resid"))
    fit = settle(garch_fit(ret).select("symbol", "mu", "var", "alpha", "beta"))
    s = whole(ret.join(fit, "symbol"))
    s = s.add({"_r2": F.pow(F.col("resid") - F.col("mu"), 2)})
    s = s.add({"_p2": F.coalesce(ind.lag(s, "_r2"), F.lit(0.0))})
    length = F.greatest(F.ceil(F.lit(41.45) / -F.log("beta")), F.lit(2)).cast("long")
    df = s.df.withColumn("_len", length).withColumns(
        {"_c": F.floor(F.col(RN) / F.col("_len")), "_p": F.col(RN) % F.col("_len")}
    )
    df = scan(df, {"_s0": (F.col("_p2"), F.col("beta"))})
    df = df.withColumn("_f0", F.pow(F.col("beta"), F.col(RN)))
    return df.select(
        "symbol", "d", F.col("mu").alias("mean"), F.expr(_variance("alpha", "beta", 0)).alias("variance")
    )


def garch_forecast(bars: DataFrame, horizon: int = 7) -> DataFrame:
    """Price path from a constant-mean GARCH model of daily returns.

    Each step applies the mean return to the last price, not compounded.
    """
    s = whole(bars.select("symbol", "d", "close"))
    s = s.add({"resid": ind.pct_change(s, "close")})
    ret = s.rows().filter(F.col("resid").isNotNull())
    last = bars.groupBy("symbol").agg(
        F.max_by("close", "d").alias("last_price"), F.max("d").alias("last_d")
    )
    return (
        garch_path(garch_fit(ret), horizon)
        .join(last, "symbol")
        .select(
            "symbol",
            F.date_add("last_d", F.col("step")).alias("d"),
            "step",
            (F.col("last_price") * (1 + F.col("mu"))).alias("predicted_price"),
            F.sqrt("variance").alias("volatility"),
        )
    )
