import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.operators import forecast as fc
from candlewick.operators import models, regress
from candlewick.operators.volatility import ewma_volatility, garch_fit, garch_path
from candlewick.operators.series import whole

RNG = np.random.default_rng(11)
DAY = dt.date(2015, 1, 1)


def table(spark, columns):
    """symbol -> {column: values} as a daily table."""
    rows, names = [], None
    for symbol, cols in columns.items():
        names = list(cols)
        for i, vals in enumerate(zip(*cols.values())):
            rows.append((symbol, DAY + dt.timedelta(days=i), *map(float, vals)))
    schema = "symbol string, d date, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, schema)


def linear(n):
    a, b = RNG.normal(1e5, 1e3, n), RNG.normal(3, 1, n)
    return {"a": a, "b": b, "c": a * 0.5 + RNG.normal(0, 1e3, n), "y": 2 * a - 300 * b + 7 + RNG.normal(0, 5, n)}


def test_ols_matches_numpy(spark):
    cols = {"s1": linear(200), "s2": linear(50)}
    fit = regress.ols(table(spark, cols), ["a", "b", "c"], "y").collect()
    for r in fit:
        d = cols[r.symbol]
        x = np.column_stack([np.ones(len(d["a"])), d["a"], d["b"], d["c"]])
        want, *_ = np.linalg.lstsq(x, d["y"], rcond=None)
        np.testing.assert_allclose(r.coef, want[1:], rtol=1e-5, atol=1e-6)
        assert r.intercept == pytest.approx(want[0], rel=1e-4, abs=1e-2)
        assert r["rank"] == 3
    df = table(spark, {"s": {**linear(40)}}).withColumn("b", F.col("a") * 2)
    assert regress.ols(df, ["a", "b"], "y").first()["rank"] == 1


def test_vif_and_rfe(spark):
    cols = {"s": linear(300)}
    df = table(spark, cols)
    got = {r.feature: r.vif for r in regress.vif(df, ["a", "b", "c"]).collect()}
    x = np.column_stack([np.ones(300), *[cols["s"][k] for k in "abc"]])
    inv = np.linalg.inv(x.T @ x)
    assert got["const"] == pytest.approx(300 * inv[0, 0], rel=1e-6)
    xc = x[:, 1:] - x[:, 1:].mean(0)
    want = np.diag(np.linalg.inv(np.corrcoef(xc.T)))
    np.testing.assert_allclose([got[k] for k in "abc"], want, rtol=1e-8)
    picked = {r.feature: (r.selected, r.ranking) for r in regress.rfe(df, ["a", "b", "c"], "y", 2).collect()}
    assert picked == {"a": (True, 1), "b": (True, 1), "c": (False, 2)}


def test_gram_merges_partials(spark):
    x = RNG.normal(size=(500, 3))
    rows = [("ab"[i % 2], v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "symbol string, x array<double>").repartition(7)
    for r in regress.gram(df).collect():
        own = x["ab".index(r.symbol) :: 2]
        np.testing.assert_allclose(np.reshape(r.g, (3, 3)), own.T @ own, rtol=1e-10)
        assert r.n == len(own)


def test_unit_root(spark):
    noise, walk = RNG.normal(size=800), np.cumsum(RNG.normal(size=800))
    got = {r.symbol: r for r in regress.adf(table(spark, {"n": {"close": noise}, "w": {"close": walk}}), "close").collect()}
    assert got["n"].stationary and not got["w"].stationary
    orders = fc.integration_order(table(spark, {"w": {"close": walk}, "ww": {"close": np.cumsum(walk)}}))
    assert {r.symbol: r["order"] for r in orders.collect()} == {"w": 1, "ww": 2}


def arma(n, phi, theta):
    e = RNG.normal(size=n + 200)
    w = np.zeros(n + 200)
    for t in range(1, n + 200):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return w[200:]


def test_arma_recovery_and_forecast(spark):
    data = {k: {"close": 100 + np.cumsum(arma(2400, 0.6, 0.3))} for k in "ab"}
    model = fc.fit(table(spark, data), fc.Order(1, 1, 1))
    for r in model.coef.collect():
        assert r.beta[1] == pytest.approx(0.6, abs=4 * 0.021)
        assert r.beta[2] == pytest.approx(0.3, abs=4 * 0.028)
        assert r.sigma2 == pytest.approx(1, abs=0.12)
    ahead = fc.forecast(model, 5).orderBy("symbol", "step").collect()
    assert len(ahead) == 10
    assert ahead[0].d == DAY + dt.timedelta(days=2400)
    widths = [r.upper_conf_int - r.lower_conf_int for r in ahead[:5]]
    assert widths == sorted(widths) and widths[0] == pytest.approx(2 * 1.96, rel=0.1)
    assert abs(ahead[0].predicted_price - data["a"]["close"][-1]) < 6
    hist = fc.in_sample(model)
    inside = hist.filter(F.col("actual").between(F.col("lower_conf_int"), F.col("upper_conf_int"))).count()
    assert inside / hist.count() == pytest.approx(0.95, abs=0.02)


def test_ar_matches_numpy(spark):
    y = np.cumsum(arma(400, 0.5, 0.0))
    coef = fc.fit(table(spark, {"s": {"close": y}}), fc.Order(2, 1, 0)).coef.first()
    w = np.diff(y)
    x = np.column_stack([np.ones(len(w) - 2), w[1:-1], w[:-2]])
    want, *_ = np.linalg.lstsq(x, w[2:], rcond=None)
    np.testing.assert_allclose(coef.beta, want, rtol=1e-7, atol=1e-9)


def test_seasonal_pattern_continues(spark):
    n, base = 720, np.array([5, 1, 9, 4, 7, 2, 8] * 120)[:720]
    y = 50 + 0.1 * np.arange(n) + base + RNG.normal(0, 0.05, n)
    model = fc.fit(table(spark, {"s": {"close": y}}), fc.Order(1, 1, 1, 1, 1, 1, 7))
    got = [r.predicted_price for r in fc.forecast(model, 7).orderBy("step").collect()]
    want = 50 + 0.1 * np.arange(n, n + 7) + np.array([5, 1, 9, 4, 7, 2, 8] * 120)[(np.arange(n, n + 7)) % 7]
    np.testing.assert_allclose(got, want, atol=0.5)


def test_outside_columns_enter(spark):
    x = RNG.normal(size=600)
    y = np.cumsum(RNG.normal(0, 0.1, 600)) + 4 * x
    model = fc.fit(table(spark, {"s": {"close": y, "x": x}}), fc.Order(1, 1, 0, exog=("x",)))
    assert model.coef.first().beta[2] == pytest.approx(4, abs=0.3)
    assert fc.forecast(model, 3).count() == 3


def test_psi_weights():
    psi = fc.psi_weights({1: 0.5}, {1: 0.2}, np.array([1.0]), 4)
    np.testing.assert_allclose(psi, [1, 0.7, 0.35, 0.175])
    np.testing.assert_allclose(fc.psi_weights({}, {}, np.array([1.0, -1.0]), 3), [1, 1, 1])


def simulate_garch(n, omega, alpha, beta):
    h, out = omega / (1 - alpha - beta), []
    for _ in range(n):
        r = np.sqrt(h) * RNG.normal()
        out.append(r)
        h = omega + alpha * r * r + beta * h
    return np.array(out)


def test_garch(spark):
    r = {k: simulate_garch(2400, 0.05, 0.1, 0.85) for k in ("a", "b")}
    fits = garch_fit(table(spark, {k: {"resid": v} for k, v in r.items()})).collect()
    for f in fits:
        assert f.alpha == pytest.approx(0.10, abs=0.06)
        assert f.beta == pytest.approx(0.85, abs=0.12)
        x = r[f.symbol] - r[f.symbol].mean()
        h = f.var
        for v in x[:-1]:
            h = f.omega + f.alpha * v * v + f.beta * h
        assert f.h_last == pytest.approx(h, rel=1e-9)
        assert f.r2_last == pytest.approx(x[-1] ** 2)
    spread = spark.createDataFrame(fits)
    far = garch_path(spread, 2000).filter("step = 2000").select("symbol", "variance").collect()
    for row in far:
        assert row.variance == pytest.approx(next(f.var for f in fits if f.symbol == row.symbol), rel=0.05)


def test_garch_search_has_no_holes(spark):
    """The fit's likelihood is that of a dense search, also off the coarse grid."""
    true = {"a": (0.3, 0.4), "b": (0.4, 0.2), "c": (0.05, 0.93)}
    r = {k: simulate_garch(1500, 0.05, a, b) for k, (a, b) in true.items()}
    fits = {f.symbol: f for f in garch_fit(table(spark, {k: {"resid": v} for k, v in r.items()})).collect()}

    def cost(x, alpha, beta):
        r2, var = (x - x.mean()) ** 2, x.var()
        h, total = var, np.log(var) + r2[0] / var
        for i in range(1, len(x)):
            h = (1 - alpha - beta) * var + alpha * r2[i - 1] + beta * h
            total = total + np.log(h) + r2[i] / h
        return total

    alphas = np.linspace(0.005, 0.5, 60)[:, None]
    betas = np.linspace(0.05, 0.985, 110)[None, :]
    for k, x in r.items():
        with np.errstate(invalid="ignore", divide="ignore"):
            dense = np.where(alphas + betas <= 0.995, cost(x, alphas, betas), np.inf).min()
        assert cost(x, fits[k].alpha, fits[k].beta) <= dense + 0.05


def test_ewma(spark):
    y = np.exp(np.cumsum(RNG.normal(0, 0.02, 900)))
    out = ewma_volatility(whole(table(spark, {"s": {"close": y}}))).orderBy("d").toPandas()
    r2 = (y[1:] / y[:-1] - 1) ** 2
    v, want = r2[0], []
    for i, x in enumerate(r2):
        v = x if i == 0 else 0.94 * v + 0.06 * x
        want.append(np.sqrt(v))
    np.testing.assert_allclose(out.ewma_vol, want, rtol=1e-9)


def test_dispatch(spark, data):
    with pytest.raises(ValueError):
        fc.run(table(spark, {"s": {"close": [1, 2]}}), "PROPHET")


def test_trend_and_trees(spark):
    n = 400
    y = 10 + 0.5 * np.arange(n) + RNG.normal(0, 2, n)
    bars = table(spark, {"up": {c: y + i for i, c in enumerate(("open", "high", "low", "close", "market_cap"))} | {"volume": RNG.uniform(1, 2, n)}})
    noisy = bars.withColumns({c: F.col(c) + F.rand(5) for c in ("open", "high", "low")})
    scored, trend = regress.trend_model(noisy)
    assert trend.count() == 1 and scored.filter("part = 'test'").count() == 75
    simple = regress.simple_trend(bars.withColumn("x", F.datediff("d", F.lit(DAY))), "x", "close").first()
    assert simple.trend == "upward" and simple.slope == pytest.approx(0.5, abs=0.02)
    rows = [(i, "train" if i % 7 else "test", float(i % 10), float(i % 3), 3.0 * (i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, part string, x double, z double, y double")
    out, weight = models.tree_regression(df, ["x", "z"], "y", "tree")
    assert out.filter(F.abs(F.col("predicted") - F.col("y")) > 1e-6).count() == 0
    assert weight.orderBy(F.desc("importance")).first().feature == "x"
    sign = F.when(F.col("id") % 2 == 0, 1.0).otherwise(-3.0)
    two = df.withColumn("symbol", (F.col("id") % 2).cast("string")).withColumn("y", sign * F.col("x") * F.col("x"))
    poly = models.polynomial(two, ["x"], "y")
    assert poly.filter(F.abs(F.col("predicted") - F.col("y")) > 1e-6).count() == 0
    gaps = df.withColumn("x", F.when(F.col("id") != 5, F.col("x")))
    kept = {r.id: r.predicted for r in models.tree_regression(gaps, ["x", "z"], "y", "tree")[0].collect()}
    assert len(kept) == 200 and kept[5] is None and kept[6] is not None
    with pytest.raises(ValueError):
        models.tree_regression(df, ["x"], "y", "stump")


def test_worker_functions_carry_their_code():
    from pyspark.cloudpickle import dumps

    sent = dumps(regress.solve_scaled)
    assert b"lstsq" in sent and len(sent) > 300


def _bars(spark, columns):
    import datetime as dt

    names = list(columns)
    rows = [
        ("s", dt.date(2020, 1, 1) + dt.timedelta(days=i), *map(float, values))
        for i, values in enumerate(zip(*columns.values()))
    ]
    return spark.createDataFrame(rows, "symbol string, d date, " + ", ".join(f"{n} double" for n in names))


def test_vif_does_not_depend_on_scale(spark):
    from candlewick.operators import regress

    rng = np.random.default_rng(3)
    low = rng.normal(1, 1e-3, 300)
    high = low + rng.normal(0, 1e-3, 300)
    big = rng.normal(5e10, 1e10, 300)
    out = {r.feature: r.vif for r in regress.vif(_bars(spark, {"a": low, "b": high, "c": big}), ["a", "b", "c"]).collect()}
    unit = np.corrcoef([low, high, big])
    np.testing.assert_allclose([out["a"], out["b"], out["c"]], np.diag(np.linalg.inv(unit)), rtol=1e-5)


def test_unit_root_test_equals_direct_least_squares(spark):
    from candlewick.operators import regress

    rng = np.random.default_rng(4)
    y = 1e6 + np.cumsum(rng.normal(size=250))
    row = regress.adf(_bars(spark, {"close": y}), "close").first()
    top = int(np.ceil(12 * (250 / 100) ** 0.25))
    dy, best = np.diff(y), None
    for lags in range(top + 1):
        rows = range(top, len(dy))
        x = np.array([[1, y[i] - 1e6, *dy[i - lags : i][::-1]] for i in rows])
        t = dy[top:]
        beta, *_ = np.linalg.lstsq(x, t, rcond=None)
        sse = ((t - x @ beta) ** 2).sum()
        aic = len(t) * np.log(sse / len(t)) + 2 * x.shape[1]
        if best is None or aic < best[0]:
            var = sse / (len(t) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]
            best = aic, lags, beta[1] / np.sqrt(var)
    assert row.used_lags == best[1]
    assert row.adf_stat == pytest.approx(best[2], rel=1e-4)


def test_exponential_mean_names_a_null(spark, closes):
    from candlewick.operators import indicators
    from candlewick.operators.series import whole

    s = whole(closes(a=[10, None, 10]))
    with pytest.raises(Exception, match="NULL in close"):
        indicators.emas(s, {"e": ("close", 3)}).rows().collect()


def test_short_series_keep_their_dates(spark):
    y = np.cumsum(RNG.normal(size=300)) + 50
    df = table(spark, {"long": {"close": y}, "short": {"close": y[:6]}})
    out = fc.forecast(fc.fit(df, fc.Order(8, 1, 0)), 3).collect()
    assert {(r.symbol, r.step, r.predicted_price is None) for r in out} == {
        (s, i, s == "short") for s in ("long", "short") for i in (1, 2, 3)
    }


def test_backtest_covers_the_whole_test_part(spark):
    y = np.cumsum(RNG.normal(size=300)) + 50
    df = table(spark, {"a": {"close": y}, "b": {"close": y[:120]}})
    out = fc.backtest(df, fc.Order(1, 1, 0)).toPandas()
    assert out.groupby("symbol").size().to_dict() == {"a": 60, "b": 24}
    assert out.predicted_price.notna().all()


def test_dependent_features_have_no_finite_inflation(spark):
    rng = np.random.default_rng(8)
    a, c = rng.normal(100, 1, 400), rng.normal(3, 2, 400)
    near = a + rng.normal(0, 1e-6, 400)
    rows = {"a": a, "copy": a.copy(), "mixed": 2 * a - 5 * c + 7, "c": c, "flat": np.full(400, 1e9)}
    out = {r.feature: (r.vif, r.collinear) for r in regress.vif(_bars(spark, rows), list(rows)).collect()}
    assert out["a"] == out["copy"] == out["mixed"] == out["c"] == (None, True)
    assert out["flat"] == (None, None) and out["const"] == (None, True)
    alone = {r.feature: r for r in regress.vif(_bars(spark, {"a": a, "copy": a, "c": c}), ["a", "copy", "c"]).collect()}
    assert alone["copy"].vif is None and alone["copy"].collinear and alone["c"].vif < 1.1 and not alone["c"].collinear
    close = {r.feature: r for r in regress.vif(_bars(spark, {"a": a, "near": near, "c": c}), ["a", "near", "c"]).collect()}
    x = np.column_stack([np.ones(400), near, c])
    left = a - x @ np.linalg.lstsq(x, a, rcond=None)[0]
    assert close["a"].vif == pytest.approx(((a - a.mean()) ** 2).sum() / (left @ left), rel=1e-4)


def test_triangles_merge_over_tasks_and_groups(spark, monkeypatch):
    """A tall polynomial design over many partitions equals one QR of all rows; products would not."""
    monkeypatch.setattr(regress, "MERGE_GROUPS", 4)
    rng = np.random.default_rng(9)
    x = rng.uniform(10, 11, 900)
    rows = {"x": x, "y": np.cos(3 * x) + rng.normal(0, 0.01, 900)}
    powers = {f"p{i}": F.pow("x", F.lit(i)) for i in range(1, 5)}
    df = _bars(spark, rows).repartition(13).withColumns(powers)
    fit = regress.ols(df, list(powers), "y").first()
    design = np.column_stack([x**i for i in range(5)])
    q, r = np.linalg.qr(design)
    want = design @ np.linalg.solve(r, q.T @ rows["y"])
    got = fit.intercept + design[:, 1:] @ np.array(fit.coef)
    np.testing.assert_allclose(got, want, atol=1e-5)
    assert fit["rank"] == 4 and fit.n == 900
    assert fit.mse == pytest.approx(np.mean((rows["y"] - want) ** 2), rel=1e-6)
    few = regress.ols(df.limit(2), list(powers), "y").first()
    assert few.n == 2 and few["rank"] <= 1


def test_polynomial_of_degree_four_equals_numpy(spark):
    rng = np.random.default_rng(10)
    v = rng.lognormal(10, 1, 300)
    y = np.log(v) + rng.normal(0, 0.1, 300)
    data = _bars(spark, {"volume": v, "close": y}).withColumn("part", F.lit("train"))
    got = [r.predicted for r in models.polynomial(data, ["volume"], "close", 4).orderBy("d").collect()]
    z = (v - v.mean()) / v.std(ddof=1)
    x = np.column_stack([z**i for i in range(5)])
    np.testing.assert_allclose(got, x @ np.linalg.lstsq(x, y, rcond=None)[0], rtol=1e-7)


def test_rows_carry_their_tree_nodes():
    """Without this every level sends all trees grown so far to the tasks."""
    from candlewick.operators import models

    assert models._tree("forest", "y", 30).getCacheNodeIds()
    assert models._tree("tree", "y", 30).getCacheNodeIds()
