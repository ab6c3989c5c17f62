import datetime as dt

import pytest
from helpers import column
from pyspark.sql import functions as F

from candlewick.functions import columns as col
from candlewick.operators import bars, metrics, tables
from candlewick.operators.series import blocked, whole
from candlewick.sources import files


def test_weeks_end_on_sunday_and_gaps_stay(spark):
    days = ["2024-01-01", "2024-01-06", "2024-01-07", "2024-01-22"]
    rows = [("a", dt.date.fromisoformat(x), *[float(i)] * 6) for i, x in enumerate(days)]
    schema = (
        "symbol string, d date, open double, high double, low double, close double, "
        "volume double, market_cap double"
    )
    out = bars.weekly_spine(spark.createDataFrame(rows, schema)).orderBy("week").collect()
    assert [str(r.week) for r in out] == ["2024-01-07", "2024-01-14", "2024-01-21", "2024-01-28"]
    assert [r.volume for r in out] == [3.0, 0.0, 0.0, 3.0]
    assert [r.close for r in out] == [2.0, None, None, 3.0]
    assert [r.open for r in out] == [0.0, None, None, 3.0]


def test_weekly_first_and_last_skip_nulls(closes):
    out = bars.weekly(closes(a=[None, 2, 3, None])).collect()
    assert (out[0].open, out[0].close) == (2.0, 3.0)


def test_filled_grid(spark, closes):
    df = closes(a=[1, 2, 3, 4]).filter(F.dayofmonth("d") != 2)
    assert column(bars.filled_grid(df, ["close"]), "a", "close") == [1.0, 1.0, 3.0, 4.0]


@pytest.mark.parametrize("n,test", [(1, 1), (4, 1), (5, 1), (6, 2), (10, 2), (11, 3)])
def test_chrono_split_rounds_test_up(spark, closes, n, test):
    out = tables.chrono_split(whole(closes(a=range(n))))
    assert column(out, "a", "part") == ["train"] * (n - test) + ["test"] * test


def test_chrono_split_in_blocks(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "a") for i in range(50)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, symbol string")
    out = tables.chrono_split(blocked(df, lookback=2, block_rows=7))
    assert out.filter("part = 'test'").count() == 10
    assert out.filter("part = 'test'").agg(F.min("event_id")).first()[0] == 40


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "B", 2), (3, "c", 1), (4, "d", 2), (2, "x", 1)], old.schema)
    files.append_rows(old, f"{tmp_path}/t1")
    with pytest.raises(ValueError):
        files.upsert_table(spark, f"{tmp_path}/t1", new, ["k"], "t", f"{tmp_path}/t1/")
    got = files.upsert_table(spark, f"{tmp_path}/t1", new, ["k"], "t", f"{tmp_path}/t2")
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, "B", 2), (3, "c", 1), (4, "d", 2)]


def test_append_and_table(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    files.append_rows(df, f"{tmp_path}/t")
    files.append_rows(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2
    for _ in range(2):
        files.create_sentiment_table(spark, "news_sentiments", f"{tmp_path}/s")
    assert dict(spark.table("news_sentiments").dtypes)["sentiment_score"] == "decimal(38,18)"
    spark.sql("DROP TABLE news_sentiments")


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x, y", 1.5), ("z", None)], "a string, b double")
    files.write_csv(df, f"{tmp_path}/c")
    typed = files.load_csv(spark, f"{tmp_path}/c", "a string, b double")
    assert sorted(map(tuple, typed.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert dict(files.load_csv(spark, f"{tmp_path}/c").dtypes)["b"] == "double"


def test_exchange_csv(spark, tmp_path):
    head = "timeOpen;timeClose;timeHigh;timeLow;open;high;low;close;volume;marketCap;timestamp"
    line = "2024-01-0{}T00:00:00.000Z;x;x;x;{};9;1;5;10;100;2024-01-02T00:00:00.000Z"
    path = tmp_path / "x.csv"
    rows = [line.format(d, o).replace(";x", ";2024-01-01T01:00:00.000Z") for d, o in [(3, 3), (1, 1), (2, 2), (2, 4)]]
    path.write_text("\n".join([head, *rows]))
    got = files.load_ohlcv_csv(spark, str(path), "2024-01-02", "2024-01-03").orderBy("date").collect()
    assert [r.open for r in got] == [2.0, 3.0]
    assert got[0].__fields__ == ["date", "open", "high", "low", "close", "volume", "marketCap"]


def test_load_bars_pushes_to_scan(spark, closes, tmp_path):
    files.append_rows(closes(a=range(5), b=range(5)), f"{tmp_path}/b")
    got = files.load_bars(spark.read.parquet(f"{tmp_path}/b"), ["a"], "2024-01-03")
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(d,2024-01-03)" in plan and "EqualTo(symbol,a)" in plan


def test_jdbc_options_are_partitioned():
    got = files.jdbc_options("jdbc:x", "bars", "d", "2014-01-01", "2024-01-01", 32)
    assert got["partitionColumn"] == "d" and got["numPartitions"] == "32"


def test_risk_rules(spark):
    df = spark.createDataFrame([(59,), (60,), (69,), (70,), (71,)], "age int")
    got = [r[0] for r in df.select(col.age_risk(F.col("age"))).collect()]
    assert got == ["Low", "Medium", "Medium", "Low", "High"]
    cases = [("Prohibited", "High", "High", "Prohibited"), ("High", "Low", "Low", "High"),
             ("Low", "Medium", "High", "High"), ("Low", "Medium", "Low", "Medium"),
             ("Low", "Low", "Low", "Low")]
    df = spark.createDataFrame(cases, "c string, a string, j string, want string")
    level = col.risk_level(F.col("c"), F.col("a"), F.col("j"))
    assert df.filter(level != F.col("want")).count() == 0


def test_small_expressions(spark):
    df = spark.createDataFrame([(0.125, None, "t", 1), (0.375, 2.0, None, 2)], "x double, y double, s string, n int")
    assert [r.x for r in col.round_numeric(df).collect()] == [0.12, 0.38]
    assert [r[0] for r in df.select(col.concat_text("s", "s")).collect()] == ["t. t", ". "]
    assert [r[0] for r in df.select(col.row_total(["x", "y"])).collect()] == [0.125, 2.375]
    sig = col.trade_signal(F.col("n"), 1, 2)
    assert [r[0] for r in df.select(sig).collect()] == ["buy", "sell"]
    peg = df.select(F.lit(2.2).alias("close"), F.lit(1.0).alias("high"), F.lit(1.0).alias("low"),
                    F.lit(1.0).alias("volume"), F.lit(0.0).alias("market_cap"))
    got = peg.withColumns(col.peg_features(2.0)).first()
    assert got.percentage_deviation == pytest.approx(10) and got.volume_to_market_cap_ratio is None


def test_dedupe_melt_encode_counts(spark):
    df = spark.createDataFrame([("b", 2, 1), ("a", 1, 5), ("b", 1, 9)], "k string, o int, v int")
    assert sorted(map(tuple, tables.dedupe_first(df, ["k"], ["o"]).collect())) == [("a", 1, 5), ("b", 1, 9)]
    long = tables.melt(df, ["k"], ["o", "v"], "name", "value")
    assert long.count() == 6 and long.agg(F.sum("value")).first()[0] == 19
    words = [("pear",), ("apple",), ("äpfel",), ("apple",), ("pea",)]
    codes = tables.label_encode(spark.createDataFrame(words, "w string"), "w", "code").collect()
    assert dict((r.w, r.code) for r in codes) == {"apple": 0, "pea": 1, "pear": 2, "äpfel": 3}
    counts = tables.fixed_counts(df, "k", ["a", "b", "z"]).collect()
    assert {r.k: r.n for r in counts} == {"a": 1, "b": 2, "z": 0}


def test_weighted_pick(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate([0, 1, 5, 0, 2])], "item int, weight int")
    picks = tables.weighted_pick(df, "item", "weight", 4).collect()
    assert len({r.item for r in picks}) == 4 and picks[-1].weight == 0
    assert [r.item for r in picks] == [r.item for r in tables.weighted_pick(df, "item", "weight", 4).collect()]
    drawn = tables.weighted_pick_replace(df, "item", "weight", 4000).groupBy("item").count().collect()
    share = {r.item: r["count"] / 4000 for r in drawn}
    assert set(share) == {1, 2, 4}
    assert share[2] == pytest.approx(5 / 8, abs=0.04)


def test_recent_period_and_top(spark):
    rows = [(i, dt.date(2024, 1, i)) for i in range(1, 21)]
    df = spark.createDataFrame(rows, "k int, d date")
    assert tables.recent_period(df, "d", 7).agg(F.min("k")).first()[0] == 13
    fixed = tables.recent_period(df, "d", 7, F.lit("2024-01-10").cast("date"))
    assert fixed.agg(F.min("k")).first()[0] == 3
    assert [r.k for r in tables.top(df, 2, "d", "k").collect()] == [20, 19]


def test_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "t string, p string")
    rep = {r.label: r for r in metrics.classification_report(df, "t", "p").collect()}
    assert rep["b"].precision == pytest.approx(1 / 3) and rep["b"].recall == 1.0
    assert (rep["c"].precision, rep["c"].recall, rep["c"].f1, rep["c"].support) == (0, 0, 0, 1)
    grid = metrics.confusion(df, "t", "p", ["a", "b", "c"]).collect()
    assert len(grid) == 9 and sum(r.n for r in grid) == 4
    assert metrics.accuracy(df, "t", "p").first()[0] == 0.5
    num = spark.createDataFrame([(1.0, 1.0), (3.0, 2.0), (5.0, None)], "y double, p double")
    got = metrics.regression_scores(num, "y", "p").first()
    assert (got.mse, got.mae, got.r2) == (0.5, 0.5, 0.5)


def test_label_encode_keeps_rows_without_a_label(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "id int, w string")
    out = {r.id: r.code for r in tables.label_encode(df, "w", "code").collect()}
    assert out == {1: 1, 2: None, 3: 0, 4: 1}


def test_label_encode_numbers_many_labels_with_one_beginning(spark):
    names = [f"NATION {i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(n,) for n in reversed(names)], "w string")
    out = {r.w: r.code for r in tables.label_encode(df, "w", "code").collect()}
    assert out == {n: i for i, n in enumerate(names)}


def test_draws_follow_the_weights_over_ranges(spark):
    """Chi-square over 200 items in many ranges; an item of weight 0 is never drawn."""
    rows = [(i, float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "item int, weight double").repartition(7)
    n = 20_000
    got = {r["item"]: r["n"] for r in tables.weighted_pick_replace(df, "item", "weight", n).groupBy("item").agg(F.count("*").alias("n")).collect()}
    total = sum(w for _, w in rows)
    assert sum(got.values()) == n and not any(got.get(i, 0) for i, w in rows if not w)
    chi = sum((got.get(i, 0) - n * w / total) ** 2 / (n * w / total) for i, w in rows if w)
    assert chi < 160 + 4 * (2 * 160) ** 0.5
    assert tables.weighted_pick_replace(df.limit(0), "item", "weight", 5).collect() == []


def test_ranks_of_any_type(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",), ("é",)], "k string")
    got = {r["k"]: r["n"] for r in tables.ranked(df, "k", "n").collect()}
    assert got == {"a": 0, "b": 1, "é": 2}


def test_merge_rewrites_touched_files_only(spark, tmp_path):
    from candlewick.sources import keyed

    root = f"{tmp_path}/t"
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]
    df = spark.createDataFrame([(i, float(i), days[0]) for i in range(1000)], "k int, v double, t date")
    keyed.create(df, root, "k", file_rows=100)
    before = {r["path"]: (r["lo"], r["hi"]) for r in keyed.manifest(spark, root).collect()}
    assert len(before) == 10
    new = spark.createDataFrame([(250, -1.0, days[0]), (250, -2.0, days[1]), (251, -3.0, days[0]), (5000, 9.0, days[0])], df.schema)
    assert keyed.merge(spark, root, new, "k", "t", file_rows=100) == (1, 9)
    after = {r["path"] for r in keyed.manifest(spark, root).collect()}
    hit = {p for p, (lo, hi) in before.items() if lo <= 250 <= hi}
    assert set(before) - after == hit and len(hit) == 1
    rows = {r["k"]: r["v"] for r in keyed.load(spark, root).collect()}
    assert rows == {i: float(i) for i in range(1000)} | {250: -2.0, 251: -3.0, 5000: 9.0}
    assert keyed.load(spark, root, 0).count() == 1000
    # A merge that died after its data and before its manifest leaves the table as it is.
    (tmp_path / "t/manifest/00000002").mkdir()
    assert keyed.versions(spark, root) == [0, 1]
    assert keyed.merge(spark, root, new.limit(0), "k", "t") == (0, len(after))
    assert keyed.load(spark, root).count() == 1001


def test_quantile_against_sorted_values(spark):
    from candlewick.operators import tables

    for n in (1, 2, 9, 10, 11, 300):
        values = [(i * 7919) % 131 for i in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "k bigint").repartition(5)
        for q in (0.0, 0.1, 0.5, 0.9, 1.0)[:: 1 if n in (10, 300) else 3]:
            want = sorted(values)[max(-(-round(n * q * 10) // 10), 1) - 1]
            assert [r["value"] for r in tables.quantile_disc(df, "k", q).collect()] == [want]
    assert tables.quantile_disc(df.limit(0), "k", 0.9).collect() == []
