"""Itemsets, rules, neighbouring baskets and table operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candlewick.functions.columns import row_total
from candlewick.operators import patterns, tables
from candlewick.plans.registry import BARS, BASKETS, query, snap, snapped, sql_columns, sql_snap
from candlewick.session import checkpoint_root, settle
from candlewick.sources import keyed, views

MIN_SUPPORT = 0.0001
MIN_CONFIDENCE = 0.2
# A rule is significant above these: no rule that is mined and lifts is left out.
STRONG = {"confidence": MIN_CONFIDENCE, "lift": 1.0, "support": MIN_SUPPORT}
STRONG_SQL = " AND ".join(f"{c} > {v}" for c, v in STRONG.items())

N = BASKETS + """, n AS (SELECT count(DISTINCT basket) AS n FROM items)"""
PAIRS = """pairs AS MATERIALIZED (
  SELECT [a.item, b.item] AS items, count(*) AS freq FROM items a JOIN items b
    ON a.basket = b.basket AND a.item < b.item GROUP BY 1)"""
TRIPLES = """triples AS MATERIALIZED (
  SELECT [a.item, b.item, c.item] AS items, count(*) AS freq FROM items a
    JOIN items b ON a.basket = b.basket AND a.item < b.item
    JOIN items c ON a.basket = c.basket AND b.item < c.item GROUP BY 1)"""
# Sets of every size: each basket's sets grow by a larger item of the same basket.
SETS = f"""{N}, {PAIRS}, {TRIPLES}, grown AS (
  SELECT basket, item AS last, [item] AS items FROM items
  UNION ALL
  SELECT g.basket, i.item, list_append(g.items, i.item)
  FROM grown g JOIN items i ON i.basket = g.basket AND i.item > g.last),
sets AS MATERIALIZED (
  SELECT items, freq, freq / n AS support FROM (
    SELECT items, count(*) AS freq FROM grown GROUP BY 1), n
  WHERE freq / n >= {MIN_SUPPORT})"""


def _names(df):
    """Arrays as text, so both engines print an itemset the same way."""
    return df.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


def _sets(spark, root):
    return patterns.itemsets(patterns.encode(views.basket_items(spark, root)), MIN_SUPPORT)


@query("basket_encode", f"WITH {BASKETS} SELECT basket, string_agg(item, ',' ORDER BY item) AS items FROM items GROUP BY 1")
def basket_encode(spark, root):
    return _names(patterns.encode(views.basket_items(spark, root)))


@query(
    "top_pairs",
    f"""WITH {BASKETS}, {PAIRS} SELECT array_to_string(items, ',') AS items, freq FROM pairs
    ORDER BY freq DESC, pairs.items LIMIT 10""",
)
def top_pairs(spark, root):
    baskets = patterns.encode(views.basket_items(spark, root))
    return _names(tables.top(patterns.combination_counts(baskets, 2), 10, "freq", "items"))


@query(
    "top_triplets",
    f"""WITH {BASKETS}, {TRIPLES} SELECT array_to_string(items, ',') AS items, freq FROM triples
    ORDER BY freq DESC, triples.items LIMIT 10""",
)
def top_triplets(spark, root):
    baskets = patterns.encode(views.basket_items(spark, root))
    return _names(tables.top(patterns.combination_counts(baskets, 3), 10, "freq", "items"))


@query(
    "itemsets",
    f"""WITH RECURSIVE {SETS} SELECT array_to_string(items, ',') AS items, freq,
      {sql_snap('support', 9)} AS support FROM sets""",
)
def itemsets(spark, root):
    return _names(_sets(spark, root)).withColumn("support", snap(F.col("support"), 9))


@query(
    "itemset_sizes",
    f"""WITH RECURSIVE {SETS} SELECT CAST(len(items) AS INT) AS size, count(*) AS n, CAST(sum(freq) AS BIGINT) AS freq
    FROM sets GROUP BY 1""",
)
def itemset_sizes(spark, root):
    sets = _sets(spark, root)
    return sets.groupBy(F.size("items").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("freq").alias("freq")
    )


@query(
    "itemsets_any_size",
    f"""WITH RECURSIVE {SETS} SELECT CAST(len(items) AS INT) AS size, array_to_string(items, ',') AS items,
      freq FROM sets WHERE len(items) > 3""",
)
def itemsets_any_size(spark, root):
    sets = _sets(spark, root).filter(F.size("items") > 3)
    return _names(sets.select(F.size("items").alias("size"), "items", "freq"))


RULES = SETS + f""", cand AS (
  SELECT items, support, unnest(generate_series(1, (1 << len(items)) - 2)) AS mask
  FROM sets WHERE len(items) > 1),
split AS (
  SELECT support,
    [items[i] FOR i IN generate_series(1, len(items)) IF (mask >> (i - 1)) & 1 = 1] AS x,
    [items[i] FOR i IN generate_series(1, len(items)) IF (mask >> (i - 1)) & 1 = 0] AS y
  FROM cand),
rules AS MATERIALIZED (
  SELECT x AS antecedents, y AS consequents, s.support, s.support / a.support AS confidence,
    s.support / a.support / b.support AS lift, s.support - a.support * b.support AS leverage,
    CASE WHEN s.support / a.support < 1 THEN (1 - b.support) / (1 - s.support / a.support) END AS conviction
  FROM split s JOIN sets a ON a.items = s.x JOIN sets b ON b.items = s.y
  WHERE s.support / a.support >= {MIN_CONFIDENCE})"""


@query(
    "rules",
    f"""WITH RECURSIVE {RULES} SELECT array_to_string(antecedents, ',') AS antecedents,
      array_to_string(consequents, ',') AS consequents, {sql_columns({
        c: c for c in ("support", "confidence", "lift", "leverage", "conviction")}, 7)} FROM rules""",
)
def rules(spark, root):
    out = patterns.rules(_sets(spark, root), MIN_CONFIDENCE).withColumns(
        {
            c: F.array_join(F.col(c).cast("array<string>"), ",")
            for c in ("antecedents", "consequents")
        }
    )
    return snapped(out, ["antecedents", "consequents"], 7)


@query(
    "rule_items",
    f"""WITH RECURSIVE {RULES} SELECT DISTINCT unnest(antecedents) AS item FROM rules
    WHERE {STRONG_SQL}""",
)
def rule_items(spark, root):
    found = patterns.rules(_sets(spark, root), MIN_CONFIDENCE)
    return patterns.rule_items(patterns.significant(found, **STRONG))


POOL = f"""{SETS}, best AS (
  (SELECT items, 0 AS points FROM sets ORDER BY freq DESC, items LIMIT 6)
  UNION ALL (SELECT items, 2 FROM sets WHERE len(items) = 2 ORDER BY freq DESC, items LIMIT 6)
  UNION ALL (SELECT items, 3 FROM sets WHERE len(items) = 3 ORDER BY freq DESC, items LIMIT 6)),
pool AS (
  SELECT item, CAST(sum(points) AS BIGINT) AS weight
  FROM (SELECT unnest(items) AS item, points FROM best) GROUP BY 1)"""


@query("item_pool", f"WITH RECURSIVE {POOL} SELECT item, weight FROM pool")
def item_pool(spark, root):
    return patterns.item_pool(_sets(spark, root))


@query(
    "weighted_pick",
    f"""WITH RECURSIVE {POOL}, u AS (
      SELECT item, weight, (CAST('0x' || substr(md5('42|' || item), 1, 8) AS BIGINT) + 0.5::DOUBLE)
        / 4294967296.0::DOUBLE AS u FROM pool)
    SELECT item, weight, {sql_snap("CASE WHEN weight > 0 THEN -ln(u) / weight END", 9)} AS draw_key
    FROM u ORDER BY CASE WHEN weight > 0 THEN -ln(u) / weight END NULLS LAST, item LIMIT 6""",
)
def weighted_pick(spark, root):
    pool = patterns.item_pool(_sets(spark, root))
    out = tables.weighted_pick(pool, "item", "weight", 6)
    return out.withColumn("draw_key", snap(F.col("draw_key"), 9))


@query(
    "weighted_pick_replace",
    f"""WITH RECURSIVE {POOL}, line AS (
      SELECT item, sum(weight) OVER (ORDER BY item) AS z, sum(weight) OVER (ORDER BY item) - weight AS a
      FROM pool WHERE weight > 0),
    points AS (
      SELECT draw, (CAST('0x' || substr(md5('42|' || draw), 1, 8) AS BIGINT) + 0.5::DOUBLE)
        / 4294967296.0::DOUBLE * (SELECT sum(weight) FROM pool) AS p
      FROM (SELECT unnest(generate_series(1, 100)) AS draw))
    SELECT CAST(draw AS INT) AS draw, item FROM points JOIN line ON p >= a AND p < z""",
)
def weighted_pick_replace(spark, root):
    pool = patterns.item_pool(_sets(spark, root))
    return tables.weighted_pick_replace(pool, "item", "weight", 100)


def _neighbours_sql(sign: str) -> str:
    return f"""WITH {BASKETS}, seqs AS (
      SELECT basket, row_number() OVER (ORDER BY basket) AS seq FROM (SELECT DISTINCT basket FROM items)),
    rows AS MATERIALIZED (SELECT i.basket, item, seq FROM items i JOIN seqs s ON s.basket = i.basket),
    hits AS (SELECT DISTINCT a.basket, a.item FROM rows a JOIN rows b ON a.item = b.item
      AND b.seq IN (a.seq {sign} 1, a.seq {sign} 2, a.seq {sign} 3, a.seq {sign} 4))
    SELECT r.basket, count(h.item) AS appearances,
      coalesce(string_agg(h.item, ', ' ORDER BY h.item), '') AS matching_items
    FROM rows r LEFT JOIN hits h ON h.basket = r.basket AND h.item = r.item GROUP BY 1"""


@query("repeat_in_neighbours", _neighbours_sql("+"))
def repeat_in_neighbours(spark, root):
    return patterns.repeats_in_neighbours(views.basket_items(spark, root), 4, "next")


@query("repeat_in_previous", _neighbours_sql("-"))
def repeat_in_previous(spark, root):
    return patterns.repeats_in_neighbours(views.basket_items(spark, root), 4, "previous")


@query(
    "recent_hits",
    f"""WITH {BASKETS}, last AS (SELECT DISTINCT basket FROM items ORDER BY basket DESC LIMIT 4)
    SELECT c.item, count(i.basket) AS hits, count(i.basket) / 4 * 100 AS percentage
    FROM (SELECT CAST(unnest(generate_series(1, 12)) AS INT) AS item) c
    LEFT JOIN (SELECT * FROM items WHERE basket IN (FROM last)) i ON i.item = c.item GROUP BY 1""",
)
def recent_hits(spark, root):
    return patterns.recent_hits(views.basket_items(spark, root), list(range(1, 13)), 4)


# ---------------------------------------------------------------- table operations


@query(
    "melt",
    f"""WITH {BARS} SELECT symbol, d, unnest(['open', 'high', 'low', 'close']) AS field,
      unnest([open, high, low, close]) AS price FROM bars""",
)
def melt(spark, root):
    bars = views.bars(spark, root)
    return tables.melt(bars, ["symbol", "d"], ["open", "high", "low", "close"], "field", "price")


@query(
    "row_totals",
    f"""WITH {BARS} SELECT symbol, d, {sql_snap("open + high + low + close", 2)} AS total_sum FROM bars""",
)
def row_totals(spark, root):
    bars = views.bars(spark, root)
    total = row_total(["open", "high", "low", "close"])
    return bars.select("symbol", "d", snap(total, 2).alias("total_sum"))


@query(
    "dedupe_first",
    """SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, arg_min(o_orderkey, o_orderkey) AS o_orderkey,
      arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2""",
)
def dedupe_first(spark, root):
    orders = views.table(spark, root, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderkey", "o_totalprice"
    )
    return tables.dedupe_first(orders, ["o_custkey", "d"], ["o_orderkey"])


@query(
    "dedupe_text",
    "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1",
)
def dedupe_text(spark, root):
    docs = views.table(spark, root, "documents").select("doc_id", "text")
    return tables.dedupe_first(docs, ["text"], ["doc_id"])


@query(
    "hash_split",
    """SELECT o_orderkey, CASE WHEN CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT)
      % 10 < 8 THEN 'train' ELSE 'test' END AS part FROM orders""",
)
def hash_split(spark, root):
    return tables.hash_split(views.table(spark, root, "orders").select("o_orderkey"), "o_orderkey")


@query(
    "last_rows",
    """SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d FROM orders
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 20""",
)
def last_rows(spark, root):
    orders = views.table(spark, root, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return tables.top(orders, 20, "o_orderdate", "o_orderkey").select(
        "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("d")
    )


UPSERT_SQL = """WITH changes AS (
  SELECT o_orderkey + CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 10000000000 END AS k,
    o_totalprice + 1 AS v, o_orderdate AS t FROM orders WHERE o_orderstatus <> 'O')
SELECT o_orderkey AS k, o_totalprice AS v, CAST(o_orderdate AS DATE) AS t FROM orders
  WHERE o_orderkey NOT IN (SELECT k FROM changes)
UNION ALL SELECT k, v, CAST(t AS DATE) FROM changes"""


def _order_changes(spark, root):
    """(current, changes): half of the changes move a row's value, the others bring new keys."""
    orders = views.table(spark, root, "orders")
    day = F.col("o_orderdate").cast("date").alias("t")
    current = orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), day)
    moved = F.when(F.col("o_orderstatus") == "F", 0).otherwise(10_000_000_000)
    changes = orders.filter(F.col("o_orderstatus") != "O").select(
        (F.col("o_orderkey") + moved).alias("k"), (F.col("o_totalprice") + 1).alias("v"), day
    )
    return current, changes


@query("upsert_latest", UPSERT_SQL)
def upsert_latest(spark, root):
    return tables.upsert(*_order_changes(spark, root), ["k"], "t")


@query(
    "upsert_files",
    """WITH c AS (SELECT o_orderkey AS k, o_totalprice AS v, CAST(o_orderdate AS DATE) AS t FROM orders),
    edge AS (SELECT quantile_disc(k, 0.9) AS e FROM c)
    SELECT k, CASE WHEN k >= e THEN v + 1 ELSE v END AS v, t FROM c, edge
    UNION ALL SELECT k + 10000000000, v + 1, t FROM c, edge WHERE k >= e""",
)
def upsert_files(spark, root):
    """Changes of the last tenth of the keys and new keys behind them, merged into the files they touch."""
    current, _ = _order_changes(spark, root)
    edge = settle(tables.quantile_disc(current, "k", 0.9).withColumnRenamed("value", "e"))
    last = current.join(F.broadcast(edge), F.col("k") >= F.col("e")).drop("e").withColumn("v", F.col("v") + 1)
    fresh = last.withColumn("k", F.col("k") + 10_000_000_000)
    table = f"{checkpoint_root(spark)}/keyed-{uuid.uuid4().hex}"
    keyed.create(current, table, "k", file_rows=max(1000, current.count() // 20))
    keyed.merge(spark, table, last.unionByName(fresh), "k", "t")
    return keyed.load(spark, table)


@query(
    "stacked_bars",
    f"""WITH {BARS}, p AS (SELECT symbol, d, close, 'price' AS type FROM bars
      UNION ALL SELECT symbol, d, volume, 'volume' FROM bars) SELECT * FROM p""",
)
def stacked_bars(spark, root):
    bars = views.bars(spark, root)
    price = bars.select("symbol", "d", "close", F.lit("price").alias("type"))
    volume = bars.select("symbol", "d", F.col("volume").alias("close"), F.lit("volume").alias("type"))
    return price.unionByName(volume)
