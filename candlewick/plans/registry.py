"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` only its rows can be checked."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Two engines add doubles in different orders, so results are compared on a
# decimal grid. The small shift keeps exact decimal halves (an average of eight
# prices, say) away from the rounding boundary.
SHIFT = 0.0313


def snap(value: Column, places: int = 4) -> Column:
    return F.round(value + F.lit(SHIFT * 10.0**-places), places) + F.lit(0.0)


def snapped(df: DataFrame, keys: list[str], places: int = 4, **override: int) -> DataFrame:
    """Keys as they are, every other column snapped."""
    rest = {c: override.get(c, places) for c in df.columns if c not in keys}
    return df.selectExpr(*keys, *[f"{sql_snap(c, p)} AS {c}" for c, p in rest.items()])


def sql_snap(expr: str, places: int = 4) -> str:
    return f"round(({expr}) + CAST({SHIFT * 10.0**-places!r} AS DOUBLE), {places}) + CAST(0 AS DOUBLE)"


def sql_columns(columns: dict[str, str], places: int = 4, **override: int) -> str:
    return ", ".join(
        f"{sql_snap(e, override.get(n, places))} AS {n}" for n, e in columns.items()
    )


BARS = """bars AS MATERIALIZED (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS d,
         min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume,
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS market_cap
  FROM orders GROUP BY 1, 2)"""

NUM = BARS + """, num AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS rn FROM bars)"""

PEG_BARS = """peg_bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS d,
         max(l_discount) + 0.95 AS high, min(l_discount) + 0.95 AS low,
         round(CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) + 0.95, 6) AS close,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS volume,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) + 1000 AS market_cap
  FROM lineitem GROUP BY 1, 2)"""

TICKS = """ticks AS (
  SELECT event_id, ts, event_type AS symbol, value FROM events)"""

BASKETS = """items AS MATERIALIZED (
  SELECT DISTINCT l_orderkey AS basket,
         CAST(regexp_extract(p_brand, '(\\d+)$', 1) AS INT) AS item
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

NEWS = """news AS (
  SELECT doc_id, source, lang, text, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS article_date
  FROM documents)"""

TOKENS = """tok AS MATERIALIZED (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token,
         generate_subscripts(regexp_extract_all(lower(text), '\\p{L}+'), 1) - 1 AS pos
  FROM documents WHERE text IS NOT NULL)"""

LEXICON = """lex AS MATERIALIZED (
  SELECT token, (digit - 7.5) / 2 AS valence FROM (
    SELECT DISTINCT token, CAST('0x' || substr(md5(token), 1, 1) AS INT) AS digit FROM tok)
  WHERE digit < 4 OR digit > 11)"""

CUSTOMERS = """cust AS (
  SELECT c_custkey AS id, CAST(18 + c_custkey % 70 AS INT) AS age, n_name AS country,
         c_mktsegment AS job_title, c_acctbal AS balance, coalesce(v, 0.0) AS volume
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v
             FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
