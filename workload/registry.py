"""Registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query function under its name, with the SQL that gives the same rows."""

    def register(fn: Callable) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def joined(values: Column) -> Column:
    """Array -> comma-separated text, so that both engines compare the same type."""
    return F.array_join(values, ",")


def micros(name: str, alias: str | None = None) -> Column:
    return F.unix_micros(name).alias(alias or f"{name}_us")


# SQL of the table roles in ``tables.py``.
EV = """ev AS (
  SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, event_type,
         regexp_extract(props, '([0-9]+)', 1) AS item_id,
         (regexp_extract(props, '([0-9]+)', 1)::INT % 10)::VARCHAR AS category_id,
         ts, user_id::VARCHAR AS session_id, value
  FROM events)"""

TRADES = """trades AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id,
         CASE l_returnflag WHEN 'A' THEN 'click' WHEN 'N' THEN 'view' WHEN 'R' THEN 'purchase' END AS event_type,
         l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

INV = """inv AS (
  SELECT l_partkey::VARCHAR AS item_id, l_shipdate AS ts, l_returnflag <> 'R' AND l_quantity::INT > 0 AS ok,
         row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey,
           l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn,
         l_orderkey, l_linenumber
  FROM lineitem)"""

LOG = """log AS (
  SELECT ts, CASE event_type WHEN 'click' THEN 'tier1_precomputed' WHEN 'view' THEN 'tier2_rerank'
           WHEN 'purchase' THEN 'tier3_inference' WHEN 'signup' THEN 'fallback_popular' ELSE 'unknown' END AS tier,
         value AS duration_ms, event_type = 'error' AS error,
         regexp_extract(props, '([0-9]+)', 1)::INT * 40 AS load
  FROM events)"""

WEIGHT = "CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'purchase' THEN 5.0 ELSE 0.0 END"
POP = f"""pop AS (
  SELECT row_number() OVER (ORDER BY score DESC, item_id) AS rank, item_id, score
  FROM (SELECT item_id, sum({WEIGHT})::DOUBLE AS score FROM ev GROUP BY 1)
  ORDER BY rank LIMIT 100)"""
