"""Shared inputs of the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bars import bars_from_ticks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values, one series per event type."""
    e = table(spark, sf_dir, "events")
    return bars_from_ticks(e, F.col("event_type"), F.col("ts"), F.col("value"), F.col("event_id"), "1h")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals, one series per priority."""
    o = table(spark, sf_dir, "orders")
    return bars_from_ticks(
        o, F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_totalprice"), F.col("o_orderkey"), "1d"
    )


BARS = """bars AS (
  SELECT event_type AS symbol, '1h' AS "interval", date_trunc('hour', ts)::TIMESTAMP AS "timestamp",
         arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, event_id) AS "close", count(*)::DOUBLE AS volume
  FROM events GROUP BY ALL)"""

NUMBERED = BARS + """, b AS (
  SELECT *, row_number() OVER s AS rn, lag("close") OVER s AS pc, lag(high) OVER s AS ph, lag(low) OVER s AS pl,
         (high + low + "close") / 3 AS tp
  FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY "timestamp"))"""

DAILY = """bars AS (
  SELECT o_orderpriority AS symbol, '1d' AS "interval", date_trunc('day', o_orderdate)::TIMESTAMP AS "timestamp",
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS "close", count(*)::DOUBLE AS volume
  FROM orders GROUP BY ALL)"""

KEY_SQL = 'symbol, "interval", "timestamp"'


def over(n: int | None = None) -> str:
    """SQL window of the last n rows of a series, or of the whole past."""
    past = "UNBOUNDED" if n is None else n - 1
    return f'OVER (PARTITION BY symbol ORDER BY "timestamp" ROWS BETWEEN {past} PRECEDING AND CURRENT ROW)'


def full_sql(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


def ema_sql(x: str, n: int) -> str:
    k = f"(2.0::DOUBLE / {n + 1})"
    return f"list_reduce(list({x}) {over()}, lambda p, q: q * {k} + p * (1 - {k}))"


def rounded(columns: Sequence[str], digits: int = 6) -> list[Column]:
    """Rounded columns; the small shift keeps exact halves on one side."""
    return [F.expr(f"round(`{c}` + 1e-{digits + 3}D, {digits}) AS `{c}`") for c in columns]


def result(df: DataFrame, columns: Sequence[str], digits: int = 6, keys: Sequence[str] = ("symbol", "interval", "timestamp")) -> DataFrame:
    """Keys and rounded value columns, as compared with SQL."""
    return df.select(*keys, *rounded(columns, digits))


def result_sql(ctes: str, columns: dict[str, str], digits: int = 6, source: str = "b", keys: str = KEY_SQL) -> str:
    values = ", ".join(f'round({e} + 1e-{digits + 3}, {digits}) AS "{n}"' for n, e in columns.items())
    return f"WITH {ctes} SELECT {keys}, {values} FROM {source}"
