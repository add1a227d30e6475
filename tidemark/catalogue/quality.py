"""Queries for sources, checks and repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalogue.common import BARS, KEY_SQL, hourly_bars, table
from tidemark.operators import quality as Q
from tidemark.schemas import BAR_VALUES, KEYS
from tidemark.sources import datasets, files, klines

QUERIES = {}
SQL = {}
AS_OF = "2024-02-01 12:00:00"


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def broken_bars(spark, d):
    """Hourly bars with swapped, missing and repeated values, and their ingest position."""
    b = hourly_bars(spark, d)
    swap = F.dayofmonth("timestamp") % 7 == 0
    late = F.when((F.hour("timestamp") == 7) & (F.dayofmonth("timestamp") % 2 == 0), 5000).otherwise(0)
    hours = (F.unix_seconds("timestamp") / 3600).cast("long")
    return b.select(
        "symbol", "interval", "timestamp", "open",
        F.when(swap, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(swap, F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(F.hour("timestamp") != 3, F.col("close")).alias("close"),
        F.when(F.hour("timestamp") == 9, -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.explode(F.when(F.hour("timestamp") == 5, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        hours.alias("_h"), late.alias("_late"),
    ).select("symbol", "interval", "timestamp", *BAR_VALUES,
             (F.col("_h") * 2 + F.col("copy") + F.col("_late")).alias("ingest"))


BROKEN = BARS + """, x AS (SELECT symbol, "interval", "timestamp", open,
  CASE WHEN day("timestamp") % 7 = 0 THEN low ELSE high END AS high,
  CASE WHEN day("timestamp") % 7 = 0 THEN high ELSE low END AS low,
  CASE WHEN hour("timestamp") <> 3 THEN "close" END AS "close",
  CASE WHEN hour("timestamp") = 9 THEN -volume ELSE volume END AS volume,
  (epoch("timestamp") / 3600)::BIGINT * 2 + c.copy + CASE WHEN hour("timestamp") = 7 AND day("timestamp") % 2 = 0 THEN 5000 ELSE 0 END AS ingest
  FROM bars, (VALUES (0), (1)) c(copy) WHERE c.copy = 0 OR hour("timestamp") = 5)"""
ORDER_SQL = '(low > open OR low > high OR low > "close" OR high < open OR high < "close")'
K = 'symbol, "interval"'


def union_sql(columns, line):
    return " UNION ALL ".join(line.format(c=c) for c in columns)


COMPLETE_SQL = union_sql(BAR_VALUES, """SELECT symbol, "interval", 'completeness' AS check_type,
  CASE WHEN count(*) FILTER ("{c}" IS NULL) * 100.0 / count(*) > 10 THEN 'critical' ELSE 'medium' END AS severity, '{c}' AS column_name,
  count(*) FILTER ("{c}" IS NULL) AS affected, count(*) AS n_rows FROM x GROUP BY ALL""")
CONSIST_SQL = f"""SELECT symbol, "interval", 'consistency' AS check_type, 'high' AS severity, 'open,high,low,close' AS column_name,
  count(*) FILTER ({ORDER_SQL}) AS affected, count(*) AS n_rows FROM x GROUP BY ALL"""
VALID_SQL = union_sql(Q.PRICES, """SELECT symbol, "interval", 'validity' AS check_type, 'critical' AS severity, '{c}' AS column_name,
  count(*) FILTER ("{c}" <= 0) AS affected, count(*) AS n_rows FROM x GROUP BY ALL""")
TIME_SQL = f"""SELECT symbol, "interval", 'timeliness' AS check_type, 'medium' AS severity, 'timestamp' AS column_name,
  CASE WHEN epoch(TIMESTAMP '{AS_OF}' - max("timestamp")) / 3600 > 24 THEN count(*) ELSE 0 END AS affected, count(*) AS n_rows FROM x GROUP BY symbol, "interval" """


@query(f"WITH {BROKEN} SELECT * FROM ({COMPLETE_SQL}) WHERE affected > 0")
def check_completeness(spark, d):
    return Q.completeness(broken_bars(spark, d))


@query(f"WITH {BROKEN} SELECT * FROM ({CONSIST_SQL}) WHERE affected > 0")
def check_consistency(spark, d):
    return Q.consistency(broken_bars(spark, d))


@query(f"WITH {BROKEN}, y AS (SELECT * REPLACE (open - 1 AS open, low - 2 AS low) FROM x) SELECT * FROM ({VALID_SQL.replace('FROM x', 'FROM y')}) WHERE affected > 0")
def check_validity(spark, d):
    shifted = broken_bars(spark, d).withColumns({"open": F.col("open") - 1, "low": F.col("low") - 2})
    return Q.validity(shifted)


@query(f"WITH {BROKEN} SELECT * FROM ({TIME_SQL}) WHERE affected > 0")
def check_timeliness(spark, d):
    return Q.timeliness(broken_bars(spark, d), AS_OF)


SCORE_SQL = f"""WITH {BROKEN}, i AS ({COMPLETE_SQL} UNION ALL {CONSIST_SQL} UNION ALL {VALID_SQL} UNION ALL {TIME_SQL}),
  s AS (SELECT {K}, max(n_rows) AS n_rows, count(*) FILTER (affected > 0) AS n_issues, """ + ", ".join(
    f"""greatest(0, 100 - coalesce(sum(least(20, affected * 100.0::DOUBLE / n_rows) * CASE severity WHEN 'critical' THEN 2 WHEN 'high' THEN 1.5 ELSE 1 END)
    FILTER (check_type = '{c}'), 0)) AS {c}_score""" for c in ["completeness", "consistency", "validity", "timeliness"]) + f" FROM i GROUP BY {K})"
SCORES = ["completeness_score", "consistency_score", "validity_score", "timeliness_score", "overall_score"]
SCORE_COLS = ", ".join(
    f"round({c if c != 'overall_score' else '(completeness_score + consistency_score + validity_score + timeliness_score) / 4'} + 1e-9, 6) AS {c}" for c in SCORES)


@query(f"{SCORE_SQL} SELECT {K}, n_rows, {SCORE_COLS} FROM s")
def quality_scores(spark, d):
    out = Q.scores(Q.issues(broken_bars(spark, d), AS_OF))
    return out.select(*KEYS, "n_rows", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in SCORES])


@query(f"{SCORE_SQL} SELECT {K}, n_rows, n_issues, {SCORE_COLS} FROM s")
def quality_assessment(spark, d):
    out = Q.assess(broken_bars(spark, d), AS_OF)
    return out.select(*KEYS, "n_rows", "n_issues", *[F.round(F.col(c) + 1e-9, 6).alias(c) for c in SCORES])


NULLS = " + ".join(f'("{c}" IS NULL)::INT' for c in BAR_VALUES)


@query(f"""WITH {BROKEN}, o AS (SELECT *, lag("timestamp") OVER (PARTITION BY symbol ORDER BY ingest) AS pt FROM x)
  SELECT {K}, count(*) AS n_rows, sum({NULLS})::BIGINT AS n_null_values,
  count(*) FILTER ({ORDER_SQL} OR open <= 0 OR high <= 0 OR low <= 0 OR "close" <= 0) AS n_bad_prices,
  count(*) - count(DISTINCT "timestamp") AS n_repeated_timestamps, count(*) FILTER ("timestamp" < pt) AS n_out_of_order FROM o GROUP BY {K}""")
def table_validity(spark, d):
    return Q.table_validity(broken_bars(spark, d), "ingest")


PAIRS = [("high", "low"), ("high", "open"), ("high", "close"), ("open", "low"), ("close", "low")]


@query(f"WITH {BROKEN} SELECT {K}, count(*) AS n_rows, " + ", ".join(
    [f'count(*) FILTER ("{c}" IS NULL) AS null_{c}' for c in BAR_VALUES]
    + [f'count(*) FILTER ("{a}" < "{b}") AS {a}_below_{b}' for a, b in PAIRS]) + f" FROM x GROUP BY {K}")
def indicator_input_check(spark, d):
    return Q.indicator_input(broken_bars(spark, d))


CLEAN_SQL = f"""WITH {BROKEN}, f AS (SELECT *, row_number() OVER (PARTITION BY symbol, "timestamp" ORDER BY ingest) AS i FROM x)
  SELECT {KEY_SQL}, open, greatest(high, open, "close") AS high, least(low, open, "close") AS low, "close", volume, ingest FROM f WHERE i = 1"""


@query(CLEAN_SQL)
def clean_bars(spark, d):
    return Q.clean(broken_bars(spark, d), "ingest")


@query(f"""SELECT * FROM ({CLEAN_SQL}) WHERE open > 0 AND high > 0 AND low > 0 AND "close" > 0""")
def clean_bars_aggressive(spark, d):
    return Q.clean(broken_bars(spark, d), "ingest", aggressive=True)


@query(f"WITH {BROKEN} " + union_sql(BAR_VALUES, """SELECT symbol, "interval", '{c}' AS column_name, count(*) FILTER ("{c}" < 1) AS n_below,
  count(*) FILTER ("{c}" > 50) AS n_above, count(*) FILTER ("{c}" IS NULL) AS n_missing FROM x GROUP BY symbol, "interval" """))
def numeric_range(spark, d):
    return Q.numeric_range(broken_bars(spark, d), BAR_VALUES, 1, 50)


@query("SELECT count(*) AS n_rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem")
def duplicate_rows(spark, d):
    return Q.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""WITH {BROKEN}, o AS (SELECT *, lag("close") OVER (PARTITION BY symbol ORDER BY ingest) AS pc FROM x),
  r AS (SELECT {K}, count(*) AS n_rows, sum({NULLS})::BIGINT AS n_missing,
    count(*) - count(DISTINCT ("timestamp", open, high, low, "close", volume)) AS n_duplicates,
    count(*) FILTER (abs("close" / nullif(pc, 0) - 1) > 0.1) AS n_large_moves FROM o GROUP BY {K}),
  s AS (SELECT *, (n_missing / (n_rows * 6) * 100 > 5)::BIGINT + (n_duplicates > 0)::BIGINT + (n_large_moves > n_rows * 0.01)::BIGINT AS n_issues FROM r)
  SELECT *, greatest(0, 100 - n_issues * 20)::BIGINT AS quality_score FROM s""")
def quality_report(spark, d):
    return Q.quality_report(broken_bars(spark, d), "ingest", F.floor(F.col("ingest") / 4096))


# --- sources -----------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderstatus = 'F'")
def scan_parquet(spark, d):
    keep = (F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderstatus") == "F")
    return files.load_parquet(spark, f"{d}/orders.parquet", ["o_orderkey", "o_totalprice"], keep)


@query("SELECT * FROM part")
def scan_file(spark, d):
    return files.load_file(spark, f"{d}/part.parquet", "parquet")


@query("""SELECT 'nation' AS source_file, n_nationkey, n_name, n_regionkey, NULL::INTEGER AS r_regionkey, NULL AS r_name FROM nation
  UNION ALL SELECT 'region', NULL, NULL, NULL, r_regionkey, r_name FROM region""")
def scan_many_files(spark, d):
    return files.load_many(spark, [f"{d}/nation.parquet", f"{d}/region.parquet"])


@query(f"""WITH {BARS} SELECT * FROM bars WHERE symbol IN ('click', 'view', 'absent') AND "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'""")
def load_symbols(spark, d):
    return files.load_symbols(hourly_bars(spark, d), ["click", "view", "absent"], "2024-01-05", "2024-01-10")


def landed_klines(spark, d):
    """Candlestick arrays as text, derived from the broken bars; one hour has an unreadable price."""
    b = broken_bars(spark, d)
    price = F.when(F.hour("timestamp") == 11, F.lit("n/a")).otherwise(F.col("high").cast("string"))
    millis = F.when(F.hour("timestamp") == 13, F.lit(0)).otherwise(F.unix_millis("timestamp")).cast("string")
    tail = [F.lit("0")] * 5
    cells = [millis, F.col("open").cast("string"), price, F.col("low").cast("string"), F.col("close").cast("string"),
             F.col("volume").cast("string"), *tail]
    short = F.slice(F.array(*cells), 1, 10)
    cells = F.when(F.hour("timestamp") == 15, short).otherwise(F.array(*cells))
    return b.select("symbol", "interval", F.col("timestamp").alias("true_time"), "ingest", F.to_json(cells).alias("value"))


LANDED = BROKEN + """, k AS (SELECT symbol, "interval", "timestamp" AS true_time, ingest, hour("timestamp") = 15 AS short,
  CASE WHEN hour("timestamp") = 13 THEN TIMESTAMP '1970-01-01' ELSE "timestamp" END AS "timestamp",
  open, CASE WHEN hour("timestamp") <> 11 THEN high END AS high, low, "close", volume FROM x)"""


@query(f"""WITH {LANDED} SELECT {KEY_SQL}, open, high, low, "close", volume FROM k""")
def decode_klines(spark, d):
    return klines.decode(landed_klines(spark, d))


@query(f"""WITH {LANDED}, r AS (SELECT *, concat_ws(',', CASE WHEN short THEN 'format' END,
  CASE WHEN NOT short AND (open IS NULL OR high IS NULL OR low IS NULL OR "close" IS NULL OR volume IS NULL) THEN 'number' END,
  CASE WHEN epoch_ms("timestamp") <= 0 THEN 'timestamp' END, CASE WHEN open < low OR open > high THEN 'open_range' END,
  CASE WHEN "close" < low OR "close" > high THEN 'close_range' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
  CASE WHEN least(open, high, low, "close") <= 0 THEN 'non_positive_price' END) AS broken FROM k)
  SELECT symbol, "interval", true_time, ingest, broken FROM r""")
def validate_klines(spark, d):
    out = klines.validate(landed_klines(spark, d))
    return out.select("symbol", "interval", "true_time", "ingest", F.array_join("broken", ",").alias("broken"))


@query()
def dataset_hash(spark, d):
    return datasets.content_hash(table(spark, d, "lineitem"))
