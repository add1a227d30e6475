"""Checks, scores and repairs of bar tables. Every check reads the table once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import previous
from tidemark.plans.blocks import with_rows
from tidemark.schemas import BAR_VALUES, KEYS, PRICES

# Severity limits, score deductions and the report thresholds.
CRITICAL_MISSING_PERCENT = 10
MAX_DEDUCTION = 20
DEDUCTION_FACTORS = {"critical": 2.0, "high": 1.5, "medium": 1.0}
MAX_AGE_HOURS = 24
REPORT_MISSING_PERCENT = 5
REPORT_MOVE = 0.1
REPORT_MOVE_SHARE = 0.01
REPORT_DEDUCTION = 20


def breaks_order() -> Column:
    """Low above, or high below, another price."""
    low, high = F.col("low"), F.col("high")
    return (
        (low > F.col("open")) | (low > high) | (low > F.col("close")) | (high < F.col("open")) | (high < F.col("close"))
    )


def long_form(df: DataFrame, keys: Sequence[str], entries: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn one wide row per key into one row per entry."""
    structs = [F.struct(*[c.alias(n) for n, c in e.items()]) for e in entries]
    return df.select(*keys, F.explode(F.array(*structs)).alias("_e")).select(*keys, "_e.*")


def completeness(df: DataFrame, columns: Sequence[str] = BAR_VALUES, keys: Sequence[str] = KEYS) -> DataFrame:
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(f"_{c}") for c in columns]
    )
    out = long_form(counts, [*keys, "n_rows"], [{"column_name": F.lit(c), "affected": F.col(f"_{c}")} for c in columns])
    percent = F.col("affected") / F.col("n_rows") * 100
    severity = F.when(percent > CRITICAL_MISSING_PERCENT, "critical").otherwise("medium")
    return out.where("affected > 0").select(
        *keys, F.lit("completeness").alias("check_type"), severity.alias("severity"), "column_name", "affected", "n_rows"
    )


def consistency(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.count_if(breaks_order()).alias("affected"))
    return counts.where("affected > 0").select(
        *keys, F.lit("consistency").alias("check_type"), F.lit("high").alias("severity"),
        F.lit("open,high,low,close").alias("column_name"), "affected", "n_rows",
    )


def validity(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), *[F.count_if(F.col(c) <= 0).alias(f"_{c}") for c in PRICES]
    )
    out = long_form(counts, [*keys, "n_rows"], [{"column_name": F.lit(c), "affected": F.col(f"_{c}")} for c in PRICES])
    return out.where("affected > 0").select(
        *keys, F.lit("validity").alias("check_type"), F.lit("critical").alias("severity"), "column_name", "affected", "n_rows"
    )


def age_hours(as_of: str | Column) -> Column:
    stamp = F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
    return (F.unix_micros(stamp) - F.unix_micros(F.max("timestamp"))) / 3.6e9


def timeliness(df: DataFrame, as_of: str, max_age: float = MAX_AGE_HOURS, keys: Sequence[str] = KEYS) -> DataFrame:
    ages = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), age_hours(as_of).alias("_age"))
    return ages.where(F.col("_age") > max_age).select(
        *keys, F.lit("timeliness").alias("check_type"), F.lit("medium").alias("severity"),
        F.lit("timestamp").alias("column_name"), F.col("n_rows").alias("affected"), "n_rows",
    )


def issues(df: DataFrame, as_of: str, columns: Sequence[str] = BAR_VALUES, keys: Sequence[str] = KEYS) -> DataFrame:
    """All findings of the four checks from a single pass over the table."""
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in columns],
        F.count_if(breaks_order()).alias("_order"),
        *[F.count_if(F.col(c) <= 0).alias(f"_low_{c}") for c in PRICES],
        age_hours(as_of).alias("_age"),
    )
    n = F.col("n_rows")
    missing_severity = lambda c: F.when(F.col(f"_null_{c}") / n * 100 > CRITICAL_MISSING_PERCENT, "critical").otherwise("medium")
    entry = lambda check, severity, name, affected: {
        "check_type": F.lit(check), "severity": severity, "column_name": F.lit(name), "affected": affected
    }
    entries = [
        *[entry("completeness", missing_severity(c), c, F.col(f"_null_{c}")) for c in columns],
        entry("consistency", F.lit("high"), "open,high,low,close", F.col("_order")),
        *[entry("validity", F.lit("critical"), c, F.col(f"_low_{c}")) for c in PRICES],
        entry("timeliness", F.lit("medium"), "timestamp", F.when(F.col("_age") > MAX_AGE_HOURS, n).otherwise(F.lit(0).cast("long"))),
    ]
    return long_form(counts, [*keys, "n_rows"], entries).select(
        *keys, "check_type", "severity", "column_name", "affected", "n_rows"
    )


def scores(found: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Score per dimension from the findings, including those with nothing affected."""
    factor = F.create_map(*[F.lit(x) for pair in DEDUCTION_FACTORS.items() for x in pair])
    deduction = F.least(F.lit(float(MAX_DEDUCTION)), F.col("affected") / F.col("n_rows") * 100) * factor[F.col("severity")]
    part = lambda check: F.greatest(
        F.lit(0.0), 100 - F.sum(F.when(F.col("check_type") == check, deduction).otherwise(0.0))
    )
    checks = ["completeness", "consistency", "validity", "timeliness"]
    out = found.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), *[part(c).alias(f"{c}_score") for c in checks])
    overall = sum((F.col(f"{c}_score") for c in checks), F.lit(0.0)) / 4
    return out.withColumn("overall_score", overall)


def assess(df: DataFrame, as_of: str, keys: Sequence[str] = KEYS) -> DataFrame:
    found = issues(df, as_of, keys=keys)
    counts = found.groupBy(*keys).agg(F.count_if(F.col("affected") > 0).alias("n_issues"))
    return scores(found, keys).join(counts, list(keys))


def table_validity(df: DataFrame, ingest: str) -> DataFrame:
    """Counts of every rule a bar table has to meet, per series."""
    missing = [c for c in ["timestamp", *BAR_VALUES] if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    bad_price = breaks_order() | F.greatest(*[(F.col(c) <= 0).cast("int") for c in PRICES]).cast("boolean")
    nulls = sum((F.col(c).isNull().cast("int") for c in BAR_VALUES), F.lit(0))
    per_stamp = df.groupBy(*KEYS, "timestamp").agg(
        F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"), F.count_if(bad_price).alias("_bad")
    )
    counts = per_stamp.groupBy(*KEYS).agg(
        F.sum("_n").alias("n_rows"), F.sum("_nulls").alias("n_null_values"), F.sum("_bad").alias("n_bad_prices"),
        F.sum(F.col("_n") - 1).alias("n_repeated_timestamps"),
    )
    base = with_rows(df.select(*KEYS, "timestamp", ingest), [{"_p": previous("timestamp")}], back=1,
                     number={"order": [ingest], "bucket": F.floor(F.col(ingest) / 4096)})
    order = base.groupBy(*KEYS).agg(F.count_if(F.col("timestamp") < F.col("_p")).alias("n_out_of_order"))
    return counts.join(order, KEYS)


def indicator_input(df: DataFrame) -> DataFrame:
    """Input rules of the indicators: no missing value and five price inequalities, per series."""
    pairs = [("high", "low"), ("high", "open"), ("high", "close"), ("open", "low"), ("close", "low")]
    return df.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in BAR_VALUES],
        *[F.count_if(F.col(a) < F.col(b)).alias(f"{a}_below_{b}") for a, b in pairs],
    )


def clean(df: DataFrame, ingest: str, aggressive: bool = False) -> DataFrame:
    """First row of each timestamp, repaired high and low; ``aggressive`` drops prices of 0 or less."""
    first = Window.partitionBy(*KEYS, "timestamp").orderBy(ingest)
    out = df.withColumn("_i", F.row_number().over(first)).where("_i = 1").drop("_i")
    out = out.withColumns(
        {"high": F.greatest("high", "open", "close"), "low": F.least("low", "open", "close")}
    )
    if aggressive:
        for c in PRICES:
            out = out.where(F.col(c) > 0)
    return out


def check_schema(df: DataFrame, required: Sequence[str], types: Mapping[str, str] | None = None) -> None:
    """Raise if a column is missing or its type does not start with the given prefix."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    have = dict(df.dtypes)
    for name, prefix in (types or {}).items():
        if name in have and not have[name].startswith(prefix):
            raise ValueError(f"column {name} has type {have[name]}, expected {prefix}")


def numeric_range(df: DataFrame, columns: Sequence[str], low: float, high: float, keys: Sequence[str] = KEYS) -> DataFrame:
    counts = df.groupBy(*keys).agg(
        *[F.count_if(F.col(c) < low).alias(f"_b_{c}") for c in columns],
        *[F.count_if(F.col(c) > high).alias(f"_a_{c}") for c in columns],
        *[F.count_if(F.col(c).isNull()).alias(f"_n_{c}") for c in columns],
    )
    entries = [
        {"column_name": F.lit(c), "n_below": F.col(f"_b_{c}"), "n_above": F.col(f"_a_{c}"), "n_missing": F.col(f"_n_{c}")}
        for c in columns
    ]
    return long_form(counts, keys, entries)


def duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each combination."""
    per_key = df.groupBy(*(subset or df.columns)).agg(F.count("*").alias("_n"))
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n_duplicates")
    )


def quality_report(df: DataFrame, ingest: str, bucket: Column) -> DataFrame:
    """Missing share, duplicates and large moves per series, with a simple score."""
    columns = ["timestamp", *BAR_VALUES]
    nulls = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    base = with_rows(df, [{"_pc": previous("close")}], back=1, number={"order": [ingest], "bucket": bucket})
    move = F.abs(F.try_divide(F.col("close"), F.col("_pc")) - 1)
    per_row = base.groupBy(*KEYS, *columns).agg(
        F.count("*").alias("_n"), F.sum(nulls).alias("_nulls"), F.count_if(move > REPORT_MOVE).alias("_moves")
    )
    out = per_row.groupBy(*KEYS).agg(
        F.sum("_n").alias("n_rows"), F.sum("_nulls").alias("n_missing"),
        F.sum(F.col("_n") - 1).alias("n_duplicates"), F.sum("_moves").alias("n_large_moves"),
    )
    missing = F.col("n_missing") / (F.col("n_rows") * len(columns)) * 100 > REPORT_MISSING_PERCENT
    moves = F.col("n_large_moves") > F.col("n_rows") * REPORT_MOVE_SHARE
    found = missing.cast("int") + (F.col("n_duplicates") > 0).cast("int") + moves.cast("int")
    return out.withColumn("n_issues", found.cast("long")).withColumn(
        "quality_score", F.greatest(F.lit(0), 100 - F.col("n_issues") * REPORT_DEDUCTION)
    )
