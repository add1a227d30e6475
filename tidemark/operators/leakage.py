"""Leakage screening of feature tables: one row per finding, per series and feature."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemark.functions.stats import correlation
from tidemark.operators import indicators as I
from tidemark.operators.quality import long_form
from tidemark.plans.blocks import number_rows, plain, running, with_rows
from tidemark.schemas import KEYS
from tidemark.session import cut_lineage

# Name rules and limits.
ROLLING_WORDS = ["rolling", "ma", "sma", "ema", "mean", "std", "min", "max"]
LAG_PATTERN = r"(?:lag|shift|prev)_?(\d+)"
SUSPICIOUS_WORDS = ["future", "next", "forward", "ahead", "tomorrow", "target", "label", "actual", "real"]
TARGET_PREFIXES = ["target_", "label_", "y_", "actual_", "real_", "true_"]
AUTOCORRELATION_LIMIT = 0.99
TARGET_CORRELATION_LIMIT = 0.8
TREND_CORRELATION_LIMIT = 0.999
MIN_ROWS = 10
ADVICE = {
    "forward_looking_pattern": "Check that steady or self-similar features use past rows only.",
    "high_future_correlation": "Remove features that follow the target of a later row, or shift them back.",
    "incorrect_lag_calculation": "Recompute lags so that the first rows of a series are missing.",
    "suspicious_naming": "Look at features whose names speak of the future.",
    "suspicious_rolling_calculation": "Recompute rolling features with a full window before the first value.",
    "target_derived_feature": "Remove features made from the target before training.",
    "unrealistic_predictive_power": "Look at constant or steadily rising features.",
}


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and not f.name.startswith("_")]


def rolling_named(columns: Sequence[str]) -> list[str]:
    """Columns with one of the words as a whole part of the name."""
    return [c for c in columns if set(re.split(r"[^a-z]+", c.lower())) & set(ROLLING_WORDS)]


def lag_named(columns: Sequence[str]) -> dict[str, int]:
    found = {c: re.search(LAG_PATTERN, c.lower()) for c in columns}
    return {c: int(m.group(1)) for c, m in found.items() if m and int(m.group(1)) > 0}


def _per_feature(df: DataFrame, columns: Sequence[str], stats: dict[str, callable]) -> DataFrame:
    """One aggregate per series over all columns, then one row per feature."""
    wide = df.groupBy(*KEYS).agg(
        F.count("*").alias("n_rows"), *[f(c).alias(f"{s}__{c}") for c in columns for s, f in stats.items()]
    )
    entries = [{"feature": F.lit(c), **{s: F.col(f"{s}__{c}") for s in stats}} for c in columns]
    return long_form(wide, [*KEYS, "n_rows"], entries)


def forward_looking(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """Constant non-zero step, or lag-1 autocorrelation above 0.99."""
    columns = columns or numeric_columns(df)
    base = with_rows(df, [{f"_p_{c}": I.previous(c) for c in columns}], back=1, **kw)
    stats = {
        "step_std": lambda c: F.stddev_samp(F.col(c) - F.col(f"_p_{c}")),
        "step_mean": lambda c: F.avg(F.col(c) - F.col(f"_p_{c}")),
        "autocorrelation": lambda c: correlation(c, f"_p_{c}"),
    }
    out = _per_feature(base, columns, stats)
    steady = (F.col("step_std") == 0) & (F.col("step_mean") != 0)
    smooth = F.abs("autocorrelation") > AUTOCORRELATION_LIMIT
    flag = (F.col("n_rows") >= MIN_ROWS) & (F.coalesce(steady, F.lit(False)) | F.coalesce(smooth, F.lit(False)))
    return out.withColumn("flagged", flag)


def rolling_without_warm_up(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """Rolling-named columns whose first row is filled, or which are never filled."""
    columns = rolling_named(columns or df.columns)
    base = with_rows(df, [], **kw)
    stats = {
        "first_filled": lambda c: F.coalesce(F.max(F.when(F.col("_rn") == 1, F.col(c).isNotNull())), F.lit(False)),
        "n_filled": lambda c: F.count(c),
    }
    out = _per_feature(base, columns, stats)
    return out.withColumn("flagged", F.col("first_filled") | (F.col("n_filled") == 0))


def unshifted_lags(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """Lag-named columns with a value among their first k rows."""
    lags = lag_named(columns or df.columns)
    base = with_rows(df, [], **kw)
    out = _per_feature(base, list(lags), {
        "n_early": lambda c: F.count_if((F.col("_rn") <= lags[c]) & F.col(c).isNotNull()),
    })
    period = F.create_map(*[F.lit(x) for pair in lags.items() for x in pair]) if lags else F.create_map()
    out = out.withColumn("lag", period[F.col("feature")].cast("long"))
    return out.withColumn("flagged", (F.col("n_rows") > F.col("lag")) & (F.col("n_early") > 0))


def target_correlation(df: DataFrame, target: str, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """Correlation of every feature with the next target value."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    base = with_rows(df, [{"_next": I.following(target)}], ahead=1, **kw)
    out = _per_feature(base, columns, {"correlation": lambda c: correlation(c, "_next")})
    return out.withColumn("flagged", F.coalesce(F.abs("correlation") > TARGET_CORRELATION_LIMIT, F.lit(False)))


def unrealistic(df: DataFrame, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """Constant columns and columns that are a straight line over their filled rows."""
    columns = columns or numeric_columns(df)
    base = with_rows(df, [], **kw)
    base = running(base, {f"_pos_{c}": ("sum", F.col(c).isNotNull().cast("long")) for c in columns})
    stats = {
        "n_filled": lambda c: F.count(c),
        "constant": lambda c: F.coalesce(F.min(c) == F.max(c), F.lit(False)),
        "trend": lambda c: correlation(f"_pos_{c}", c),
    }
    out = _per_feature(base, columns, stats)
    straight = (F.col("n_filled") > 2) & (F.abs("trend") > TREND_CORRELATION_LIMIT)
    return out.withColumn(
        "flagged", (F.col("n_rows") >= MIN_ROWS) & (F.col("constant") | F.coalesce(straight, F.lit(False)))
    )


def naming(spark: SparkSession, columns: Sequence[str]) -> DataFrame:
    """Findings that follow from the column names alone."""
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    lower = F.lower("feature")
    first = lambda marks: F.get(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(lower, m)), F.lit(0))
    rules = [("suspicious_naming", "warning", SUSPICIOUS_WORDS), ("target_derived_feature", "critical", TARGET_PREFIXES)]
    parts = F.array(*[F.struct(F.lit(v).alias("violation_type"), F.lit(s).alias("severity"), first(m).alias("mark")) for v, s, m in rules])
    return names.select("feature", F.explode(parts).alias("x")).select("feature", "x.*").where("mark is not null")


def scan(df: DataFrame, target: str | None = None, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    """All findings of all checks. Each check reads the table, so it is numbered and written once."""
    columns = list(columns or numeric_columns(df))
    df = cut_lineage(number_rows(df))
    checks = [
        (forward_looking(df, columns, **kw), "forward_looking_pattern", "warning"),
        (unrealistic(df, columns, **kw), "unrealistic_predictive_power", "warning"),
    ]
    if rolling_named(columns):
        checks.append((rolling_without_warm_up(df, columns, **kw), "suspicious_rolling_calculation", "warning"))
    if lag_named(columns):
        checks.append((unshifted_lags(df, columns, **kw), "incorrect_lag_calculation", "warning"))
    if target:
        checks.append((target_correlation(df, target, columns, **kw), "high_future_correlation", "critical"))
    out = None
    for found, kind, severity in checks:
        part = found.where("flagged").select(*KEYS, "feature", F.lit(kind).alias("violation_type"), F.lit(severity).alias("severity"))
        out = part if out is None else out.unionByName(part)
    named = naming(df.sparkSession, columns).select(
        F.lit("*").alias("symbol"), F.lit("*").alias("interval"), "feature", "violation_type", "severity"
    )
    return out.unionByName(named)


def report(findings: DataFrame) -> DataFrame:
    """Counts by severity and kind, with totals."""
    return findings.groupingSets(
        [["severity", "violation_type"], ["severity"], []], "severity", "violation_type"
    ).agg(F.count("*").alias("n_findings"), F.count_distinct("feature").alias("n_features"))


def summary(df: DataFrame, findings: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row about a scanned table: its size and time range, how many features have findings, and what to do.

    ``affected_share`` is the share of the scanned columns with a finding; ``advice`` has one text per kind of finding, the most severe
    kinds first. A table is clean without critical findings.
    """
    columns = list(columns or numeric_columns(df))
    rows = df.agg(F.count("*").alias("n_rows"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"))
    texts = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    advised = F.struct((F.col("severity") != "critical").alias("later"), "violation_type", F.try_element_at(texts, F.col("violation_type")).alias("text"))
    # Kinds of findings are few, so their set is small.
    found = findings.agg(
        F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warnings"),
        F.count_distinct("feature").alias("n_affected"), F.array_sort(F.collect_set(advised)).alias("_advice"),
    )
    both = rows.withColumn("_f", found.select(F.struct("*")).scalar()).select("*", "_f.*").drop("_f")
    return both.select(
        "n_rows", "first_timestamp", "last_timestamp", F.lit(len(columns)).cast("long").alias("n_features"), "n_affected",
        F.try_divide(F.col("n_affected"), F.lit(len(columns))).alias("affected_share"), "n_findings", "n_critical", "n_warnings",
        (F.col("n_critical") == 0).alias("is_clean"), F.transform("_advice", lambda a: a["text"]).alias("advice"),
    )


def clean_features(df: DataFrame, findings: DataFrame, critical: bool = True, warnings: bool = False) -> DataFrame:
    """Drop the columns with findings; the list of names is bounded by the schema."""
    levels = [s for s, on in (("critical", critical), ("warning", warnings)) if on]
    bad = findings.where(F.col("severity").isin(*levels)).select("feature").distinct().collect()
    return df.drop(*[r["feature"] for r in bad])


def base_column(name: str, columns: Sequence[str]) -> str | None:
    """The longest column whose name begins the derived name, else the price a short name stands for."""
    starts = [c for c in columns if c != name and name.lower().startswith(c.lower() + "_")]
    if starts:
        return max(starts, key=len)
    return "close" if "close" in columns else None


def repair(df: DataFrame, **kw) -> DataFrame:
    """Recompute rolling means and lags from the column their names point to."""
    stages: dict[str, Column] = {}
    context = 0
    lags = lag_named(df.columns)
    for c in df.columns:
        base = base_column(c, df.columns)
        if base is None:
            continue
        if c in lags:
            stages[c], size = I.previous(base, lags[c]), lags[c]
        elif set(re.split(r"[^a-z]+", c.lower())) & {"rolling", "ma", "sma", "mean"} and re.search(r"_(\d+)", c):
            size = int(re.search(r"_(\d+)", c).group(1))
            stages[c] = I.sma(base, size)
        else:
            continue
        context = max(context, size)
    if not stages:
        return df
    out = with_rows(df.drop(*stages), [stages], back=context, **kw)
    return plain(out).select(*df.columns)


