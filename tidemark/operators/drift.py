"""Drift of features, predictions and feature importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from tidemark.functions.pvalues import chi2_p, ks_p
from tidemark.functions.stats import correlation
from tidemark.operators.quality import long_form
from tidemark.plans.quantiles import exact_percentiles
from tidemark.plans.ranks import cumulative

# Limits of the tests and windows.
SIGNIFICANCE = 0.05
FEW_VALUES = 10
SHARE_FLOOR = 1e-6
PERFORMANCE_WINDOW = 100
PERFORMANCE_CHANGE = 0.05
LATENCY_WINDOW = 50
LATENCY_MINIMUM = 10
LATENCY_RATIO = 1.5
IMPORTANCE_CHANGE = 0.1
TOP_FEATURES = 10
TOP_OVERLAP = 0.8
SAMPLE_SIZE = 1000


def feature_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``categorical`` for text or fewer than ten distinct values, else ``continuous``.

    A sketch settles clear cases; only columns it puts near the limit are
    counted exactly, and those have few distinct values to shuffle.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    text = [c for c in columns if isinstance(kinds[c], StringType)]
    numbers = [c for c in columns if isinstance(kinds[c], NumericType)]
    parts = []
    if text:
        wide = df.agg(*[F.count(c).alias(c) for c in text])
        parts.append(long_form(wide, [], [{"feature": F.lit(c), "feature_type": F.lit("categorical")} for c in text]))
    if numbers:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in numbers])
        rough = wide.select(F.struct("*")).scalar()
        near = df.select(F.explode(F.array_compact(F.array(*[
            F.when((rough[c] <= 3 * FEW_VALUES) & F.col(c).isNotNull(), F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")))
            for c in numbers
        ]))).alias("x")).select("x.*")
        exact = near.distinct().groupBy("feature").agg(F.count("*").alias("n"))
        everything = long_form(wide, [], [{"feature": F.lit(c), "rough": F.col(c)} for c in numbers])
        joined = everything.join(exact, "feature", "left")
        few = (F.col("rough") <= 3 * FEW_VALUES) & (F.coalesce("n", F.lit(0)) < FEW_VALUES)
        parts.append(joined.select("feature", F.when(few, "categorical").otherwise("continuous").alias("feature_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reference_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, range and quartiles of continuous features."""
    stats = {"n": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*[f(F.col(c).cast("double")).alias(f"{s}__{c}") for c in columns for s, f in stats.items()])
    long = long_form(wide, [], [{"feature": F.lit(c), **{s: F.col(f"{s}__{c}") for s in stats}} for c in columns])
    quartiles = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
    wide_q = quartiles.groupBy(F.col("column_name").alias("feature")).agg(*[
        F.max(F.when(F.col("p") == p, F.col("value"))).alias(label)
        for p, label in [(0.25, "q25"), (0.5, "q50"), (0.75, "q75")]
    ])
    return long.join(wide_q, "feature", "left")


def category_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of every value of categorical features."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in columns
    ])).alias("x")).select("x.*").where("category is not null")
    counts = cells.groupBy("feature", "category").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_t"))
    return counts.join(totals, "feature").select("feature", "category", "n", (F.col("n") / F.col("_t")).alias("share"))


def reference_sample(df: DataFrame, column: str, key: Column, size: int = SAMPLE_SIZE) -> DataFrame:
    """A repeatable sample: the rows with the smallest hash of their key."""
    rows = df.where(F.col(column).isNotNull()).select(F.md5(key.cast("string")).alias("h"), F.col(column).alias("value"))
    return rows.orderBy("h").limit(size)


def _values(df: DataFrame, columns: Sequence[str], side: int) -> DataFrame:
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("x")).select("x.*").where("value is not null")
    return cells.groupBy("feature", "value").agg(F.count("*").alias("n")).withColumn("side", F.lit(side))


def continuous_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], level: float = SIGNIFICANCE) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test of every column over all rows."""
    both = _values(reference, columns, 0).unionByName(_values(current, columns, 1))
    counts = both.groupBy("feature", "value").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("n0"),
        F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n1"),
    )
    summed = cumulative(counts, ["feature"], "value", {"c0": F.col("n0"), "c1": F.col("n1")})
    totals = counts.groupBy("feature").agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"))
    gap = F.abs(F.try_divide(F.col("c0"), F.col("t0")) - F.try_divide(F.col("c1"), F.col("t1")))
    tested = summed.join(totals, "feature").groupBy("feature", "t0", "t1").agg(F.max(gap).alias("statistic"))
    moments = lambda df, tag: long_form(
        df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_samp(c).alias(f"s_{c}") for c in columns]),
        [], [{"feature": F.lit(c), f"m{tag}": F.col(f"m_{c}"), f"s{tag}": F.col(f"s_{c}")} for c in columns],
    )
    out = tested.join(moments(reference, 0), "feature").join(moments(current, 1), "feature")
    p = ks_p(F.col("statistic"), F.col("t0"), F.col("t1"))
    return out.where("t0 > 0 and t1 > 0").select(
        "feature", F.lit("kolmogorov_smirnov").alias("test"), "statistic", p.alias("p_value"), (p < level).alias("drift_detected"),
        (F.col("m1") - F.col("m0")).alias("mean_shift"), (F.col("s1") - F.col("s0")).alias("std_shift"),
    )


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str], level: float = SIGNIFICANCE) -> DataFrame:
    """Chi-squared test of current counts against reference shares; new categories are counted and listed.

    The list is as long as there are new categories; :func:`new_categories` gives them as rows.
    """
    old = category_shares(reference, columns).select("feature", "category", F.col("share").alias("old"))
    new = category_shares(current, columns).select("feature", "category", F.col("n").alias("new"))
    totals = new.groupBy("feature").agg(F.sum("new").alias("t"))
    both = old.join(new, ["feature", "category"], "full").join(totals, "feature")
    expected = F.greatest(F.coalesce("old", F.lit(0.0)) * F.col("t"), F.lit(SHARE_FLOOR))
    observed = F.greatest(F.coalesce("new", F.lit(0)).cast("double"), F.lit(SHARE_FLOOR))
    scored = both.groupBy("feature").agg(
        F.sum((observed - expected) * (observed - expected) / expected).alias("statistic"),
        (F.count("*") - 1).alias("df"),
        F.count_if(F.col("old").isNull()).alias("n_new_categories"),
        F.sort_array(F.collect_list(F.when(F.col("old").isNull(), F.col("category")))).alias("new_categories"),
    )
    p = F.when(F.col("df") > 0, chi2_p("statistic", F.col("df").cast("double"))).otherwise(1.0)
    out = scored.withColumn("p_value", p)
    return out.select(
        "feature", F.lit("chi_square").alias("test"), "statistic", "p_value",
        (F.col("p_value") < level).alias("drift_detected"), "n_new_categories", "new_categories",
    )


def new_categories(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, category, n, share`` of the current categories that the reference does not have."""
    return category_shares(current, columns).join(category_shares(reference, columns), ["feature", "category"], "left_anti")


def drift_results(reference: DataFrame, current: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    parts = []
    if continuous:
        parts.append(continuous_drift(reference, current, continuous).select("feature", "test", "statistic", "p_value", "drift_detected"))
    if categorical:
        parts.append(categorical_drift(reference, current, categorical).select("feature", "test", "statistic", "p_value", "drift_detected"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rollup(results: DataFrame) -> DataFrame:
    """Features tested and drifted, and their ratio."""
    return results.agg(
        F.count("*").alias("features_tested"), F.count_if("drift_detected").alias("features_with_drift"),
        F.coalesce(F.try_divide(F.count_if("drift_detected"), F.count("*")), F.lit(0.0)).alias("drift_ratio"),
    ).withColumn("drift_detected", F.col("features_with_drift") > 0)


def history_summary(history: DataFrame, as_of: str, hours: float = 24, top: int = 10) -> DataFrame:
    """Drift rate of each feature in the last hours, the ``top`` most frequent first."""
    cut = F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600))
    recent = history.where(F.col("timestamp") >= cut)
    rates = recent.groupBy("feature").agg(
        F.count("*").alias("n_tests"), F.count_if("drift_detected").alias("n_drift"),
        (F.count_if("drift_detected") / F.count("*")).alias("drift_rate"),
    )
    return rates.orderBy(F.col("drift_rate").desc(), "feature").limit(top)


def last_rows(df: DataFrame, n: int, order: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The newest n rows of each key with their position ``back`` (1 = newest).

    Spark limits each group before the shuffle, so a large group costs n rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def performance_drift(
    history: DataFrame, baseline: DataFrame, window: int = PERFORMANCE_WINDOW, limit: float = PERFORMANCE_CHANGE
) -> DataFrame:
    """Mean of the newest measurements of each metric against its baseline."""
    recent = last_rows(history, window, [F.col("timestamp").desc()], ["metric"])
    means = recent.groupBy("metric").agg(F.count("*").alias("_n"), F.avg("value").alias("current_value"))
    out = means.where(F.col("_n") >= window).join(baseline, "metric")
    change = F.try_divide(F.col("current_value") - F.col("baseline_value"), F.col("baseline_value"))
    return out.select(
        "metric", "baseline_value", "current_value", change.alias("relative_change"),
        F.coalesce(F.abs(change) > limit, F.lit(False)).alias("drift_detected"),
    )


def overall_status(results: DataFrame, performance: DataFrame) -> DataFrame:
    """One row: critical if both kinds drift, warning if one does, else healthy."""
    flag = lambda df: df.agg(F.coalesce(F.bool_or("drift_detected"), F.lit(False)).alias("d"))
    one = flag(results).withColumnRenamed("d", "statistical_drift")
    both = one.withColumn("performance_drift", flag(performance).scalar())
    a, b = F.col("statistical_drift"), F.col("performance_drift")
    return both.withColumn("status", F.when(a & b, "critical").when(a | b, "warning").otherwise("healthy"))


def latency_summary(predictions: DataFrame, window: int = 100) -> DataFrame:
    """Average, range, 95th percentile and rate over the newest predictions, and the total count."""
    newest = predictions.select("timestamp", "latency").orderBy(F.col("timestamp").desc()).limit(window)
    used = F.when(F.col("latency") != 0, F.col("latency"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    seconds = (micros(F.max("timestamp")) - micros(F.min("timestamp"))) / 1e6
    out = newest.agg(
        F.avg(used).alias("avg_latency"), F.max(used).alias("max_latency"), F.min(used).alias("min_latency"),
        F.percentile(used, 0.95).alias("p95_latency"),
        (F.count("*") / F.greatest(F.lit(1.0), seconds)).alias("predictions_per_second"),
    )
    return out.withColumn("total_predictions", predictions.agg(F.count("*")).scalar())


def latency_regression(predictions: DataFrame) -> DataFrame:
    """Newest 50 predictions against the 50 before them."""
    newest = predictions.select("timestamp", "latency").orderBy(F.col("timestamp").desc()).limit(2 * LATENCY_WINDOW)
    placed = newest.withColumn("back", F.row_number().over(Window.orderBy(F.col("timestamp").desc())))
    used, late = F.when(F.col("latency") != 0, F.col("latency")), F.col("back") <= LATENCY_WINDOW
    out = placed.agg(
        F.count("*").alias("n"), F.count(F.when(late, used)).alias("n_recent"), F.count(F.when(~late, used)).alias("n_older"),
        F.avg(F.when(late, used)).alias("recent_avg"), F.avg(F.when(~late, used)).alias("older_avg"),
    )
    enough = (F.col("n") >= 2 * LATENCY_WINDOW) & (F.least("n_recent", "n_older") >= LATENCY_MINIMUM)
    slow = enough & (F.col("recent_avg") > F.col("older_avg") * LATENCY_RATIO)
    return out.select("recent_avg", "older_avg", F.coalesce(slow, F.lit(False)).alias("degraded"))


def importance_changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Change of each feature's importance, and whether it is in either top ten."""
    rank = lambda df, tag: df.select(
        "feature", F.col("importance").alias(tag),
        (F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")) <= TOP_FEATURES).alias(f"{tag}_top"),
    )
    both = rank(current, "current").join(rank(previous, "previous"), "feature", "full")
    now, old = F.coalesce("current", F.lit(0.0)), F.coalesce("previous", F.lit(0.0))
    change = F.when(old > 0, F.abs(now - old) / old)
    return both.select(
        "feature", now.alias("current"), old.alias("previous"), change.alias("change_ratio"),
        F.coalesce((change > IMPORTANCE_CHANGE) & F.col("current").isNotNull(), F.lit(False)).alias("changed"),
        F.coalesce("current_top", F.lit(False)).alias("in_current_top"), F.coalesce("previous_top", F.lit(False)).alias("in_previous_top"),
    )


def importance_drift(current: DataFrame, previous: DataFrame) -> DataFrame:
    rows = importance_changes(current, previous)
    kept = F.count_if(F.col("in_current_top") & F.col("in_previous_top")) / F.count_if("in_current_top")
    out = rows.agg(F.count_if("changed").alias("n_changed"), kept.alias("top_overlap"))
    return out.withColumn("drift_detected", (F.col("n_changed") > 0) | (F.col("top_overlap") < TOP_OVERLAP))


def compare_importance(importance: DataFrame, models: Sequence[str]) -> DataFrame:
    """One column per model (0 where missing), with mean and deviation per feature."""
    wide = importance.groupBy("feature").agg(*[
        F.coalesce(F.max(F.when(F.col("model") == m, F.col("importance"))), F.lit(0.0)).alias(m) for m in models
    ])
    mean = sum((F.col(m) for m in models), F.lit(0.0)) / len(models)
    squares = sum(((F.col(m) - F.col("mean")) * (F.col(m) - F.col("mean")) for m in models), F.lit(0.0))
    out = wide.withColumn("mean", mean)
    return out.withColumn("std", F.sqrt(squares / (len(models) - 1)) if len(models) > 1 else F.lit(None).cast("double"))


def importance_correlation(importance: DataFrame, models: Sequence[str]) -> DataFrame:
    wide = compare_importance(importance, models)
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1:]]
    agg = wide.agg(*[correlation(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return long_form(agg, [], [
        {"model_a": F.lit(a), "model_b": F.lit(b), "correlation": F.col(f"{a}__{b}")} for a, b in pairs
    ])


