"""A/B tests: assignment, metrics per variant, significance, winner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.pvalues import t_p
from tidemark.plans.quantiles import exact_percentiles, percentile_columns

# Hash range, smallest group for a test, level.
HASH_DIGITS = 8
HASH_MAX = 0xFFFFFFFF
MIN_GROUP = 30
SIGNIFICANCE = 0.05


def unit_hash(key: Column) -> Column:
    """A stable number in [0, 1] from the first hex digits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, HASH_DIGITS), 16, 10).cast("long") / HASH_MAX


def normalise_weights(variants: DataFrame) -> DataFrame:
    """Weights of each test scaled to sum 1, with cumulative bounds in order ``ord``."""
    test = Window.partitionBy("test")
    share = F.col("weight") / F.sum("weight").over(test)
    upto = F.sum("share").over(test.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return variants.withColumn("share", share).withColumn("upper", upto)


def assign(df: DataFrame, user: Column, test: str, variants: Sequence[tuple[str, float]]) -> DataFrame:
    """Sticky assignment: the first variant whose cumulative weight reaches the user's hash."""
    total = sum(w for _, w in variants)
    value = unit_hash(F.concat(F.lit(f"{test}:"), user.cast("string")))
    upper, choice = 0.0, None
    for name, weight in variants[:-1]:
        upper += weight / total
        choice = (F.when if choice is None else choice.when)(value <= upper, name)
    last = variants[-1][0]
    return df.withColumn("variant", F.lit(last) if choice is None else choice.otherwise(last))


def split_traffic(df: DataFrame, request: Column, share: float, a: str = "a", b: str = "b") -> DataFrame:
    """Two-way split by a stable hash of the request id."""
    slot = F.conv(F.substring(F.md5(request.cast("string")), 1, HASH_DIGITS), 16, 10).cast("long") % 100
    return df.withColumn("model", F.when(slot < share * 100, a).otherwise(b))


def variant_metrics(exposures: DataFrame) -> DataFrame:
    """Mean latency, accuracy over rows with an outcome, and mean impact per variant."""
    hit = F.when(F.col("actual").isNotNull(), (F.col("prediction") == F.col("actual")).cast("double"))
    return exposures.groupBy("variant").agg(
        F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms"), F.avg(hit).alias("accuracy"),
        F.avg("impact_score").alias("business_impact"),
    )


def significance(exposures: DataFrame, metric: str, baseline: str) -> DataFrame:
    """Equal-variance t-test of every variant against the baseline, whose p is 1."""
    groups = exposures.groupBy("variant").agg(
        F.count(metric).alias("n"), F.avg(metric).alias("mean"), F.var_samp(metric).alias("var")
    )
    base = groups.where(F.col("variant") == baseline).select(F.struct("n", "mean", "var")).scalar()
    framed = groups.withColumn("_b", base)
    n0, n1 = F.col("_b.n"), F.col("n")
    df = (n0 + n1 - 2).cast("double")
    pooled = ((n0 - 1) * F.col("_b.var") + (n1 - 1) * F.col("var")) / df
    t = F.try_divide(F.col("_b.mean") - F.col("mean"), F.sqrt(pooled * (1 / n0 + 1 / n1)))
    enough = (F.least(n0, n1) >= MIN_GROUP) & (F.col("variant") != baseline)
    tested = framed.select("variant", "n", "mean", F.when(enough, t).alias("t_statistic"), F.when(enough, df).alias("df"))
    p = F.when(F.col("variant") == baseline, 1.0).otherwise(t_p("t_statistic", "df"))
    return tested.withColumn("p_value", p)


def winner(tested: DataFrame, higher_is_better: bool = True, level: float = SIGNIFICANCE) -> DataFrame:
    """The best variant of a significance table, if it differs from the baseline significantly."""
    rank = F.col("mean") if higher_is_better else -F.col("mean")
    best = tested.agg(F.max_by("variant", rank).alias("best"), F.max_by("p_value", rank).alias("p_value"))
    sure = F.coalesce(F.col("p_value") < level, F.lit(False))
    return best.select(
        "best", "p_value", F.when(sure, F.col("best")).alias("winner"), F.when(sure, 1 - F.col("p_value")).alias("confidence")
    )


def readiness(exposures: DataFrame, variants: DataFrame, minimum: int) -> DataFrame:
    counts = exposures.groupBy("variant").agg(F.count("*").alias("n"))
    joined = variants.join(counts, "variant", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.agg(F.min("n").alias("smallest"), F.bool_and(F.col("n") >= minimum).alias("ready"))


def model_latency(exposures: DataFrame) -> DataFrame:
    """Count, mean and 95th percentile of the non-zero latencies of each model."""
    used = exposures.select("model", F.when(F.col("latency_ms") != 0, F.col("latency_ms")).alias("latency_ms"))
    out = used.groupBy("model").agg(F.count("*").alias("n"), F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"))
    p95 = percentile_columns(exact_percentiles(used, ["latency_ms"], [0.95], ["model"]), ["model"], {("latency_ms", 0.95): "p95_latency_ms"})
    return out.join(p95, "model", "left").withColumn("p95_latency_ms", F.coalesce("p95_latency_ms", F.lit(0.0)))
