"""Metric, alert and log tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from tidemark.operators.quality import long_form
from tidemark.plans.blocks import number_rows, plain, prefix, running, with_rows
from tidemark.plans.blocks import rows as rows_window
from tidemark.plans.quantiles import exact_percentiles, percentile_columns
from tidemark.plans.settle import settle
from tidemark.session import cut_lineage

# Names that are redacted, the mark, and limits.
SENSITIVE_KEYS = [
    "password", "api_key", "secret", "token", "authorization", "jwt", "private_key", "credential", "auth",
]
REDACTED = "***REDACTED***"
COOLDOWN_SECONDS = 300
CRITICAL_FACTOR = 1.5
RECENT_LOGS = 1000
ERROR_SHARE = 0.1
MEMORY_SHARE = 0.9
TOP_PATTERNS = 10
BUCKET_MINUTES = 5


def micros(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


# --- metrics --------------------------------------------------------------------


def summary(metrics: DataFrame, aggregation: str = "avg") -> DataFrame:
    """Average or latest value of every metric."""
    value = F.max_by("value", "timestamp") if aggregation == "latest" else F.avg("value")
    return metrics.groupBy("name").agg(
        value.alias("value"), F.count("*").alias("n"), F.max("timestamp").alias("timestamp"), F.lit(aggregation).alias("aggregation")
    )


def time_series(metrics: DataFrame, minutes: int = BUCKET_MINUTES) -> DataFrame:
    """Averages per time step counted from the first time stamp of each metric."""
    first = metrics.groupBy("name").agg(F.min(micros("timestamp")).alias("_first"))
    width = minutes * 60_000_000
    placed = metrics.join(first, "name").withColumn("_step", F.floor((micros("timestamp") - F.col("_first")) / width))
    return placed.groupBy("name", "_first", "_step").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(
        "name", F.timestamp_micros(F.col("_first") + F.col("_step") * width).alias("timestamp"), "value", "n"
    )


def latest_metrics(metrics: DataFrame, name: str | None = None, limit: int = 100) -> DataFrame:
    chosen = metrics if name is None else metrics.where(F.col("name") == name)
    return chosen.orderBy(F.col("timestamp").desc()).limit(limit)


def format_value(value: Column, kind: str) -> Column:
    """Text of a value as percentage, bytes or number."""
    if kind == "percentage":
        return F.format_string("%.1f%%", value)
    if kind == "bytes":
        return (
            F.when(value >= 1024**3, F.format_string("%.1f GB", value / 1024**3))
            .when(value >= 1024**2, F.format_string("%.1f MB", value / 1024**2))
            .otherwise(F.format_string("%.0f B", value))
        )
    return F.format_string("%.2f", value)


def resource_summary(samples: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = samples.agg(*[
        f(c).alias(f"{s}__{c}") for c in columns
        for s, f in [("avg", F.avg), ("max", F.max), ("min", F.min), ("std", F.stddev_samp)]
    ])
    return long_form(wide, [], [
        {"metric": F.lit(c), **{s: F.col(f"{s}__{c}").cast("double") for s in ("avg", "max", "min", "std")}} for c in columns
    ])


def load_summary(requests: DataFrame, seconds: float) -> DataFrame:
    """Response times of successful requests, their rate, and the share of failed ones."""
    good = requests.where("ok")
    p = percentile_columns(exact_percentiles(good, ["latency"], [0.95, 0.99]), [], {("latency", 0.95): "p95", ("latency", 0.99): "p99"})
    tail = p.select(F.struct("*")).scalar()
    ok = F.when(F.col("ok"), F.col("latency"))
    out = requests.agg(
        F.avg(ok).alias("avg_response"), F.min(ok).alias("min_response"), F.max(ok).alias("max_response"),
        (F.count(ok) / F.lit(seconds)).alias("requests_per_second"), (F.count_if(~F.col("ok")) / F.count("*")).alias("error_rate"),
    )
    return out.withColumn("_p", tail).select("*", F.col("_p.p95").alias("p95_response"), F.col("_p.p99").alias("p99_response")).drop("_p")


def serving_summary(requests: DataFrame) -> DataFrame:
    """Totals over all models; the time is the mean of the models' means."""
    models = requests.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.avg(F.when(F.col("ok"), F.col("latency"))).alias("mean")
    )
    total = F.sum("n")
    return models.agg(
        total.alias("total_requests"), F.sum("ok").alias("successful_requests"), (total - F.sum("ok")).alias("failed_requests"),
        (F.sum("ok") / total * 100).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("mean") > 0, F.col("mean"))), F.lit(0.0)).alias("avg_processing_ms"),
        F.count("*").alias("n_models"),
    )


# --- alerts ---------------------------------------------------------------------


def condition_met(condition: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when(condition == "gt", value > threshold).when(condition == "gte", value >= threshold)
        .when(condition == "lt", value < threshold).when(condition == "lte", value <= threshold).otherwise(F.lit(False))
    )


def evaluate_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose condition holds for the latest value of their metric."""
    latest = metrics.groupBy("name").agg(F.max_by("value", "timestamp").alias("current_value"), F.max("timestamp").alias("timestamp"))
    joined = rules.where("enabled").join(latest, rules["metric"] == latest["name"])
    met = condition_met(F.col("condition"), F.col("current_value"), F.col("threshold"))
    return joined.where(met).select("rule", "metric", "condition", "threshold", "severity", "current_value", "timestamp")


def alert_cycle(
    metrics: DataFrame, rules: DataFrame, cooldown: float = COOLDOWN_SECONDS, bucket_seconds: float = 86400,
    block_rows: int | None = None,
) -> DataFrame:
    """State of every rule after every value of its metric.

    After a trigger the rule rests for the cooldown; then it triggers again,
    resolves if it was active, or stays quiet. Triggers come from
    :func:`triggers`; the other states follow from the last trigger and the row before.
    """
    joined = metrics.join(rules.where("enabled"), metrics["name"] == rules["metric"])
    met = condition_met(F.col("condition"), F.col("value"), F.col("threshold"))
    frame = joined.select("rule", "timestamp", "value", micros("timestamp").alias("_us"), F.coalesce(met, F.lit(False)).alias("_met"))
    keys, rest = ["rule"], int(cooldown * 1_000_000)
    bucket = time_bucket_of("_us", bucket_seconds)
    numbered = cut_lineage(number_rows(frame, keys, order=["_us"], bucket=bucket))
    fired = triggers(numbered.where("_met").select("rule", "_rn", "_us"), rest, bucket_seconds)
    marked = numbered.join(fired.withColumn("_fires", F.lit(True)), ["rule", "_rn"], "left")
    order = rows_window(keys=keys)
    last = {"_before": F.lag("_us").over(order), "_fired_before": F.lag("_fires").over(order)}
    blocks = with_rows(marked, [last], back=1, keys=keys, block_rows=block_rows)
    known = running(blocks, {"_fired": ("max", F.when(F.col("_fires"), F.col("_us")))}, keys)
    rests = lambda us: F.col(us) - F.col("_fired") < rest
    state = (
        F.when(F.col("_fires"), "triggered").when(rests("_us"), "cooldown")
        .when(rests("_before") | F.col("_fired_before"), "resolved").otherwise("quiet")
    )
    return plain(known.withColumn("state", state)).drop("_us", "_met", "_fires", "_fired", *last)


def triggers(hits: DataFrame, rest: int, bucket_seconds: float = 86400) -> DataFrame:
    """``rule, _rn`` of the hits that fire: the first, then always the first one ``rest`` microseconds or more later.

    Every hit points to the hit that would fire after it. Pointers are followed and doubled in turn,
    so the number of passes grows with the logarithm of the number of triggers.
    """
    if rest <= 0:
        return hits.select("rule", "_rn")
    keys = ["rule", "_rn"]
    pointers = cut_lineage(_next_hits(hits, rest, bucket_seconds))
    found = cut_lineage(hits.groupBy("rule").agg(F.min_by("_rn", F.struct("_us", "_rn")).alias("_rn")))
    count = found.count()
    while True:
        ahead = found.join(pointers, keys).select("rule", F.col("_next").alias("_rn"))
        found = cut_lineage(found.unionByName(ahead).distinct())
        if (grown := found.count()) == count:
            return found
        count = grown
        far = pointers.select("rule", F.col("_rn").alias("_next"), F.col("_next").alias("_far"))
        pointers = cut_lineage(pointers.join(far, ["rule", "_next"]).select("rule", "_rn", F.col("_far").alias("_next")))


def _next_hits(hits: DataFrame, rest: int, bucket_seconds: float) -> DataFrame:
    """``rule, _rn, _next``: the first hit at or after each hit's time plus ``rest``.

    Looked up inside time buckets; where a bucket holds none, the first hit of a later bucket counts.
    """
    hit = F.struct("_us", "_rn")
    events = hits.select("rule", "_us", F.lit(1).alias("_kind"), hit.alias("_hit"), F.lit(None).cast("long").alias("_from"))
    probes = hits.select("rule", (F.col("_us") + rest).alias("_us"), F.lit(0), F.lit(None).cast(events.schema["_hit"].dataType), "_rn")
    both = events.union(probes).withColumn("_bkt", time_bucket_of("_us", bucket_seconds))
    # Latest first: a frame that ends at the row grows by one row each, one that ends with the bucket is read anew for each.
    late = [F.col(c).desc() for c in ("_us", "_kind", "_hit")]
    ahead = Window.partitionBy("rule", "_bkt").orderBy(*late).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(ahead))
    firsts = both.groupBy("rule", (-F.col("_bkt")).alias("_back")).agg(F.min("_hit").alias("_later"))
    later = prefix(firsts, ["rule"], "_back", {"_later": "min"}).select("rule", (-F.col("_back")).alias("_bkt"), "_later")
    out = here.where("_kind = 0").join(later, ["rule", "_bkt"], "left")
    return out.select("rule", F.col("_from").alias("_rn"), F.coalesce("_near", "_later")["_rn"].alias("_next")).where("_next IS NOT NULL")


def time_bucket_of(micros_column: str, seconds: float) -> Column:
    return F.floor(F.col(micros_column) / F.lit(int(seconds * 1_000_000)))


def alert_view(alerts: DataFrame, show_resolved: bool = True, limit: int = 10) -> DataFrame:
    """The newest alerts with the total and active counts on every row."""
    shown = alerts if show_resolved else alerts.where(~F.col("resolved"))
    counts = alerts.agg(F.count("*").alias("total"), F.count_if(~F.col("resolved")).alias("active")).select(F.struct("*")).scalar()
    newest = shown.orderBy(F.col("timestamp").desc(), "rule").limit(limit)
    return newest.withColumn("_c", counts).select(
        "rule", "severity", "timestamp", F.col("_c.total").alias("total_alerts"), F.col("_c.active").alias("active_alerts")
    )


def threshold_check(samples: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Values above their threshold: warning, or critical from 1.5 times on."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold"))
        for m, t in thresholds.items() if m in samples.columns
    ])
    keep = [c for c in samples.columns if c not in thresholds]
    out = samples.select(*keep, F.explode(cells).alias("x")).select(*keep, "x.*").where("value > threshold")
    level = F.when(F.col("value") < F.col("threshold") * CRITICAL_FACTOR, "warning").otherwise("critical")
    return out.withColumn("severity", level)


# --- logs -----------------------------------------------------------------------


def log_counts(logs: DataFrame) -> DataFrame:
    return logs.withColumn("level", F.lower("level")).rollup("level").agg(F.count("*").alias("n")).select(
        F.coalesce("level", F.lit("total")).alias("level"), "n"
    )


def error_patterns(logs: DataFrame) -> DataFrame:
    """The most frequent messages and sources among the newest 1000 errors."""
    newest = logs.where(F.lower("level") == "error").orderBy(F.col("timestamp").desc()).limit(RECENT_LOGS)
    parts = F.array(
        F.struct(F.lit("message").alias("kind"), F.col("message").alias("text")),
        F.struct(F.lit("source").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("text")),
    )
    counts = newest.select(F.explode(parts).alias("x")).groupBy("x.kind", "x.text").agg(F.count("*").alias("n"))
    order = Window.partitionBy("kind").orderBy(F.col("n").desc(), "text")
    return counts.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP_PATTERNS)


def log_anomalies(logs: DataFrame, max_memory_mb: float) -> DataFrame:
    """Error share and peak memory of the newest 1000 rows against their limits."""
    newest = logs.select("timestamp", "level", "memory_mb").orderBy(F.col("timestamp").desc()).limit(RECENT_LOGS)
    values = newest.agg((F.count_if(F.col("level") == "error") / F.count("*")).alias("e"), F.max("memory_mb").alias("m"))
    return long_form(values, [], [
        {"anomaly": F.lit("high_error_rate"), "value": F.col("e"), "threshold": F.lit(ERROR_SHARE)},
        {"anomaly": F.lit("high_memory_usage"), "value": F.col("m").cast("double"), "threshold": F.lit(max_memory_mb * MEMORY_SHARE)},
    ]).where("value > threshold")


def sensitive(name: Column) -> Column:
    lower = F.lower(name)
    test = F.lit(False)
    for word in SENSITIVE_KEYS:
        test = test | F.contains(lower, F.lit(word))
    return test


def redact(value: Column, kind: DataType) -> Column:
    """Replace values under sensitive names, following structs, maps and arrays by their type."""
    if isinstance(kind, StructType):
        fields = []
        for f in kind.fields:
            hidden = any(w in f.name.lower() for w in SENSITIVE_KEYS)
            fields.append((F.lit(REDACTED) if hidden else redact(value[f.name], f.dataType)).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, MapType):
        inner = kind.valueType
        mark = F.lit(REDACTED) if isinstance(inner, StringType) else F.lit(None).cast(inner)
        return F.transform_values(value, lambda k, v: F.when(sensitive(k), mark).otherwise(redact(v, inner)))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: redact(v, kind.elementType))
    return value


def redact_column(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, redact(F.col(column), df.schema[column].dataType))


# --- request rates ----------------------------------------------------------------


def request_rates(requests: DataFrame, limit: int, seconds: int = 60, bucket_seconds: int = 600) -> DataFrame:
    """Requests of the same user in the trailing window, and whether they exceed the limit.

    Rows are grouped by user and time bucket; rows near the end of a bucket are
    copied to the next one, so a busy user spreads over many tasks. A bucket is at
    least as long as the window, so one copy always suffices.
    """
    us, span, width = micros("timestamp"), seconds * 1_000_000, max(bucket_seconds, seconds) * 1_000_000
    home = F.floor(F.col("_us") / width)
    copies = F.array_compact(F.array(home, F.when(F.col("_us") % width > width - span, home + 1)))
    frame = requests.withColumn("_us", us).withColumn("_home", home).withColumn("_bkt", F.explode(copies))
    w = Window.partitionBy("user", "_bkt").orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = frame.withColumn("n_recent", F.count("*").over(w)).where(F.col("_bkt") == F.col("_home"))
    return counted.withColumn("over_limit", F.col("n_recent") > limit).drop("_us", "_bkt", "_home")


def request_decisions(requests: DataFrame, limit: int, seconds: int = 60, bucket_seconds: float = 3600,
                      block_rows: int | None = None) -> DataFrame:
    """Allowed or denied in order; only allowed requests count towards the limit."""
    frame = requests.withColumn("_us", micros("timestamp"))
    blocks = with_rows(frame, [], keys=["user"], block_rows=block_rows,
                       number={"order": ["_us"], "bucket": time_bucket_of("_us", bucket_seconds)})
    span = seconds * 1_000_000

    def walk(table: pa.Table, state: dict | None) -> tuple[list[bool], dict]:
        recent = deque(state["recent"] if state else ())
        out = []
        for now in table["_us"].to_pylist():
            while recent and recent[0] <= now - span:
                recent.popleft()
            out.append(len(recent) < limit)
            if out[-1]:
                recent.append(now)
        return out, {"recent": list(recent)}

    decided = settle(blocks, walk, "recent array<bigint>", "allowed", "boolean", ["_us"], ["user"])
    return plain(decided).drop("_us")


