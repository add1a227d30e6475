"""Streaming metrics, alerts and drift monitoring."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators import drift as D
from tidemark.operators import metrics as M
from tidemark.streaming.bars import once


def windowed_metrics(metrics: DataFrame, minutes: int = M.BUCKET_MINUTES, lateness: str = "10 minutes") -> DataFrame:
    """Average and count per metric and time window; windows start on whole multiples of their length."""
    return (
        metrics.withWatermark("timestamp", lateness)
        .groupBy("name", F.window("timestamp", f"{minutes} minutes").alias("w"))
        .agg(F.avg("value").alias("value"), F.count("*").alias("n"))
        .select("name", F.col("w.start").alias("timestamp"), "value", "n")
    )


def threshold_alerts(samples: DataFrame, thresholds: Mapping[str, float]) -> DataFrame:
    """Stateless two-level check of every sample."""
    return M.threshold_check(samples, thresholds)


def rule_hits(metrics: DataFrame, rules: DataFrame, lateness: str = "10 minutes", minutes: int = M.BUCKET_MINUTES) -> DataFrame:
    """Rules that hold for the latest value of their metric in each window.

    ``rules`` is a static table; the join keeps the stream's partitioning.
    """
    latest = (
        metrics.withWatermark("timestamp", lateness)
        .groupBy("name", F.window("timestamp", f"{minutes} minutes").alias("w"))
        .agg(F.max_by("value", "timestamp").alias("current_value"), F.max("timestamp").alias("timestamp"))
    )
    joined = latest.join(rules.where("enabled"), latest["name"] == rules["metric"])
    met = M.condition_met(F.col("condition"), F.col("current_value"), F.col("threshold"))
    return joined.where(met).select("rule", "metric", "severity", "current_value", "timestamp")


class AlertMachine(StatefulProcessor):
    """State of one rule. Values wait until the watermark has passed them and are taken in order of time.

    Kept are the values that wait and, only while they matter, whether the rule is active and when it last fired: an inactive
    rule whose cooldown is over is as good as new, so a timer drops its state. With ``idle``, an active
    rule without values for so long ends as ``expired``.
    """

    def __init__(self, rest: int, idle: int | None) -> None:
        self.rest, self.idle = rest, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, value double, met boolean")
        self.status = handle.getValueState("status", "active boolean, fired bigint, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = [(int(us), None if pd.isna(v) else float(v), bool(met)) for us, v, met in zip(batch["us"], batch["value"], batch["met"])]
            self.waiting.appendList(new)
            for second in {us // 1_000_000 for us, _, _ in new}:
                self.handle.registerTimer((second + 1) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        active, fired, last = self.status.get() if self.status.exists() else (False, None, None)
        due, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] < now else later).append(tuple(row))
        changes = []

        def expire(until: int) -> bool:
            return bool(active and self.idle is not None and until >= last + self.idle)

        for us, value, met in sorted(due, key=lambda r: r[0]):
            if expire(us):
                changes.append((last + self.idle, None, "expired"))
                active, fired = False, None
            last = us
            if fired is not None and us - fired < self.rest:
                continue
            if met:
                active, fired = True, us
                changes.append((us, value, "triggered"))
            elif active:
                active = False
                changes.append((us, value, "resolved"))
        if expire(now) and not later:
            changes.append((last + self.idle, None, "expired"))
            active, fired = False, None
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        if fired is not None and not active and now - fired >= self.rest:
            fired = None
        if active or fired is not None:
            self.status.update((active, fired, last))
            end = fired + self.rest if not active else None if self.idle is None else last + self.idle
            if end is not None:
                self.handle.registerTimer(-(-max(end, now + 1) // 1000))
        elif self.status.exists():
            self.status.clear()
        if changes:
            yield pd.DataFrame({
                "rule": key[0], "timestamp": pd.to_datetime([c[0] for c in changes], unit="us"), "value": [c[1] for c in changes],
                "state": [c[2] for c in changes],
            }).astype({"value": "float64"})

    def close(self) -> None:
        pass


def alert_states(
    metrics: DataFrame, rules: DataFrame, cooldown: float = M.COOLDOWN_SECONDS, lateness: str = "10 minutes", idle: float | None = None
) -> DataFrame:
    """The alert cycle on a stream: one row per change (triggered, resolved or expired) of a rule.

    Values may arrive out of order by up to ``lateness``; the changes equal those of the batch cycle over all values
    that were not later than that. A change appears once the watermark has passed it. Needs the RocksDB state store, which
    the session settings of this library name.
    """
    met = F.coalesce(M.condition_met(F.col("condition"), F.col("value"), F.col("threshold")), F.lit(False))
    timed = metrics.withWatermark("timestamp", lateness)
    joined = timed.join(rules.where("enabled"), timed["name"] == rules["metric"])
    rows = joined.select("rule", "timestamp", F.unix_micros("timestamp").alias("us"), "value", met.alias("met"))
    machine = AlertMachine(int(cooldown * 1_000_000), None if idle is None else int(idle * 1_000_000))
    return rows.groupBy("rule").transformWithStateInPandas(
        statefulProcessor=machine, outputStructType="rule string, timestamp timestamp, value double, state string", outputMode="append", timeMode="EventTime",
    )


def monitor_batches(
    stream: DataFrame, reference: DataFrame, continuous: Sequence[str], categorical: Sequence[str],
    results_path: str, checkpoint: str, time_column: str = "timestamp",
) -> StreamingQuery:
    """Compare every micro-batch with the reference: one row per feature and ``batch_id``, also when a batch is repeated."""

    def check(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch.persist()
        found = D.drift_results(reference, batch, continuous, categorical)
        newest = batch.agg(F.max(time_column)).scalar()
        once(found.withColumn("timestamp", newest), batch_id, results_path)
        batch.unpersist()

    return stream.writeStream.foreachBatch(check).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
