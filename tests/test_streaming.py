import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.streaming import monitoring as W

METRICS = "name string, value double, timestamp timestamp"
START = dt.datetime(2024, 1, 1)


def stream_of(spark, tmp_path, rows, parts=3):
    """The rows as a stream of several files in time order."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], METRICS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(METRICS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in")


def run(spark, df, name, mode, tmp_path):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.table(name)


def rows(n=60):
    return [("cpu", float((i * 7) % 30), START + dt.timedelta(minutes=i)) for i in range(n)]


def test_windowed_metrics(spark, tmp_path):
    data = rows() + [("cpu", 1.0, START + dt.timedelta(hours=5))]
    got = run(spark, W.windowed_metrics(stream_of(spark, tmp_path, data)), "windows", "append", tmp_path).collect()
    done = {r["timestamp"]: (r["value"], r["n"]) for r in got}
    for k in range(12):
        values = [v for _, v, t in rows() if START + dt.timedelta(minutes=5 * k) <= t < START + dt.timedelta(minutes=5 * k + 5)]
        assert done[START + dt.timedelta(minutes=5 * k)] == (sum(values) / 5, 5)


RULE = "rule string, metric string, condition string, threshold double, severity string, enabled boolean"


def cycle(spark, data, rules, columns):
    batch = M.alert_cycle(spark.createDataFrame(data, METRICS), rules).where("state in ('triggered', 'resolved')")
    return sorted(map(tuple, batch.select(*columns).collect()))


def test_alert_stream_equals_the_batch(spark, tmp_path):
    """Values out of order by less than the lateness, over several files; one comes too late and is left out."""
    rules = spark.createDataFrame([("high", "cpu", "gt", 20.0, "warning", True), ("off", "cpu", "gt", 0.0, "warning", False)], RULE)
    data = rows(90)
    for i in range(0, 84, 6):  # swap over up to five minutes, also between files
        data[i], data[i + 5] = data[i + 5], data[i]
    end = [("cpu", 0.0, START + dt.timedelta(days=2))]
    late = [("cpu", 25.0, START + dt.timedelta(minutes=1, seconds=30))]
    stream = stream_of(spark, tmp_path, data + late + end, parts=4)
    got = run(spark, W.alert_states(stream, rules), "alerts", "append", tmp_path)
    assert sorted(map(tuple, got.collect())) == cycle(spark, data, rules, got.columns)


def test_state_of_a_quiet_rule_is_dropped(spark, tmp_path):
    """A rule that fired and resolved leaves no state; one that stays active does, or expires when asked to."""
    rules = spark.createDataFrame([("high", "cpu", "gt", 20.0, "warning", True), ("disk", "disk", "gt", 20.0, "warning", True)], RULE)
    at = lambda m: START + dt.timedelta(minutes=m)
    data = [("cpu", 30.0, at(0)), ("disk", 30.0, at(0)), ("cpu", 1.0, at(30)), ("other", 0.0, at(60)), ("cpu", 30.0, at(600)), ("cpu", 1.0, at(630)), ("disk", 1.0, at(640)), ("disk", 30.0, at(660)), ("other", 0.0, at(3000))]
    data = data + [("tick", 0.0, at(3000 + i)) for i in range(3)]
    # Values without a rule move the watermark only through the join's other side, so both metrics close with one.
    closing = data + [("cpu", 0.0, at(6000))]
    stream = stream_of(spark, tmp_path, closing, parts=len(closing))
    got = run(spark, W.alert_states(stream, rules), "quiet", "append", tmp_path)
    want = [c for c in cycle(spark, data, rules, got.columns)]
    assert sorted(map(tuple, got.collect())) == want
    (tmp_path / "b").mkdir()
    expiring = W.alert_states(stream_of(spark, tmp_path / "b", closing, parts=len(closing)), rules, idle=3600 * 3)
    found = sorted((r.rule, (r.timestamp - START).total_seconds() / 60, r.state) for r in run(spark, expiring, "expiring", "append", tmp_path / "b").collect())
    assert found == [
        ("disk", 0, "triggered"), ("disk", 180, "expired"), ("disk", 660, "triggered"), ("disk", 840, "expired"),
        ("high", 0, "triggered"), ("high", 30, "resolved"), ("high", 600, "triggered"), ("high", 630, "resolved"),
    ]


def test_rule_hits(spark, tmp_path):
    rules = spark.createDataFrame([("high", "cpu", "gte", 0.0, "warning", True)], "rule string, metric string, condition string, threshold double, severity string, enabled boolean")
    data = rows() + [("cpu", 1.0, START + dt.timedelta(hours=5))]
    got = run(spark, W.rule_hits(stream_of(spark, tmp_path, data), rules), "hits", "append", tmp_path)
    assert got.count() == 12


def test_monitor_batches(spark, tmp_path):
    reference = spark.createDataFrame(rows(), METRICS)
    shifted = [("cpu", v + 100, t) for _, v, t in rows()]
    query = W.monitor_batches(stream_of(spark, tmp_path, shifted, parts=2), reference, ["value"], ["name"], f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination(180)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.where("feature = 'value'").agg(F.bool_and("drift_detected")).first()[0]
    assert got.select("batch_id").distinct().count() == 2 and got.count() == 4
