"""Indicators on a stream against the batch operators."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators as I
from tidemark.schemas import BAR_VALUES, BARS, KEYS
from tidemark.streaming import bars as B
from tidemark.streaming import indicators as S

START = dt.datetime(2024, 1, 1)
COLUMNS = ["EMA_3", "EMA_12", "MACD", "MACD_Signal", "MACD_Histogram", "RSI_5", "Parabolic_SAR"]
OPTIONS = {"periods": (3, 12), "macd": (4, 9, 3), "rsi": 5}
FOREVER = START + dt.timedelta(days=30)


def walk(symbol, n, seed, missing=()):
    rng, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        price = max(1.0, price + rng.choice([-1.5, -0.5, 0.0, 0.5, 1.5]))
        values = [price, price + rng.random(), price - rng.random(), price + rng.choice([-0.25, 0.25]), 10.0]
        out.append((START + dt.timedelta(minutes=i), symbol, "1m", *[None if i in missing else v for v in values]))
    return out


def batch_columns(spark, rows, block_rows=None):
    """The batch operators' columns by bar."""
    bars = spark.createDataFrame(rows, BARS)
    frames = [
        I.ema(bars, periods=(3, 12), block_rows=block_rows), I.macd(bars, fast=4, slow=9, signal=3, block_rows=block_rows),
        I.rsi(bars, n=5, block_rows=block_rows), I.parabolic_sar(bars, block_rows=block_rows),
    ]
    out = {}
    for df in frames:
        names = [c for c in COLUMNS if c in df.columns]
        for r in df.select("timestamp", *KEYS, *names).collect():
            out.setdefault((r.symbol, r.timestamp), {}).update({c: r[c] for c in names})
    return out


def run(df, folder):
    query = df.writeStream.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start(f"{folder}/out", format="parquet")
    query.awaitTermination(180)
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out")


def same(found, expected):
    got = {(r.symbol, r.timestamp): {c: r[c] for c in COLUMNS} for r in found}
    assert len(got) == len(found) and got.keys() == expected.keys()
    for key, values in expected.items():
        for name, value in values.items():
            assert got[key][name] == (value if value is None else pytest.approx(value, rel=1e-9, abs=1e-9)), (key, name)


def write(spark, rows, folder):
    spark.createDataFrame(rows, BARS).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def read(spark, folder):
    return spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_in_several_batches_equals_the_batch(spark, tmp_path):
    """Three series, one short, one with missing bars; bars out of order also between files, one too late; a restart."""
    rows = walk("A", 90, 1) + walk("B", 4, 2) + walk("C", 90, 3, missing={40, 41, 60})
    rng = random.Random(5)
    rows.sort(key=lambda r: (r[0] + dt.timedelta(minutes=rng.random() * 8)))
    parts = [rows[:60], rows[60:61], rows[61:130], rows[130:]]
    for part in parts[:2]:
        write(spark, part, tmp_path)
    run(S.indicators(read(spark, tmp_path), **OPTIONS), tmp_path)
    write(spark, parts[2], tmp_path)
    late = (START - dt.timedelta(minutes=30), "A", "1m", *[999.0] * 5)
    write(spark, parts[3] + [late, (FOREVER, "Z", "1m", *[1.0] * 5)], tmp_path)
    found = run(S.indicators(read(spark, tmp_path), **OPTIONS), tmp_path)
    same(found.collect(), batch_columns(spark, rows))
    assert found.columns == [*KEYS, "timestamp", *BAR_VALUES, *COLUMNS]


def test_landed_arrays_to_indicators(spark, tmp_path):
    """From raw arrays: rows that break a rule have no bar, extra columns are ignored."""
    rows = walk("A", 30, 7)
    (tmp_path / "in").mkdir()
    lines = []
    for at, symbol, interval, o, h, lo, c, v in rows + [(FOREVER, "Z", "1m", *[1.0] * 5)]:
        h, lo = max(o, h, c), min(o, lo, c)
        ms = int(at.replace(tzinfo=dt.UTC).timestamp() * 1000)
        lines.append({"symbol": symbol, "interval": interval, "value": json.dumps([str(x) for x in [ms, o, h, lo, c, v, ms, 0, 0, 0, 0, 0]])})
    lines.insert(3, {"symbol": "A", "interval": "1m", "value": "[1, 2]"})
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    landed = B.valid_bars(B.read_landing(spark, f"{tmp_path}/in")).withColumn("us", F.lit("other"))
    found = run(S.indicators(landed, **OPTIONS), tmp_path).collect()
    fixed = [(at, s, i, o, max(o, h, c), min(o, lo, c), c, v) for at, s, i, o, h, lo, c, v in rows]
    same(found, batch_columns(spark, fixed))


def test_backfill_and_empty_table(spark, tmp_path):
    rows = walk("A", 50, 1) + walk("B", 50, 2)
    found = S.backfill(spark.createDataFrame(rows, BARS), f"{tmp_path}/all", slices=3, **OPTIONS)
    same(found.collect(), batch_columns(spark, rows))
    assert S.backfill(spark.createDataFrame([], BARS), f"{tmp_path}/none", **OPTIONS).count() == 0


def test_missing_bars_of_the_stop(spark):
    """Bars without high or low have no stop and change nothing; whole blocks of them too."""
    gone = {0, 1, 2, 3, 4, 9, 16, 17, 18, 19, 20, 21, 22, 23, 30}
    rows = walk("A", 40, 3, missing=gone)
    whole = [r for i, r in enumerate(rows) if i not in gone]
    plain = {r.timestamp: r.Parabolic_SAR for r in I.parabolic_sar(spark.createDataFrame(whole, BARS)).collect()}
    found = I.parabolic_sar(spark.createDataFrame(rows, BARS), block_rows=4).collect()
    assert {r.timestamp: r.Parabolic_SAR for r in found} == {r[0]: plain.get(r[0]) for r in rows}


def test_wrong_windows(spark):
    bars = spark.createDataFrame([], BARS)
    with pytest.raises(ValueError, match="positive"):
        S.indicators(bars, rsi=0)
    with pytest.raises(ValueError, match="less than"):
        S.indicators(bars, macd=(9, 9, 3))
