import datetime as dt
import json
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.sources import datasets, files, klines
from tidemark.streaming.bars import ingest, read_landing


def row(ts, o, h, lo, c, v):
    return json.dumps([ts, o, h, lo, c, v, "0", "0", "0", "0", "0", "0"])


GOOD = row("1704067200000", "1.5", "2", "1", "1.7", "10")


def test_save_and_load(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "a.b")
    assert files.save_parquet(df, f"{tmp_path}/t", "gzip") == ["a.b"]
    assert files.load_parquet(spark, f"{tmp_path}/t").count() == 3
    with pytest.raises(ValueError):
        files.save_parquet(df.limit(0), f"{tmp_path}/e")
    with pytest.raises(ValueError):
        files.save_parquet(df, f"{tmp_path}/c", "lzw")


def test_formats(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "n int, s string").write.option("header", True).csv(f"{tmp_path}/c")
    assert files.load_file(spark, f"{tmp_path}/c", "csv", "n int, s string").first()["n"] == 1
    assert files.load_file(spark, f"{tmp_path}/c", "csv").dtypes[0] == ("n", "int")
    with pytest.raises(ValueError):
        files.load_file(spark, f"{tmp_path}/c", "avro")


def test_many_files_by_name_skipping_bad_ones(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{tmp_path}/x.parquet")
    spark.createDataFrame([(3, 4)], "b int, a int").write.parquet(f"{tmp_path}/y.parquet")
    got = files.load_many(spark, [f"{tmp_path}/x.parquet", f"{tmp_path}/y.parquet"])
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [(1, 2), (4, 3)]


def test_database_arguments(spark):
    with pytest.raises(ValueError):
        files.load_database(spark, "jdbc:none")


def test_unknown_symbol_has_no_rows(spark):
    bars = spark.createDataFrame([("A", dt.datetime(2024, 1, 1))], "symbol string, timestamp timestamp")
    assert files.load_symbols(bars, ["A", "Z"], "2024-01-01", "2024-01-02").count() == 1


def test_kline_rules(spark):
    values = [GOOD, "[1,2]", row("0", "1", "2", "1", "1", "1"), row("1", "3", "2", "1", "5", "-1"), row("1", "0", "0", "0", "0", "1"), row("1", "x", "2", "1", "1", "1"), "junk"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    got = [r["broken"] for r in klines.validate(df).collect()]
    assert got == [[], ["format"], ["timestamp"], ["open_range", "close_range", "negative_volume"], ["non_positive_price"], ["number"], ["format"]]
    assert klines.require_valid(df.limit(1)).count() == 1
    with pytest.raises(ValueError):
        klines.require_valid(df)


def test_versions_and_catalogue(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, "x"), (2, "y")], "n int, s string")
    first = datasets.create_version(df, root, "bars", "v1", {"from": "test"})
    second = datasets.create_version(df.where("n = 1"), root, "bars", "v2")
    assert [r["version_id"] for r in datasets.list_versions(spark, root, "bars").collect()] == sorted([first, second])
    assert datasets.load_version(spark, root, first).count() == 2
    assert datasets.version_metadata(spark, root, first)["metadata"] == {"from": "test"}
    assert datasets.version_metadata(spark, root, "none") is None
    datasets.register_dataset(df, root, "bars", {"kind": "raw"}, {"overall": 90})
    datasets.register_dataset(df, root, "bars", {"kind": "clean"})
    datasets.register_dataset(df, root, "other", {"kind": "raw"})
    assert {r["dataset_id"] for r in datasets.list_datasets(spark, root, {"kind": "raw"}).collect()} == {"other"}
    assert datasets.list_datasets(spark, root).count() == 2


def test_hash_ignores_order_but_not_content(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 0.5)
    hash_of = lambda d: datasets.content_hash(d).first()
    assert hash_of(df) == hash_of(df.orderBy(F.desc("id")))
    assert hash_of(df) != hash_of(df.withColumn("x", F.col("x") + F.when(F.col("id") == 7, 1).otherwise(0)))


def test_stream_ingest(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    lines = [{"symbol": "A", "interval": "1h", "value": v} for v in [GOOD, "junk"]]
    (landing / "a.json").write_text("\n".join(json.dumps(x) for x in lines))
    query = ingest(read_landing(spark, str(landing)), f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/cp")
    query.awaitTermination(120)
    good = spark.read.parquet(f"{tmp_path}/ok").collect()
    assert [(r["symbol"], r["close"], r["timestamp"]) for r in good] == [("A", 1.7, dt.datetime(2024, 1, 1))]
    assert spark.read.parquet(f"{tmp_path}/bad").first()["broken"] == ["format"]


def test_unreadable_files_are_named(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/a")
    good = next((tmp_path / "a").glob("*.parquet"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "good one.parquet").write_bytes(good.read_bytes())
    (tmp_path / "in" / "bad.parquet").write_bytes(good.read_bytes()[:100])
    loaded = files.load_many(spark, f"{tmp_path}/in/*.parquet")
    assert loaded.count() == 3
    assert [r["source_file"] for r in files.files_without_rows(loaded, f"{tmp_path}/in/*.parquet").collect()] == ["bad"]


def test_files_cut_short_are_named(spark, tmp_path):
    """One whole file, one with a fault in its second half, one that is no Parquet file."""
    rng = random.Random(2)
    for name in ("whole", "broken"):
        table = pa.table({"a": list(range(4000)), "b": ["".join(rng.choices("abcdefgh", k=20)) for _ in range(4000)]})
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=1000, compression="gzip")
    (tmp_path / "other.parquet").write_text("no table")
    path = tmp_path / "broken.parquet"
    at = pq.ParquetFile(path).metadata.row_group(2).column(1)
    raw = bytearray(path.read_bytes())
    start = at.dictionary_page_offset or at.data_page_offset
    raw[start + 40 : start + at.total_compressed_size - 40] = bytes(at.total_compressed_size - 80)
    path.write_bytes(bytes(raw))
    pattern = f"{tmp_path}/*.parquet"
    loaded = files.load_many(spark, pattern)
    short = files.files_cut_short(loaded, pattern).collect()
    assert [(r.source_file, r.rows_stated) for r in short] == [("broken", 4000)] and short[0].rows_read < 4000
    assert [r.source_file for r in files.files_without_rows(loaded, pattern).collect()] in (["other"], ["broken", "other"], ["other", "broken"])
    assert files.files_cut_short(files.load_many(spark, f"{tmp_path}/whole.parquet"), f"{tmp_path}/whole.parquet").count() == 0
