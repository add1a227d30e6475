"""Streaming ingest of candlestick arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.schemas import BAR_VALUES, KEYS
from tidemark.sources import klines

LANDING = "symbol string, interval string, value string"


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """JSON lines with symbol, interval and the raw array as text, as they land."""
    return spark.readStream.schema(LANDING).option("maxFilesPerTrigger", files_per_trigger).json(path)


def split_valid(landed: DataFrame) -> DataFrame:
    """Decoded bars with the list of broken rules; works on streams and tables alike."""
    checked = klines.validate(landed)
    raw = F.from_json("value", "array<string>")
    return checked.withColumn("_raw", raw).select(
        F.timestamp_millis(klines.slot(F.col("_raw"), "timestamp").try_cast("long")).alias("timestamp"),
        "symbol", "interval", *[klines.number(F.col("_raw"), c).alias(c) for c in BAR_VALUES], "broken", "value",
    )


def valid_bars(landed: DataFrame) -> DataFrame:
    """Bars of the landed rows that break no rule, in the columns of a bar table."""
    return split_valid(landed).where(F.size("broken") == 0).select("timestamp", *KEYS, *BAR_VALUES)


def once(rows: DataFrame, batch_id: int, path: str, by: Sequence[str] = ()) -> None:
    """Write the rows of a micro-batch so that a second attempt replaces the first."""
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id", *by).parquet(path)


def ingest(landed: DataFrame, valid_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Write valid bars and rejected rows to two Parquet tables, batch by batch.

    Each batch has its own ``batch_id`` folders, which a repeated batch overwrites.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        good = F.size("broken") == 0
        once(batch.where(good).drop("broken", "value"), batch_id, valid_path, ["symbol", "interval"])
        once(batch.where(~good).select("symbol", "interval", "value", "broken"), batch_id, rejected_path)
        batch.unpersist()

    return split_valid(landed).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
