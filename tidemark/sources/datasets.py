"""Dataset versions and the dataset catalogue, kept as tables next to the data."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION_SCHEMA = (
    "version_id string, dataset_id string, tag string, created_at timestamp, row_count long, "
    "content_hash string, columns array<string>, metadata map<string,string>"
)
CATALOG_SCHEMA = (
    "dataset_id string, registered_at timestamp, metadata map<string,string>, columns map<string,string>, "
    "quality map<string,double>"
)


def content_hash(df: DataFrame) -> DataFrame:
    """Row count and two sums that do not depend on row order, in one aggregate."""
    row = F.xxhash64(*[F.to_json(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes])
    hashed = df.select(row.alias("_h"))
    return hashed.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(F.col("_h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"),
        F.coalesce(F.bit_xor("_h"), F.lit(0)).alias("hash_xor"),
    )


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


def create_version(
    df: DataFrame, root: str, dataset_id: str, tag: str, metadata: Mapping[str, str] | None = None
) -> str:
    """Write the frame under its version id and append one row to the version table."""
    spark = df.sparkSession
    created = _now()
    version_id = f"{dataset_id}_{tag}_{created:%Y%m%d%H%M%S%f}"
    df.write.parquet(f"{root}/data/{version_id}")
    summary = content_hash(spark.read.parquet(f"{root}/data/{version_id}")).first()
    entry = (
        version_id, dataset_id, tag, created, summary["row_count"],
        f"{summary['hash_sum']}:{summary['hash_xor']}", df.columns, dict(metadata or {}),
    )
    spark.createDataFrame([entry], VERSION_SCHEMA).write.mode("append").parquet(f"{root}/versions")
    return version_id


def load_version(spark: SparkSession, root: str, version_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/data/{version_id}")


def list_versions(spark: SparkSession, root: str, dataset_id: str) -> DataFrame:
    table = spark.read.schema(VERSION_SCHEMA).parquet(f"{root}/versions")
    return table.where(F.col("dataset_id") == dataset_id).orderBy("version_id")


def version_metadata(spark: SparkSession, root: str, version_id: str) -> dict | None:
    table = spark.read.schema(VERSION_SCHEMA).parquet(f"{root}/versions")
    row = table.where(F.col("version_id") == version_id).first()
    return row.asDict(recursive=True) if row else None


def register_dataset(
    df: DataFrame, root: str, dataset_id: str, metadata: Mapping[str, str], quality: Mapping[str, float] | None = None
) -> None:
    """Append a catalogue entry; the newest entry of an id counts."""
    text = {k: v if isinstance(v, str) else json.dumps(v) for k, v in metadata.items()}
    entry = (dataset_id, _now(), text, dict(df.dtypes), {k: float(v) for k, v in (quality or {}).items()})
    df.sparkSession.createDataFrame([entry], CATALOG_SCHEMA).write.mode("append").parquet(f"{root}/catalog")


def latest_entries(entries: DataFrame) -> DataFrame:
    newest = Window.partitionBy("dataset_id").orderBy(F.col("registered_at").desc())
    return entries.withColumn("_i", F.row_number().over(newest)).where("_i = 1").drop("_i")


def matching(entries: DataFrame, criteria: Mapping[str, str] | None = None) -> DataFrame:
    """Entries whose metadata equals every criterion."""
    for key, value in (criteria or {}).items():
        entries = entries.where(F.try_element_at("metadata", F.lit(key)) == value)
    return entries


def list_datasets(spark: SparkSession, root: str, criteria: Mapping[str, str] | None = None) -> DataFrame:
    table = spark.read.schema(CATALOG_SCHEMA).parquet(f"{root}/catalog")
    return matching(latest_entries(table), criteria)
