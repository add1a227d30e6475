"""Reading and writing files and database tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What a column name should not contain, and the codecs on offer.
NAME_MARKS = "()[]{}.,;:"
CODECS = ["snappy", "gzip", "brotli"]
FORMATS = ["parquet", "csv"]


def load_parquet(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | str | None = None
) -> DataFrame:
    """Scan a folder or file; the filter and the column list reach the reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def questionable_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(m in c for m in NAME_MARKS)]


def save_parquet(
    df: DataFrame, path: str, compression: str = "snappy", partition_by: Sequence[str] = (), mode: str = "errorifexists"
) -> list[str]:
    """Write a non-empty frame; returns the column names worth renaming."""
    if compression not in CODECS:
        raise ValueError(f"unknown compression {compression!r}")
    if df.isEmpty():
        raise ValueError("refusing to write an empty frame")
    writer = df.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return questionable_names(df)


def load_file(spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | str | None = None) -> DataFrame:
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_database(
    spark: SparkSession, url: str, table: str | None = None, query: str | None = None,
    partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 1, **options: str,
) -> DataFrame:
    """Scan a database table or query; a partition column splits the read into tasks."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if query is not None and partition_column is None:
        return reader.option("query", query).load()
    reader = reader.option("dbtable", table or f"({query}) q")
    if partition_column is not None:
        low, high = bounds
        reader = (
            reader.option("partitionColumn", partition_column).option("lowerBound", str(low))
            .option("upperBound", str(high)).option("numPartitions", str(partitions))
        )
    return reader.load()


def load_many(spark: SparkSession, pattern: str | Sequence[str], fmt: str = "parquet", skip_bad: bool = True) -> DataFrame:
    """All files of a pattern, columns matched by name, with the file stem as ``source_file``.

    With ``skip_bad`` a file is left at its first fault: :func:`files_without_rows` names those that gave no row,
    :func:`files_cut_short` the Parquet files that gave only a part of theirs.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}")
    reader = spark.read.format(fmt).option("ignoreCorruptFiles", skip_bad)
    reader = reader.option("mergeSchema", True) if fmt == "parquet" else reader.option("header", True)
    return reader.load(pattern).select("*", _stem().alias("source_file"))


def _stem() -> Column:
    return F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "")


def files_without_rows(loaded: DataFrame, pattern: str | Sequence[str]) -> DataFrame:
    """``source_file`` and ``bytes`` of the files of a pattern that gave :func:`load_many` no rows: unreadable or empty ones."""
    listed = loaded.sparkSession.read.format("binaryFile").load(pattern)
    found = listed.select(_stem().alias("source_file"), F.col("length").alias("bytes"))
    return found.join(loaded.select("source_file").distinct(), "source_file", "left_anti")


def files_cut_short(loaded: DataFrame, pattern: str | Sequence[str]) -> DataFrame:
    """``source_file, rows_stated, rows_read`` of the Parquet files that :func:`load_many` left before their end.

    A file states its rows in its footer, so they are counted without reading a column; ``loaded`` reads all of its columns.
    Both counts combine on the map side. Other formats state no number of rows.
    """
    counted = loaded.groupBy("source_file").agg(F.count("*").alias("rows_read"), F.max(F.xxhash64(*[F.col(f"`{c}`") for c in loaded.columns])).alias("_all"))
    stated = loaded.sparkSession.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(*([pattern] if isinstance(pattern, str) else pattern))
    stated = stated.select(_stem().alias("source_file")).groupBy("source_file").agg(F.count("*").alias("rows_stated"))
    # The digest makes the count read every column.
    found = stated.join(counted.where("_all IS NOT NULL"), "source_file", "left")
    rows = F.coalesce("rows_read", F.lit(0)).alias("rows_read")
    return found.select("source_file", "rows_stated", rows).where(F.col("rows_read") < F.col("rows_stated"))


def load_symbols(bars: DataFrame, symbols: Sequence[str], start: str, end: str) -> DataFrame:
    """Bars of several symbols in a time range; an unknown symbol has no rows."""
    stamp = lambda s: F.lit(s).cast("timestamp")
    return bars.where(F.col("symbol").isin(*symbols) & F.col("timestamp").between(stamp(start), stamp(end)))
