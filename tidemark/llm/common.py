"""Helpers the operators of this package share."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root

BLOCK_BYTES = 2 << 20  # of text that a task turns into Python objects at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new folder in the shared checkpoint folder and read it from there.

    Later steps read the same rows however often they run, also after executors were lost.
    """
    path = f"{checkpoint_root(df.sparkSession)}/tidemark-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back(*frames: DataFrame) -> None:
    """Delete the folders of tables that :func:`stored` wrote, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        for path in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/tidemark-llm/" in path:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def partitions(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def texts(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def blocks(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes of text, one row at least, to bound what a task holds."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= limit or i == len(sizes) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def in_blocks(batches: Batches, limit: int = BLOCK_BYTES) -> Batches:
    """The rows of batches in smaller ones of about ``limit`` bytes of text."""
    for batch in batches:
        for a, b in blocks(batch.column("text"), limit):
            yield batch.slice(a, b - a)


def scratch_root() -> str | None:
    """Where a task may spill: the folders Spark assigns to executors for shuffle and spill
    files. A spill belongs to one task, is deleted with it and is written anew by a retry."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


def kept_by_worker(name: str, make: Callable[[], object]):
    """A value that a Python worker builds once and keeps between tasks.

    Functions of this library travel to the workers with each task, module variables too, so
    what is to outlive a task hangs on a module of its own.
    """
    store = sys.modules.setdefault("_tidemark_worker", types.ModuleType("_tidemark_worker")).__dict__
    if name not in store:
        store[name] = make()
    return store[name]


class Remembered(dict):
    """Values by text. Beyond ``most`` entries all become old; old ones are dropped when not used again."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most = most
        self.old: dict = {}

    def missing(self, rows: list[list]) -> list:
        """Those entries of the rows that have no value; old values become new again."""
        new, old = [], self.old
        for k in set().union(*rows).difference(self):
            found = old.get(k)
            if found is None:
                new.append(k)
            else:
                self[k] = found
        return new

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


Batches = Iterator[pa.RecordBatch]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
