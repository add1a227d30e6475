"""Session settings the library relies on."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

# Time stamps are UTC everywhere; AQE re-plans joins from measured sizes; streams with timers keep their state in RocksDB.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus: str = "*", partitions: int = 8, memory: str = "8g", checkpoint: str | None = None) -> SparkSession:
    """A single-machine session for tests and benchmarks; ``checkpoint`` is the folder for intermediate results."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    if checkpoint:
        builder = builder.config("spark.checkpoint.dir", checkpoint)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate results.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder
    inside the warehouse serves, which all executors reach as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def drop_unused(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of steps that no frame refers to any more.

    It does so in the background, after the driver collected its garbage, which a driver with much memory seldom does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
