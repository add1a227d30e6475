"""Building bars from ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bars_from_ticks(
    ticks: DataFrame, symbol: Column, timestamp: Column, value: Column, order: Column, interval: str
) -> DataFrame:
    """Open, high, low, close and tick count per symbol and time step.

    All aggregates combine on the map side, so a busy symbol does not gather
    its ticks in one task. ``order`` breaks ties between ticks of one step.
    """
    unit = {"h": "hour", "d": "day", "m": "minute"}[interval[-1]]
    cells = ticks.select(
        symbol.alias("symbol"),
        F.lit(interval).alias("interval"),
        F.date_trunc(unit, timestamp).alias("timestamp"),
        value.cast("double").alias("_v"),
        order.alias("_o"),
    )
    return cells.groupBy("symbol", "interval", "timestamp").agg(
        F.min_by("_v", "_o").alias("open"),
        F.max("_v").alias("high"),
        F.min("_v").alias("low"),
        F.max_by("_v", "_o").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
