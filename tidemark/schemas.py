"""Column names and types shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["symbol", "interval"]
PRICES = ["open", "high", "low", "close"]
BAR_VALUES = [*PRICES, "volume"]

BARS = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("interval", T.StringType(), False),
        *[T.StructField(c, T.DoubleType(), True) for c in BAR_VALUES],
    ]
)
