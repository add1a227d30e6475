"""Raw candlestick arrays: decoding and row rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import BAR_VALUES

# Slot order of the raw array.
SLOTS = [
    "timestamp", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume",
    "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume", "ignore",
]
MIN_SLOTS = 11


def slot(raw: Column, name: str) -> Column:
    return F.try_element_at(raw, F.lit(SLOTS.index(name) + 1))


def number(raw: Column, name: str) -> Column:
    return slot(raw, name).try_cast("double")


def decode(landed: DataFrame, value: str = "value", symbol: str = "symbol", interval: str = "interval") -> DataFrame:
    """Text rows holding one JSON array each → bars; a bad number becomes missing."""
    raw = F.from_json(F.col(value), "array<string>")
    framed = landed.select(symbol, interval, raw.alias("_raw"))
    return framed.select(
        F.timestamp_millis(slot(F.col("_raw"), "timestamp").try_cast("long")).alias("timestamp"),
        F.col(symbol).alias("symbol"),
        F.col(interval).alias("interval"),
        *[number(F.col("_raw"), c).alias(c) for c in BAR_VALUES],
    )


def broken_rules(raw: Column) -> Column:
    """Names of the rules a raw array breaks, in checking order."""
    o, h, lo, c, v = (number(raw, n) for n in BAR_VALUES)
    ts = slot(raw, "timestamp").try_cast("long")
    short = raw.isNull() | (F.size(raw) < MIN_SLOTS)
    unreadable = ts.isNull() | o.isNull() | h.isNull() | lo.isNull() | c.isNull() | v.isNull()
    rules = {
        "format": short,
        "number": ~short & unreadable,
        "timestamp": ts <= 0,
        "open_range": (o < lo) | (o > h),
        "close_range": (c < lo) | (c > h),
        "negative_volume": v < 0,
        "non_positive_price": F.least(o, h, lo, c) <= 0,
    }
    return F.array_compact(F.array(*[F.when(test, name) for name, test in rules.items()]))


def validate(landed: DataFrame, value: str = "value") -> DataFrame:
    """Add ``broken``, the list of broken rules per row; empty means valid."""
    return landed.withColumn("broken", broken_rules(F.from_json(F.col(value), "array<string>")))


def require_valid(landed: DataFrame, value: str = "value") -> DataFrame:
    """The frame itself, or an error that counts the rows breaking a rule."""
    checked = validate(landed, value)
    counts = checked.agg(F.count("*").alias("n"), F.count_if(F.size("broken") > 0).alias("bad")).first()
    if counts["n"] == 0:
        raise ValueError("no candlestick rows")
    if counts["bad"]:
        raise ValueError(f"{counts['bad']} candlestick rows break a rule")
    return landed
