"""Indicators on a stream of bars, with one small state per series.

Exponential averages, MACD, RSI and parabolic SAR need only their last values to go on, so a series keeps a
dozen numbers, however long it runs. Bars wait until the watermark has passed them and are taken in
order of time, so the columns equal those of the batch operators over all bars that did not come too late.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators.indicators import sar_step
from tidemark.schemas import BAR_VALUES, KEYS
from tidemark.session import SETTINGS

OUT_ROWS = 10_000  # rows of one output frame
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
SAR = ["stop", "side", "pace", "extreme"]


def _average(before: float | None, value: float | None, n: int, first: bool) -> float | None:
    """Next exponential average: seeded with the first value, missing from the first missing value on."""
    if first or before is None or value is None:
        return value if first else None
    alpha = 2.0 / (n + 1)
    return alpha * value + (1.0 - alpha) * before


class IndicatorMachine(StatefulProcessor):
    """State of one series: bars that wait, and the last value of every indicator.

    A timer is set for the earliest bar of each batch and, once it fires, for the earliest that still waits.
    """

    def __init__(self, periods: Sequence[int], macd: tuple[int, int, int], rsi: int, sar: tuple[float, float]) -> None:
        self.periods, self.macd, self.rsi, self.sar = list(periods), macd, rsi, sar
        self.averages = [f"EMA_{n}" for n in self.periods] + ["fast", "slow", "signal"]
        self.fields = ["seen", "close", "gain", "loss", *self.averages, *SAR]

    @property
    def columns(self) -> list[str]:
        return [*self.averages[:-3], "MACD", "MACD_Signal", "MACD_Histogram", f"RSI_{self.rsi}", "Parabolic_SAR"]

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us bigint, " + ", ".join(f"{c} double" for c in BAR_VALUES))
        kinds = {"seen": "bigint", "side": "int"}
        self.last = handle.getValueState("last", ", ".join(f"{f} {kinds.get(f, 'double')}" for f in self.fields))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            values = [[None if pd.isna(v) else float(v) for v in batch[c]] for c in BAR_VALUES]
            new = list(zip(batch["us"].tolist(), *values, strict=True))
            self.waiting.appendList(new)
            self.handle.registerTimer(min(row[0] for row in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (due if row[0] < now else later).append(tuple(row))
        if not due:
            return
        due.sort(key=lambda row: row[0])
        state = dict(zip(self.fields, self.last.get(), strict=True)) if self.last.exists() else dict.fromkeys(self.fields) | {"seen": 0, "gain": 0.0, "loss": 0.0}
        for part in batched(due, OUT_ROWS):
            found = [self._next(state, dict(zip(BAR_VALUES, row[1:], strict=True))) for row in part]
            frame = pd.DataFrame([row[1:] for row in part], columns=BAR_VALUES, dtype="float64")
            frame = pd.concat([frame, pd.DataFrame(found, columns=self.columns, dtype="float64")], axis=1)
            frame.insert(0, "timestamp", pd.to_datetime([row[0] for row in part], unit="us"))
            for i, name in enumerate(KEYS):
                frame.insert(i, name, key[i])
            yield frame
        self.last.update(tuple(state[f] for f in self.fields))
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(row[0] for row in later) // 1000 + 1)
        else:
            self.waiting.clear()

    def _next(self, state: dict, bar: dict) -> list[float | None]:
        """Values at the next bar; ``state`` moves on."""
        close, first = bar["close"], state["seen"] == 0
        state["seen"] += 1
        fast, slow, signal = self.macd
        for name, n in zip(self.averages, [*self.periods, fast, slow], strict=False):
            state[name] = _average(state[name], close, n, first)
        line = None if state["fast"] is None or state["slow"] is None else state["fast"] - state["slow"]
        state["signal"] = _average(state["signal"], line, signal, first)
        gap = None if line is None or state["signal"] is None else line - state["signal"]

        # A change from or to a missing value is none. Up to row n + 1 gains and losses are summed, then smoothed.
        n, row = self.rsi, state["seen"]
        change = 0.0 if close is None or state["close"] is None else close - state["close"]
        for name, moved in (("gain", max(change, 0.0)), ("loss", max(-change, 0.0))):
            state[name] = state[name] + moved if row <= n + 1 else state[name] * (1 - 1 / n) + moved / n
            if row == n + 1:
                state[name] /= n
        state["close"] = close
        strength = None
        if row > n:
            strength = 100.0 if state["loss"] == 0 else 100 - 100 / (1 + state["gain"] / state["loss"])

        stop, after = sar_step({f: state[f] for f in SAR}, bar["high"], bar["low"], *self.sar)
        state.update(after)
        return [*(state[f] for f in self.averages[:-3]), line, state["signal"], gap, strength, stop]

    def close(self) -> None:
        pass


def indicators(
    bars: DataFrame, periods: Sequence[int] = (12, 26), macd: tuple[int, int, int] = (12, 26, 9), rsi: int = 14,
    sar: tuple[float, float] = (0.02, 0.2), lateness: str = "10 minutes",
) -> DataFrame:
    """A stream of bars with ``EMA_n``, ``MACD``, ``MACD_Signal``, ``MACD_Histogram``, ``RSI_n`` and ``Parabolic_SAR``.

    Bars may arrive out of order by up to ``lateness``; later ones are left out. A row appears once the
    watermark has passed its bar. Missing values do what they do in the batch operators, NaN counts as missing; further columns are
    ignored. A task holds the bars of one series that wait, so the size of a trigger and ``lateness`` bound its
    memory. Needs the RocksDB state store, which the session settings of this library name.
    """
    if min(*periods, *macd, rsi) <= 0:
        raise ValueError("window must be positive")
    if macd[0] >= macd[1]:
        raise ValueError("fast period must be less than slow period")
    machine = IndicatorMachine(periods, macd, rsi, sar)
    timed = bars.withWatermark("timestamp", lateness)
    rows = timed.select("timestamp", *KEYS, *[F.col(c).cast("double").alias(c) for c in BAR_VALUES], F.unix_micros("timestamp").alias("us"))
    schema = ", ".join([*(f"{k} string" for k in KEYS), "timestamp timestamp", *(f"{c} double" for c in [*BAR_VALUES, *machine.columns])])
    return rows.groupBy(*KEYS).transformWithStateInPandas(
        statefulProcessor=machine, outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


def backfill(stored: DataFrame, folder: str, slices: int = 2, lateness: str = "10 minutes", **options) -> DataFrame:
    """The rows of :func:`indicators` for stored bars, taken as a stream of ``slices`` spans of time.

    ``folder`` is a new, shared one. It keeps the bars (``in``), the result (``out``) and the state (``state``) with
    which a live query goes on. Every span is a run of its own that starts from the state of the one before, so a task holds
    the bars of one series and span. A bar without a series, behind all others, moves the watermark past the last one.
    """
    spark = stored.sparkSession
    first, last = stored.agg(F.min("timestamp"), F.max(F.col("timestamp") + F.expr(f"INTERVAL {lateness}") + F.expr("INTERVAL 1 SECOND"))).first()
    columns = ["timestamp", *KEYS, *BAR_VALUES]
    stamp = lambda at: F.lit(at).cast("timestamp")
    empty = {k: F.lit("") for k in KEYS} | {c: F.lit(None).cast("double") for c in BAR_VALUES}
    bars = stored.select(*columns)
    span = None if first is None else (last - first) / slices
    if span:
        bars = bars.unionByName(spark.range(1).select(stamp(last).alias("timestamp"), *[v.alias(n) for n, v in empty.items()]))
    kept = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, SETTINGS[PROVIDER])
    try:
        for i in range(slices):
            part = bars if span is None else bars.where(F.col("timestamp") >= stamp(first + i * span))
            part = part if span is None or i == slices - 1 else part.where(F.col("timestamp") < stamp(first + (i + 1) * span))
            part.write.mode("append").parquet(f"{folder}/in")
            stream = spark.readStream.schema(bars.schema).parquet(f"{folder}/in")
            rows = indicators(stream, lateness=lateness, **options)
            writer = rows.writeStream.option("checkpointLocation", f"{folder}/state")
            query = writer.outputMode("append").trigger(availableNow=True).start(f"{folder}/out", format="parquet")
            query.awaitTermination()
    finally:
        spark.conf.set(PROVIDER, kept)
    return spark.read.schema(rows.schema).parquet(f"{folder}/out").where(F.col(KEYS[0]) != "")
