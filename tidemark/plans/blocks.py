"""Ordered calculations on series of any length.

A window partitioned by symbol puts a whole series into one task, which fails
when one symbol holds a large share of all rows. Everything ordered in this
library therefore runs on *blocks*: runs of ``BLOCK_ROWS`` consecutive rows of
one series. Three tools cover the indicators:

* fixed-width windows read a few neighbouring rows, so each block receives a
  copy of its neighbours' border rows (:func:`with_rows`);
* running sums, minima and maxima add the total of all earlier blocks
  (:func:`running`);
* first-order recurrences ``y = a * y_prev + b`` add the decayed carry of all
  earlier blocks (:func:`recurrences`).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.schemas import KEYS

BLOCK_ROWS = 4096
FAN_OUT = 4096
SUB_ROWS = 512

_UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "M": 2592000}


def interval_seconds(interval: Column) -> Column:
    """Length of an interval label such as ``15m`` in seconds; other labels raise."""
    unit = F.regexp_extract(interval, r"([smhdwM])$", 1)
    size = F.regexp_extract(interval, r"^(\d+)", 1).try_cast("long")
    seconds = F.create_map(*[F.lit(x) for pair in _UNIT_SECONDS.items() for x in pair])
    unknown = F.raise_error(F.concat(F.lit("no interval label such as 15m: "), F.coalesce(interval, F.lit("NULL")))).cast("long")
    return F.coalesce(F.try_element_at(seconds, unit) * size, unknown)


def bar_bucket(timestamp: str = "timestamp", interval: str = "interval") -> Column:
    """Time bucket of at most ``BLOCK_ROWS`` bars: one bar per interval step."""
    return F.floor(F.unix_seconds(F.col(timestamp)) / (interval_seconds(F.col(interval)) * BLOCK_ROWS))


def time_bucket(timestamp: str, seconds: float) -> Column:
    """Time bucket for series that are not bars; choose seconds by their rate."""
    return F.floor(F.unix_micros(F.col(timestamp)) / F.lit(int(seconds * 1_000_000)))


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if kind == "max" else F.least(a, b)


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def prefix(table: DataFrame, keys: Sequence[str], index: str, kinds: Mapping[str, str]) -> DataFrame:
    """Replace each value by the total over all earlier indices of its key.

    Works in two levels, so the ordered window of one key never holds more than
    ``FAN_OUT`` rows, or one row per ``FAN_OUT`` indices.
    """
    keys = list(keys)
    up = table.withColumn("_sup", F.floor(F.col(index) / FAN_OUT))
    before = lambda part, order: (
        Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    tops = up.groupBy(*keys, "_sup").agg(*[_AGG[k](c).alias(c) for c, k in kinds.items()])
    w_top = before(keys, "_sup")
    tops = tops.select(*keys, "_sup", *[_AGG[k](c).over(w_top).alias(f"_top_{c}") for c, k in kinds.items()])
    w_low = before([*keys, "_sup"], index)
    low = up.select(
        *keys, "_sup", index, *[_AGG[k](c).over(w_low).alias(f"_low_{c}") for c, k in kinds.items()]
    )
    return low.join(tops, [*keys, "_sup"]).select(
        *keys, index, *[_combine(k, F.col(f"_top_{c}"), F.col(f"_low_{c}")).alias(c) for c, k in kinds.items()]
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("timestamp",),
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``_rn``, the 1-based position of a row in its series.

    Rows are counted per time bucket, the counts are summed over earlier
    buckets, and positions inside a bucket are added. A frame that already has
    ``_rn`` is returned as it is, so numbered bars can be stored once.
    """
    if "_rn" in df.columns:
        return df
    keys = list(keys)
    timed = df.withColumn("_bkt", bar_bucket() if bucket is None else bucket)
    counts = timed.groupBy(*keys, "_bkt").agg(F.count("*").alias("_off"))
    offsets = prefix(counts, keys, "_bkt", {"_off": "sum"})
    inside = Window.partitionBy(*keys, "_bkt").orderBy(*order)
    return (
        timed.withColumn("_i", F.row_number().over(inside))
        .join(offsets, [*keys, "_bkt"])
        .withColumn("_rn", F.col("_off") + F.col("_i"))
        .drop("_bkt", "_i", "_off")
    )


def over(before: int | None = None, after: int = 0, keys: Sequence[str] = KEYS) -> str:
    """SQL text of the shared window. Text builds wide tables faster than column objects,
    each of which costs several calls into the JVM."""
    frame = "" if before is None else f" ROWS BETWEEN {_bound(-before)} AND {_bound(after)}"
    return f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _blk ORDER BY _rn{frame})"


def _bound(offset: int) -> str:
    return f"{abs(offset)} {'PRECEDING' if offset <= 0 else 'FOLLOWING'}"


def rows(before: int | None = None, after: int = 0, keys: Sequence[str] = KEYS) -> WindowSpec:
    """The shared window of a block; ``before`` rows back to ``after`` rows ahead."""
    spec = Window.partitionBy(*keys, "_blk").orderBy("_rn")
    return spec if before is None else spec.rowsBetween(-before, after)


def with_rows(
    df: DataFrame,
    stages: Sequence[Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    block_rows: int | None = None,
    number: Mapping | None = None,
) -> DataFrame:
    """Evaluate window columns block by block.

    ``stages`` are dictionaries of name to column; a later stage may use the
    names of an earlier one. ``back`` and ``ahead`` are the rows of context the
    stages need in total. The result keeps ``_rn`` and ``_blk``.
    """
    size = block_rows or BLOCK_ROWS
    if back > size or ahead > size:
        raise ValueError(f"context of {max(back, ahead)} rows exceeds the block of {size} rows")
    frame = number_rows(df, keys, **(number or {}))
    position = (F.col("_rn") - 1) % size
    home = F.floor((F.col("_rn") - 1) / size)
    copies = [home]
    if back:
        copies.append(F.when(position >= size - back, home + 1))
    if ahead:
        copies.append(F.when((position < ahead) & (home > 0), home - 1))
    if len(copies) > 1:
        frame = frame.withColumn("_blk", F.explode(F.array_compact(F.array(*copies))))
    else:
        frame = frame.withColumn("_blk", home)
    frame = frame.withColumn("_home", F.col("_blk") == home)
    for stage in stages:
        frame = frame.select("*", *[column.alias(name) for name, column in stage.items()])
    return frame.where("_home").drop("_home")


def plain(df: DataFrame) -> DataFrame:
    """Drop the position columns."""
    return df.drop("_rn", "_blk")


def running(df: DataFrame, aggregates: Mapping[str, tuple[str, Column]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` from the start of each series.

    ``df`` comes from :func:`with_rows`. ``aggregates`` maps a name to a kind
    and a column.
    """
    keys = list(keys)
    kinds = {name: kind for name, (kind, _) in aggregates.items()}
    totals = df.groupBy(*keys, "_blk").agg(*[_AGG[k](c).alias(n) for n, (k, c) in aggregates.items()])
    carry = prefix(totals, keys, "_blk", kinds)
    carry = carry.select(*keys, "_blk", *[F.col(n).alias(f"_c_{n}") for n in aggregates])
    so_far = Window.partitionBy(*keys, "_blk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    local = df.select("*", *[_AGG[k](c).over(so_far).alias(f"_l_{n}") for n, (k, c) in aggregates.items()])
    return local.join(carry, [*keys, "_blk"]).select(
        *[F.col(c) for c in df.columns],
        *[_combine(k, F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, k in kinds.items()],
    )


def _fold(decays: dict[str, float], index: str, start: bool):
    """Arrow function: exclusive fold ``c = decay * c + s`` over one ordered group."""
    names = list(decays)
    factor = np.array([decays[n] for n in names])

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by(index)
        steps = np.column_stack([table[n].to_numpy() for n in names])
        state = np.array([table[f"_s_{n}"][0].as_py() for n in names]) if start else np.zeros(len(names))
        out = np.empty_like(steps)
        for i in range(len(steps)):
            out[i] = state
            state = factor * state + steps[i]
        for j, name in enumerate(names):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(out[:, j]))
        return table.drop_columns([f"_s_{n}" for n in names]) if start else table

    return apply


def recurrences(
    df: DataFrame,
    specs: Mapping[str, tuple[Column, float]],
    keys: Sequence[str] = KEYS,
    block_rows: int | None = None,
) -> DataFrame:
    """First-order recurrences ``y = a * y_prev + b`` with constant ``a`` in [0, 1).

    ``specs`` maps a name to ``(b, a)``. From the first missing ``b`` of a series on, ``y`` is missing:
    it travels as NaN through all sums. Inside a run of ``SUB_ROWS`` rows the
    solution is a scaled running sum, ``a**i * sum(b_j * a**-j)``, evaluated by
    a window; runs are short enough for ``a**-j`` to stay finite. The value at
    the start of each run comes from a table with one row per run.
    """
    keys = list(keys)
    decays = {name: a for name, (_, a) in specs.items()}
    live = {n: a for n, a in decays.items() if a > 0}
    length = SUB_ROWS
    while length > 1 and (
        (block_rows or BLOCK_ROWS) % length or any(-math.log10(a) * length > 250 for a in live.values())
    ):
        length //= 2
    frame = df.select(
        "*",
        *[F.coalesce(b.cast("double"), F.lit(float("nan"))).alias(f"_b_{n}") for n, (b, _) in specs.items()],
        ((F.col("_rn") - 1) % length).alias("_pos"),
        F.floor((F.col("_rn") - 1) / length).alias("_sub"),
    )
    part = ", ".join(f"`{k}`" for k in [*keys, "_blk", "_sub"])
    past = f"OVER (PARTITION BY {part} ORDER BY _rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    local = frame.select(
        "*", *[F.expr(f"sum(_b_{n} * pow({a!r}D, -_pos)) {past} AS _l_{n}") for n, a in live.items()]
    )
    if live:
        runs = frame.groupBy(*keys, "_blk", "_sub").agg(
            *[F.expr(f"sum(_b_{n} * pow({a!r}D, {length - 1} - _pos)) AS {n}") for n, a in live.items()]
        )
        carry = _carry(runs, keys, {n: a**length for n, a in live.items()})
        # One row per block, so the join keeps the partitioning of the blocks.
        carry = carry.groupBy(*keys, "_blk").agg(
            F.map_from_entries(F.collect_list(F.struct("_sub", F.struct(*live)))).alias("_carry")
        )
        local = local.join(carry, [*keys, "_blk"]).withColumn("_start", F.col("_carry")[F.col("_sub")])
    solved = {n: f"_b_{n}" for n in decays} | {
        n: f"pow({a!r}D, _pos) * _l_{n} + pow({a!r}D, _pos + 1) * _start.{n}" for n, a in live.items()
    }
    return local.select(*df.columns, *[F.expr(f"nullif({e}, double('NaN')) AS {n}") for n, e in solved.items()])


def _carry(runs: DataFrame, keys: list[str], decays: dict[str, float]) -> DataFrame:
    """Value of each recurrence just before every run, in two levels."""
    names = list(decays)
    types = dict(runs.dtypes)
    schema = lambda *index: ", ".join(
        [f"`{k}` {types[k]}" for k in keys] + [f"{i} long" for i in index] + [f"{n} double" for n in names]
    )
    up = runs.withColumn("_sup", F.floor(F.col("_sub") / FAN_OUT))
    tops = up.groupBy(*keys, "_sup").agg(
        *[
            F.sum(F.col(n) * F.pow(F.lit(d), FAN_OUT - 1 - F.col("_sub") % FAN_OUT)).alias(n)
            for n, d in decays.items()
        ]
    )
    tops = tops.groupBy(*keys).applyInArrow(
        _fold({n: d**FAN_OUT for n, d in decays.items()}, "_sup", False), schema("_sup")
    )
    tops = tops.select(*keys, "_sup", *[F.col(n).alias(f"_s_{n}") for n in names])
    low = up.join(tops, [*keys, "_sup"]).select(
        *keys, "_sup", "_blk", "_sub", *names, *[f"_s_{n}" for n in names]
    )
    return low.groupBy(*keys, "_sup").applyInArrow(_fold(decays, "_sub", True), schema("_sup", "_blk", "_sub"))
