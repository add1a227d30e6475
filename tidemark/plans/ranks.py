"""Cumulative counts over values of large groups, and ranks among earlier values.

:func:`cumulative` sorts the values of all groups into ranges by Spark's range
partitioning, as many as their number asks for; each range is summed on its own and
receives the total of all lower ranges.

:func:`prefix_ranks` ranks every value among those before it in its series. That is a count in
two directions, time and value, so rows are cut both ways: into ranges of the value and into blocks of time.
Earlier smaller values of the same range are counted inside the range; those of lower ranges
inside the block, plus a table of one number per block and range for all earlier blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import prefix
from tidemark.plans.quantiles import attach
from tidemark.session import cut_lineage

RANGE_ROWS = 1 << 20  # values that are summed in one task
CELL_ROWS = 1 << 16  # values that are ranked in one task


def value_ranges(df: DataFrame, keys: Sequence[str], value: str, ranges: int) -> DataFrame:
    """Stored ``df`` with ``_blk``: ranges of ``value`` that rise in each group.

    ``df`` has one row per (keys, value), so ranges of nearly equal size can be cut anywhere. The
    bounds are sampled, hence the result is stored: a second run could cut elsewhere.
    """
    return cut_lineage(df.repartitionByRange(ranges, *keys, value).withColumn("_blk", F.spark_partition_id().cast("long")))


def cumulative(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column], ranges: int | None = None
) -> DataFrame:
    """Add running sums over all rows with a value up to this row's.

    ``df`` has one row per (keys, value). Without ``keys`` it is one group.
    """
    keys = list(keys)
    if ranges is None:
        df = cut_lineage(df)
        ranges = -(-df.count() // RANGE_ROWS)
    if ranges <= 1:
        so_far = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(so_far).alias(n) for n, c in sums.items()])
    placed = value_ranges(df, keys, value, ranges)
    totals = placed.groupBy(*keys, "_blk").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    carry = prefix(totals, keys, "_blk", dict.fromkeys(sums, "sum"))
    carry = carry.select(*keys, "_blk", *[F.col(n).alias(f"_c_{n}") for n in sums])
    w = Window.partitionBy(*keys, "_blk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", *[F.sum(c).over(w).alias(f"_l_{n}") for n, c in sums.items()])
    return local.join(carry, [*keys, "_blk"]).select(
        *df.columns, *[(F.col(f"_c_{n}") + F.col(f"_l_{n}")).alias(n) for n in sums]
    )


def earlier_less(values: np.ndarray) -> np.ndarray:
    """For each value the number of smaller ones before it, one bit of the rank after the other."""
    rank = np.unique(values, return_inverse=True)[1]
    less = np.zeros(len(rank), np.int64)
    at = np.arange(len(rank))  # positions by the upper bits of the rank, then in order
    for bit in reversed(range(int(rank.max(initial=0)).bit_length())):
        r = rank[at]
        one = (r >> bit) & 1 == 1
        upper = r >> (bit + 1)
        first = np.append(True, upper[1:] != upper[:-1])
        zeros = np.cumsum(~one)
        before = (zeros - ~one)[first][np.cumsum(first) - 1]
        less[at[one]] += (zeros - before)[one]
        at = at[np.argsort(r >> bit, kind="stable")]
    return less


def _rank_rows(by: str):
    """Arrow function: rows of one group in order of ``_at`` with ``_seen`` and ``_less``, ranked by ``by``."""

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("_at")
        less = earlier_less(table[by].to_numpy())
        keep = table.drop_columns(["_v"])
        return keep.append_column("_seen", pa.array(np.arange(1, len(less) + 1))).append_column("_less", pa.array(less))

    return apply


def prefix_ranks(
    df: DataFrame, keys: Sequence[str], order: str, value: str, cell_rows: int | None = None
) -> DataFrame:
    """Table (keys, ``order``, ``_seen``, ``_less``): of the values up to this row's their number, and how many are smaller.

    ``order`` numbers the rows of a series from 1 without repeats. Missing values are not counted and get no row.
    A value that holds a large share of a series makes up a range of its own, whose rows need no comparison.
    The table between blocks and ranges has (n / ``cell_rows``)² numbers: as many as rows at 4e9 rows a series.
    """
    keys, size = list(keys), cell_rows or CELL_ROWS
    rows = cut_lineage(
        df.where(F.col(value).isNotNull()).select(*keys, F.col(order).cast("long").alias("_at"), F.col(value).cast("double").alias("_v"))
    )
    types = dict(rows.dtypes)
    schema = lambda *names: ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{n} long" for n in names])
    named = [*keys, F.col("_at").alias(order), "_seen", "_less"]
    most = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranges = -(-most // size)
    if ranges <= 1:
        return rows.groupBy(*keys).applyInArrow(_rank_rows("_v"), schema("_at", "_seen", "_less")).select(named)

    probs = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    cuts = cut_lineage(rows.groupBy(*keys).agg(F.expr(f"array_distinct(percentile_approx(_v, array({probs}), {10 * ranges})) AS cuts")))
    steps = [1 << b for b in reversed(range(ranges.bit_length()))]
    # Binary search: the number of cuts below the value. Even cells lie between cuts, odd ones hold a cut itself.
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda p, s: F.when(F.coalesce(F.get(F.col("_s.cuts"), p + s - 1) < F.col("_v"), F.lit(False)), p + s).otherwise(p),
    )
    near_cut = attach(rows, cuts, keys).select(*keys, "_at", "_v", F.col("_s.cuts").alias("_cuts"), found.alias("_k"))
    on_cut = F.coalesce(F.get(F.col("_cuts"), F.col("_k")) == F.col("_v"), F.lit(False)).cast("long")
    placed = cut_lineage(near_cut.select(
        *keys, "_at", "_v", (2 * F.col("_k") + on_cut).cast("long").alias("_cell"), F.floor((F.col("_at") - 1) / size).alias("_blk")
    ))
    inside = placed.where("_cell % 2 = 0").groupBy(*keys, "_cell").applyInArrow(_rank_rows("_v"), schema("_at", "_cell", "_blk", "_seen", "_less"))
    inside = inside.select(*keys, "_at", F.col("_less").alias("_same"))
    block = placed.groupBy(*keys, "_blk").applyInArrow(_rank_rows("_cell"), schema("_at", "_cell", "_blk", "_seen", "_less"))

    cells = 2 * ranges

    def below(table: pa.Table) -> pa.Table:
        """Values of a block in lower cells, for every cell there is."""
        counts = np.bincount(table["_cell"].to_numpy(), table["n"].to_numpy(), cells).astype(np.int64)
        head = {k: pa.array([table[k][0].as_py()] * cells, table.schema.field(k).type) for k in keys}
        blocks = pa.array(np.full(cells, table["_blk"][0].as_py(), np.int64))
        return pa.table(head | {"_blk": blocks, "_cell": pa.array(np.arange(cells)), "_low": pa.array(np.cumsum(counts) - counts)})

    counts = placed.groupBy(*keys, "_blk", "_cell").agg(F.count("*").alias("n"))
    lower = prefix(counts.groupBy(*keys, "_blk").applyInArrow(below, schema("_blk", "_cell", "_low")), [*keys, "_cell"], "_blk", {"_low": "sum"})
    passed = prefix(counts.groupBy(*keys, "_blk").agg(F.sum("n").alias("_past")), keys, "_blk", {"_past": "sum"})
    whole = block.join(lower, [*keys, "_blk", "_cell"]).join(passed, [*keys, "_blk"]).join(inside, [*keys, "_at"], "left")
    return whole.select(
        *keys, F.col("_at").alias(order), (F.col("_seen") + F.col("_past")).alias("_seen"),
        (F.col("_less") + F.col("_low") + F.coalesce("_same", F.lit(0))).alias("_less"),
    )
