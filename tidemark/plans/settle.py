"""State machines over long series, in a logarithmic number of passes.

Some indicators carry a state that no formula can jump over. Rows are laid out once, one row per
block of a series. Each block is walked on its own from an assumed start; then blocks whose start was not the end of
the block before are walked again. States usually agree after one such pass, because most machines forget
their start. Where they do not, the next pass walks runs of two blocks, then of four, and so on: inside a run every block
starts from the end of the one before, and a block whose start did not change is jumped over. A run
as long as the series is the plain walk over it, so the result equals that walk in every case, after
at most about log2 of the number of blocks passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

from tidemark.schemas import KEYS
from tidemark.session import cut_lineage

Walk = Callable[[pa.Table, dict | None], tuple[list, dict]]


def settle(
    df: DataFrame,
    walk: Walk,
    state_schema: str,
    name: str,
    value_type: str,
    inputs: Sequence[str],
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Add column ``name`` computed by ``walk`` over each series of a block frame.

    ``walk`` takes one block ordered by position and the state before it (None
    at the start of the series) and returns one value per row and the state
    after it.
    """
    keys = list(keys)
    states, _ = settled_states(df.select(*keys, "_blk", "_rn", *inputs), walk, state_schema, keys)

    out_schema = StructType([*df.schema.fields, StructField(name, DataType.fromDDL(value_type))])
    arrow_schema = _nullable(to_arrow_schema(out_schema))

    def emit(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rn")
        state = table["_state"][0].as_py()
        values, _ = walk(table, state)
        table = table.append_column(arrow_schema.field(name), pa.array(values, arrow_schema.field(name).type))
        # The cast settles time zone labels, which follow the session's spelling of UTC.
        return table.select(arrow_schema.names).cast(arrow_schema)

    if states is None:
        carried = df.withColumn("_state", F.lit(None).cast(f"struct<{_struct(state_schema)}>"))
    else:
        carried = df.join(states, [*keys, "_blk"], "left")
    carried = carried.select(*df.columns, "_state")
    return carried.groupBy(*keys, "_blk").applyInArrow(emit, out_schema)


def _nullable(schema: pa.Schema) -> pa.Schema:
    return pa.schema([field.with_nullable(True) for field in schema])


def _struct(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (part.split() for part in ddl.split(", ")))


def _walk_runs(batches: Iterator[pa.RecordBatch], walk: Walk, keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """New start and end of the blocks of each run; rows are sorted by series and block, with known starts and ends.

    The first block of a run starts from the end of the block before it, as known so far.
    """
    run, state = None, None
    for batch in batches:
        known = batch.select([c for c in batch.schema.names if c != "_rows"]).to_pylist()
        out = []
        for i, row in enumerate(known):
            here = (*[row[k] for k in keys], row["_run"])
            if here != run:
                run, state = here, row["_prev"]
            start = state
            if row["_walked"] and start == row["_start"]:
                state = row["_end"]
            else:
                rows = batch.column("_rows").slice(i, 1).flatten()
                _, state = walk(pa.Table.from_batches([pa.RecordBatch.from_struct_array(rows)]), start)
            out.append({k: row[k] for k in keys} | {"_blk": row["_blk"], "_start": start, "_end": state})
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def settled_states(slim: DataFrame, walk: Walk, state_schema: str, keys: Sequence[str] = KEYS) -> tuple[DataFrame | None, int]:
    """State before every block as ``_state`` (None if all series fit one block), and the number of passes."""
    keys = list(keys)
    if slim.where("_blk > 0").isEmpty():
        return None, 0
    state = f"struct<{_struct(state_schema)}>"
    at = [*keys, "_blk"]
    inputs = [c for c in slim.columns if c not in at]
    ordered = F.array_sort(F.collect_list(F.struct("_rn", *[c for c in inputs if c != "_rn"])))
    # One row per block; passes read only the blocks of the runs they walk.
    laid = cut_lineage(slim.groupBy(*at).agg(ordered.alias("_rows")))
    out_schema = laid.select(*at).schema.add("_start", DataType.fromDDL(state)).add("_end", DataType.fromDDL(state))
    arrow_schema = _nullable(to_arrow_schema(out_schema))

    def walked(rows: DataFrame) -> DataFrame:
        return rows.mapInArrow(lambda batches: _walk_runs(batches, walk, keys, arrow_schema), out_schema)

    unknown = F.lit(None).cast(state)
    alone = laid.select(*at, "_rows", F.col("_blk").alias("_run"), unknown.alias("_prev"), unknown.alias("_start"), unknown.alias("_end"), F.lit(False).alias("_walked"))
    known = cut_lineage(walked(alone))
    width, passes = 1, 1
    while True:
        before = known.select(*keys, (F.col("_blk") + 1).alias("_blk"), F.col("_end").alias("_prev"))
        links = known.join(before, at, "left").withColumn("_run", F.floor(F.col("_blk") / width))
        broken = links.where((F.col("_blk") > 0) & ~F.col("_prev").eqNullSafe(F.col("_start")))
        broken = cut_lineage(broken.select(*keys, "_run").distinct())
        if broken.isEmpty():
            return known.select(*at, F.col("_start").alias("_state")), passes
        runs = [*keys, "_run"]
        todo = links.join(broken, runs, "left_semi").withColumn("_walked", F.lit(True)).join(laid, at)
        todo = todo.repartition(*runs).sortWithinPartitions(*runs, "_blk").select(*alone.columns)
        again = walked(todo).select(*at, F.struct("_start", "_end").alias("_new"))
        both = known.join(again, at, "left")
        known = cut_lineage(
            both.select(*at, *[F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) for c in ("_start", "_end")])
        )
        width, passes = 2 * width, passes + 1
