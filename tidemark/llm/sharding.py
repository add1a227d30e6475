"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Documents and virtual nodes of the shards lie on a ring by their hash. A document belongs to
the first virtual node clockwise; where that shard is full it goes on to the next shard on the ring
that has room. Capacities are the exact quotas, so row counts are at most one apart, and only
documents that overflow leave the shard the ring gives them.

The ring is cut into cells. Documents of a cell meet the shards in one order, so it suffices to
count documents by cell: the counts decide how many of a cell stay at each shard, and a
document's rank in its cell decides which of these it is.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import pick

VIRTUAL_NODES = 64  # per shard
CELLS = 1 << 14  # of the ring, a power of two; 1e10 documents give 6e5 ranks to a task
RING = 60  # bits of a position


def _position(label: str) -> int:
    return int(hashlib.md5(label.encode()).hexdigest()[: RING // 4], 16)


def clockwise(shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, ...]]:
    """For every cell all shards in the order in which the ring meets them."""
    per_cell = (1 << RING) // cells
    nodes = sorted((_position(f"shard {s} node {v}") // per_cell, s) for s in range(shards) for v in range(virtual_nodes))
    walks: dict[int, tuple[int, ...]] = {}
    orders = []
    for cell in range(cells):
        first = bisect_left(nodes, (cell, -1)) % len(nodes)
        if first not in walks:
            walks[first] = tuple(dict.fromkeys(s for _, s in nodes[first:] + nodes[:first]))
        orders.append(walks[first])
    return orders


def allot(counts: dict[int, int], shards: int, virtual_nodes: int, cells: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Segments ``(end, shard, slot of rank zero)`` of the ranks of every cell.

    In turn h every cell offers what is left of it to its h-th shard; a shard takes offers
    clockwise until its quota is full.
    """
    total = sum(counts.values())
    free = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    left = dict(counts)
    segments: dict[int, list[tuple[int, int, int]]] = {c: [] for c in counts}
    orders = clockwise(shards, virtual_nodes, cells)
    for hop in range(shards):
        for cell in sorted(left):
            shard = orders[cell][hop]
            taken = min(left[cell], free[shard])
            if taken:
                start = counts[cell] - left[cell]
                segments[cell].append((start + taken, shard, used[shard] - start))
                used[shard] += taken
                free[shard] -= taken
                left[cell] -= taken
    return sorted(segments.items())


def shard(docs: DataFrame, shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, cells: int = CELLS) -> DataFrame:
    """Shard of every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. One row per input
    row comes back. The law is ``rows``: counts of shards are at most one apart. ``size`` is the
    text's UTF-8 bytes plus one, a null text counts as empty. ``slot`` runs from 0 in every shard
    without gaps. Repeated ids share a position; ranks within a cell follow position, id, size and
    checksum, so rows that tie in all of them are alike. Rows with a null id are placed by size
    and checksum. ``grown_shard`` is null, as this law moves rows between all shards.
    Only the counts of ``cells`` cells reach the driver. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    label = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(" ", F.lit("none"), "size", "text_crc32"))
    position = F.conv(F.substring(F.md5(label), 1, RING // 4), 16, 10).cast("long")
    per_cell = (1 << RING) // cells
    cell = F.shiftright("position", (per_cell - 1).bit_length()).cast("int")
    placed = rows.withColumn("position", position).withColumn("cell", cell)
    counts = {r.cell: r["count"] for r in placed.groupBy("cell").count().collect()}
    plan = docs.sparkSession.createDataFrame(
        allot(counts, shards, virtual_nodes, cells), "cell int, segments array<struct<upto: long, shard: int, base: long>>"
    )
    order = Window.partitionBy("cell").orderBy("position", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = placed.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    mine = F.try_element_at(F.filter("segments", lambda s: F.col("rank") < s["upto"]), F.lit(1))
    return ranked.join(plan, "cell").withColumn("mine", mine).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("mine.shard").alias("shard"),
        (F.col("mine.base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
