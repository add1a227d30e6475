"""Exact deduplication by Grace hashing.

Texts count as equal when nothing but ASCII white space tells them apart. The job has two
levels, each a Grace hash table that compares complete contents:

1. every task deduplicates the rows it reads (pre-aggregation: a group of copies that holds a
   third of all rows leaves one representative per task);
2. the representatives are shuffled by hash and deduplicated the same way.

A Grace table recursively partitions its records to spill files by further bits of the hash
until a bucket fits the memory bound, then enters the bucket into an open-addressing table.
Rows find their group through the (task, slot) of their representative, which the first level
stored, so the result never depends on a digest alone.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, give_back, in_blocks, partitions, pick, scratch_root, stored, texts
from tidemark.session import cut_lineage, drop_unused

MEMORY_BYTES = 32 << 20  # contents that one open-addressing table may hold
FAN_OUT = 16  # spill files per level of the recursion
MAX_DEPTH = 12  # 48 bits; beyond it only records of one hash are left, which no split separates

_DROP_WHITE = {c: None for c in (0x20, *range(0x09, 0x0E))}

Record = tuple[int, bytes, tuple]  # hash of the content, content, payload


class OpenTable:
    """Open addressing with linear probing over complete contents."""

    def __init__(self) -> None:
        self.slots = np.full(1024, -1, dtype=np.int64)
        self.hashes: list[int] = []
        self.contents: list[bytes] = []

    def find(self, h: int, content: bytes) -> int:
        """Group number of ``content``, a new one if it was not there."""
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
        mask, slots = len(self.slots) - 1, self.slots
        at = (h >> 20) & mask
        while (group := int(slots[at])) >= 0:
            if self.hashes[group] == h and self.contents[group] == content:
                return group
            at = (at + 1) & mask
        slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        return int(slots[at])

    def _grow(self) -> None:
        self.slots = np.full(4 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for group, h in enumerate(self.hashes):
            at = (h >> 20) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = group


def grace(records: Iterator[Record], memory: int, depth: int = 0) -> Iterator[tuple[list[bytes], list[int], list[tuple]]]:
    """Buckets of the records: contents of its groups, then group and payload of every record.

    A bucket ends when the distinct contents pass ``memory``: what was read so far and all that
    follows goes to spill files by the next bits of the hash, one bucket at a time.
    """
    table, groups, payloads, used = OpenTable(), [], [], 0
    for h, content, payload in records:
        known = len(table.contents)
        groups.append(table.find(h, content))
        payloads.append(payload)
        used += 120 + (len(content) if len(table.contents) > known else 0)
        if used > memory and len(table.contents) > 1 and depth < MAX_DEPTH:
            break
    else:
        yield table.contents, groups, payloads
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=scratch_root()) as folder:
        names = [f"{folder}/{i}" for i in range(FAN_OUT)]
        files = [open(n, "wb") for n in names]
        shift = 60 - 4 * depth
        for group, payload in zip(groups, payloads, strict=True):
            h = table.hashes[group]
            pickle.dump((h, table.contents[group], payload), files[(h >> shift) % FAN_OUT], protocol=5)
        del table, groups, payloads
        for record in records:
            pickle.dump(record, files[(record[0] >> shift) % FAN_OUT], protocol=5)
        for f in files:
            f.close()
        for name in names:
            yield from grace(_read(name), memory, depth + 1)


def _read(name: str) -> Iterator[Record]:
    with open(name, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


LOCAL = "doc_id long, part int, slot long, best struct<n: long, id: long>, copies long, hash long, sha string, content binary"
CLASSES = "part int, slot long, keep_id long, group_size long"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _better(a: tuple, b: tuple) -> tuple:
    """The record that stays: most code points, then smallest doc_id (null last)."""
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return min(a, b, key=key)


def _local(batches: Batches, memory: int) -> Batches:
    """One row per input row; the first of each local group carries content, size and best row."""
    part = TaskContext.get().partitionId()

    def records() -> Iterator[Record]:
        for batch in in_blocks(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
                content = text.translate(_DROP_WHITE).encode()
                yield xxhash.xxh3_64_intdigest(content), content, (doc_id, len(text))

    base = 0
    for contents, groups, payloads in grace(records(), memory):
        best: list = [None] * len(contents)
        copies = [0] * len(contents)
        for g, (doc_id, n) in zip(groups, payloads, strict=True):
            best[g] = (n, doc_id) if best[g] is None else _better(best[g], (n, doc_id))
            copies[g] += 1
        digests = [hashlib.sha256(c).hexdigest() for c in contents]
        seen = [False] * len(contents)
        rows: list[dict] = []
        size = 0
        for g, (doc_id, _) in zip(groups, payloads, strict=True):
            row = {"doc_id": doc_id, "part": part, "slot": base + g, "sha": digests[g]}
            if not seen[g]:
                seen[g] = True
                h = xxhash.xxh3_64_intdigest(contents[g])
                row |= {"best": {"n": best[g][0], "id": best[g][1]}, "copies": copies[g], "hash": _signed(h), "content": contents[g]}
                size += len(contents[g])
            rows.append(row)
            if len(rows) >= 4096 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=_LOCAL_ARROW)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_LOCAL_ARROW)
        base += len(contents)


_LOCAL_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.int32()), ("slot", pa.int64()), ("best", pa.struct([("n", pa.int64()), ("id", pa.int64())])),
    ("copies", pa.int64()), ("hash", pa.int64()), ("sha", pa.string()), ("content", pa.binary()),
])
_CLASSES_ARROW = pa.schema([("part", pa.int32()), ("slot", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])


def _merge(batches: Batches, memory: int) -> Batches:
    """Class of every representative in a shuffle partition."""

    def records() -> Iterator[Record]:
        names = ("hash", "content", "part", "slot", "best", "copies")
        for batch in batches:
            for h, content, part, slot, best, copies in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                yield h % (1 << 64), content, (part, slot, (best["n"], best["id"]), copies)

    for contents, groups, payloads in grace(records(), memory):
        best: list = [None] * len(contents)
        copies = [0] * len(contents)
        for g, (_, _, row, n) in zip(groups, payloads, strict=True):
            best[g] = row if best[g] is None else _better(best[g], row)
            copies[g] += n
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in payloads], pa.int32()),
                pa.array([p[1] for p in payloads], pa.int64()),
                pa.array([best[g][1] for g in groups], pa.int64()),
                pa.array([copies[g] for g in groups], pa.int64()),
            ],
            schema=_CLASSES_ARROW,
        )


def exact_groups(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """Group of every document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. One row per input
    row comes back, dropped rows too. Null and empty texts form one group with texts of white
    space only. Of equal texts the row with the most code points in its original text stays, then
    the smallest ``doc_id`` (null last). Rows that repeat a whole row, ``doc_id`` included, cannot be
    told apart: each of them is marked as kept when their ``doc_id`` is. An empty table gives none.
    ``text_sha256`` is the lowercase hex digest of the text without ASCII white space.
    """
    return _merged(_stored_local(docs, memory), memory)


def _stored_local(docs: DataFrame, memory: int) -> DataFrame:
    """The first level: every row, and the representatives with their contents."""
    return stored(pick(docs, "doc_id", "text").mapInArrow(partial(_local, memory=memory), LOCAL), "grace")


def _merged(local: DataFrame, memory: int) -> DataFrame:
    """The second level over a table of :func:`_stored_local`."""
    firsts = local.where("content IS NOT NULL").select("hash", "content", "part", "slot", "best", "copies")
    classes = firsts.repartition(partitions(local), "hash").mapInArrow(partial(_merge, memory=memory), CLASSES)
    return (
        local.select("doc_id", "part", "slot", "sha")
        .join(classes, ["part", "slot"])
        .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def keep_one(docs: DataFrame, memory: int = MEMORY_BYTES) -> DataFrame:
    """``docs`` with one row of each group of :func:`exact_groups`; all columns stay.

    Rows may share their ``doc_id`` or have none: a row is told by its id and its text without ASCII white space. Of rows
    that agree in both, the one with the longest original text stays, one of equally long ones.
    """
    local = _stored_local(docs, memory)
    # Names of rows are small: once they are written, the contents and their exchange can go.
    kept = cut_lineage(_merged(local, memory).where("kept").select(_name("doc_id").alias("_name"), F.col("text_sha256").alias("_sha")).distinct())
    give_back(local)
    drop_unused(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({"_name": _name("doc_id"), "_sha": F.sha2(F.translate(text, " \t\n\x0b\x0c\r", ""), 256)})
    first = Window.partitionBy("_name", "_sha").orderBy(F.length(text).desc(), text)
    found = named.join(kept, ["_name", "_sha"], "left_semi").withColumn("_i", F.row_number().over(first))
    return found.where("_i = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def _name(column: str):
    """An id as text, empty for null, so that it can be compared plainly."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
