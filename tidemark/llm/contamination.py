"""Benchmark passages inside documents: size-partitioned MinHash containment search.

A document that holds a share ``containment`` of an item's ``m`` shingles holds at least one of
the item's ``floor((1 - containment) * m) + 1`` smallest hashes. Items are partitioned by size; a
class takes that many smallest hashes of each of its items as sketch, and its largest sketch
hash is the class's bound. A document's sketch for a class is all of its hashes up to the bound,
which leaves few to look up in long documents while no contained item is missed. Items
that meet a document in a sketch are verified by exact containment of their shingles.
"""

from __future__ import annotations

from collections import defaultdict
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, in_blocks, pick, stored, texts
from tidemark.llm.simhash import shingles, word_list

BLOCK_CHARS = 64 << 20  # characters of items that one pass carries to every task

HITS = "doc_id long, item_id long, shared long, item_shingles long"


class Items:
    """Sketches of one block of items, by shingle length and size class."""

    def __init__(self, rows: list[tuple[int, str]], words: int, containment: float) -> None:
        self.ids, self.sets = [], []
        classes: dict[tuple[int, int], list[int]] = defaultdict(list)
        for item_id, text in rows:
            found = word_list(text)
            if not found:
                continue
            own = set(shingles(found, words))
            classes[min(words, len(found)), len(own).bit_length()].append(len(self.ids))
            self.ids.append(item_id)
            self.sets.append(own)
        self.need = [int(np.ceil(containment * len(s) - 1e-9)) for s in self.sets]
        self.classes = []
        for (length, _), members in classes.items():
            entries = []
            for i in members:
                hashes = sorted(xxhash.xxh3_64_intdigest(s) for s in self.sets[i])
                entries += [(h, i) for h in hashes[: len(hashes) - self.need[i] + 1]]
            entries.sort()
            sketch = np.array([h for h, _ in entries], dtype=np.uint64)
            self.classes.append((length, sketch, np.array([i for _, i in entries])))

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """``(item_id, shared, item_shingles)`` of the items that ``text`` contains."""
        found = word_list(text)
        hashed: dict[int, tuple[list[bytes], np.ndarray]] = {}
        candidates: set[int] = set()
        for length, sketch, owner in self.classes:
            if len(found) < length:
                continue
            if length not in hashed:
                own = shingles(found, length)
                hashed[length] = own, np.array([xxhash.xxh3_64_intdigest(s) for s in own], dtype=np.uint64)
            mine = hashed[length][1]
            mine = np.unique(mine[mine <= sketch[-1]])
            low, high = np.searchsorted(sketch, mine), np.searchsorted(sketch, mine, "right")
            for a, b in zip(low[high > low].tolist(), high[high > low].tolist(), strict=True):
                candidates.update(owner[a:b].tolist())
        if not candidates:
            return []
        whole = {n: set(own) for n, (own, _) in hashed.items()}
        hits = []
        for i in sorted(candidates):
            length = next(iter(self.sets[i])).count(b" ") + 1
            shared = len(self.sets[i] & whole[length])
            if shared >= self.need[i]:
                hits.append((self.ids[i], shared, len(self.sets[i])))
        return hits


def _search(batches: Batches, rows: list[tuple[int, str]], words: int, containment: float) -> Batches:
    items = Items(rows, words, containment)
    for batch in in_blocks(batches):
        found = [
            (doc_id, *hit)
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True)
            for hit in items.search(text)
        ]
        columns = list(zip(*found, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "shared", "item_shingles"])


def contained_items(
    docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment`` for every item inside a document.

    ``docs`` needs ``doc_id`` and ``text``, ``items`` needs ``item_id`` (longs) and ``text``; other
    columns are ignored. ``shared`` counts the item's distinct shingles of ``words`` words that
    occur in the document, ignoring the case of A-Z. An item of fewer words is one shingle of its own
    length. Items or documents that are null, empty or white match nothing. Repeated documents and
    items each give their own rows; empty tables give none. Documents are read once per block of
    ``block_chars`` characters of items, so what is sent to the tasks is bounded for a benchmark of any size.
    """
    numbered = pick(items, "item_id", "text").where("text IS NOT NULL")
    found = None
    for block in _blocks(numbered, block_chars):
        part = pick(docs, "doc_id", "text").mapInArrow(
            partial(_search, rows=block, words=words, containment=containment), HITS
        )
        found = part if found is None else found.unionAll(stored(part, "hits"))
    if found is None:
        found = docs.sparkSession.createDataFrame([], HITS)
    return found.withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))


def _blocks(items: DataFrame, block_chars: int):
    """Items in lists of at most ``block_chars`` characters (one item at least)."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and size + len(row.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def _clean(batches: Batches, rows: list[tuple[int, str]], words: int, containment: float) -> Batches:
    items = Items(rows, words, containment)
    for batch in in_blocks(batches):
        yield batch.filter(pa.array([not items.search(t) for t in texts(batch.column("text"))], pa.bool_()))


def decontaminate(docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without those that contain an item; all columns, clean documents and repeated rows stay.

    Each block of items filters what the blocks before left, so no document is shuffled.
    """
    for block in _blocks(pick(items, "item_id", "text").where("text IS NOT NULL"), block_chars):
        docs = docs.mapInArrow(partial(_clean, rows=block, words=words, containment=containment), docs.schema)
    return docs
