"""Best-fit-decreasing packing of token ids into sequences of a fixed capacity.

Best fit decreasing takes pieces from the longest to the shortest and puts each into the tightest open
sequence that has room. Which document a piece belongs to does not matter to it, only how many pieces have which
length; so the walk runs over counts, at most one per length, whatever the size of the corpus. Open sequences with the same
room form a class; a segment tree over the rooms finds the tightest class in logarithmic time. The walk gives a
table of ranges: pieces of one length with ranks ``i`` to ``i + n`` go to sequences ``b`` to ``b + n`` at one offset. Spark
ranks the pieces of every length and each piece looks its place up.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, Remembered, in_blocks, kept_by_worker, pick, stored, texts
from tidemark.plans.blocks import prefix

CAPACITY = 1024
END_ID = 2
CACHED = 500_000  # words a worker remembers, and as many old ones
GROUP = 4096  # new words that go to the library together

# -- tokens --------------------------------------------------------------------

_BEFORE_TEXT = re.compile(r" (?=\S)")
_BLANK_RUN = re.compile(r" (?:\s|\Z)")


class ByteTokens:
    """The tokenizers library with a memory of words.

    A byte-level vocabulary starts a new part at every blank that has a non-blank character behind it, so a
    text is cut there and each word has its own ids, the blank before it included.
    New words go to the library in one text; the tokens that begin with a blank tell them apart again.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.starts[i] = token.startswith("Ġ")  # how byte-level vocabularies write a blank
        self.known = Remembered(CACHED)

    def _ids(self, items: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(items, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if not w or " " in w]
        plain = [w for w in words if w and " " not in w] if alone else words
        for k in range(0, len(plain), GROUP):
            group = plain[k : k + GROUP]
            raw = self._ids([" " + " ".join(group)])[0]
            at = np.flatnonzero(self.starts[np.frombuffer(raw, dtype="<u4")]).tolist()
            if len(at) == len(group) and at[0] == 0:
                self.known.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(group, at, [*at[1:], len(raw) // 4], strict=True))
            else:
                alone += group
        if alone:
            self.known.update(zip(alone, self._ids([" " + w for w in alone]), strict=True))

    def encode_all(self, items: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        rows = [_BEFORE_TEXT.split(t) if _BLANK_RUN.search(t) else t.split(" ") for t in items]
        heads = self._ids([row.pop(0) for row in rows])
        new = self.known.missing(rows)
        if new:
            self._learn(sorted(new))
        of = self.known.__getitem__
        out = [head + b"".join(map(of, row)) for head, row in zip(heads, rows, strict=True)]
        self.known.age()
        return out


def byte_tokens(path: str | None) -> ByteTokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return kept_by_worker(f"byte tokens {path}", lambda: ByteTokens(path))


# -- pieces --------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, rank long"


def _cut(batches: Batches, path: str | None, capacity: int, keep_ids: bool) -> Batches:
    encoder, end = byte_tokens(path), np.array([END_ID], dtype="<u4").tobytes()
    part, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * keep_ids
    for batch in in_blocks(batches):
        columns: list[list] = [[] for _ in names]
        found = encoder.encode_all(texts(batch.column("text")))
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), found, strict=True):
            raw += end
            n = len(raw) // 4
            first = n % capacity or capacity
            for k, stop in enumerate(range(first, n + 1, capacity)):
                start = max(0, stop - capacity) if k else 0
                own, length = raw[4 * start : 4 * stop], stop - start
                for column, value in zip(columns, (doc_id, k, start, length, zlib.crc32(own), part, ranks[length], own)):
                    column.append(value)
                ranks[length] += 1
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document, stored in the shared folder; ``keep_ids`` adds their ids as little-endian 32-bit integers.

    A document of more than ``capacity`` ids, end id included, is cut into pieces of that length; the first is
    shorter if the length is no multiple. ``rank`` counts the pieces of a length that a task wrote before.
    """
    schema = PIECES + (", ids binary" if keep_ids else "")
    work = partial(_cut, path=path, capacity=capacity, keep_ids=keep_ids)
    return stored(pick(docs, "doc_id", "text").mapInArrow(work, schema), "cut")


# -- best fit --------------------------------------------------------------------


class Rooms:
    """Segment tree over rooms 0 to ``capacity``: which have open sequences."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def mark(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """Smallest room of at least ``least`` with an open sequence."""
        i = least + self.size
        while not self.any[i]:
            # Up to the next subtree on the right.
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rows ``length, rank, sequence, n, offset`` that place ``counts`` pieces of every length, and the number of sequences.

    Equals best fit decreasing piece by piece: a sequence that took a piece and has room for another of the same
    length is the tightest one, so it is filled before the next. The rows and the time depend on the capacity only.
    """
    rooms = Rooms(capacity)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # ranges (first sequence, n) by room
    made, rows = 0, []

    def put(length: int, rank: int, first: int, n: int, room: int, each: int) -> None:
        for k in range(each):
            rows.append((length, rank + k * n, first, n, capacity - room + k * length))
        left = room - each * length
        open_[left].append((first, n))
        rooms.mark(left, True)

    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            room = rooms.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, there = made, -(-todo // each)
                made += there
            else:
                each = room // length
                first, there = open_[room].pop()
            full = min(there, todo // each)
            if full:
                put(length, rank, first, full, room, each)
                rank, todo = rank + full * each, todo - full * each
            if full < there and todo:
                put(length, rank, first + full, 1, room, todo)
                rank, todo, full = rank + todo, 0, full + 1
            if full < there:
                open_[room].append((first + full, there - full))
            if room < capacity or open_[room]:
                rooms.mark(room, bool(open_[room]))
    return np.array(rows, dtype=np.int64).reshape(-1, 5), made


_RANK_BITS = 44


def _place(batches: Batches, keys: np.ndarray, rows: np.ndarray) -> Batches:
    for batch in batches:
        wanted = (batch.column("length").to_numpy() << _RANK_BITS) | batch.column("rank").to_numpy()
        at = np.searchsorted(keys, wanted, "right") - 1
        sequence = rows[at, 2] + wanted - keys[at]
        rest = [i for i, name in enumerate(batch.schema.names) if name != "rank"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in rest], pa.array(sequence), pa.array(rows[at, 4])],
            names=[*[batch.schema.names[i] for i in rest], "sequence_id", "offset"],
        )


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces with their place: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` on request).

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Null and empty texts are the end id only;
    null ids and repeated rows are packed like any others. ``path`` is a byte-level tokenizer file that workers can read. An
    empty table gives no rows. Pieces of one length are interchangeable; which goes where follows the order in which tasks
    wrote them. Only the counts by length, ``capacity`` rows at most, go to the driver.
    """
    found = cut(docs, path, capacity, keep_ids)
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = prefix(counts, ["length"], "part", {"n": "sum"}).withColumnRenamed("n", "before")
    lengths = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = best_fit(lengths, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = (rows[:, 0] << _RANK_BITS) | rows[:, 1]
    ranked = found.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("rank"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank", *["ids"] * keep_ids)
    ids = "ids binary, " if keep_ids else ""
    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, {ids}sequence_id long, offset long"
    return ranked.mapInArrow(partial(_place, keys=keys, rows=rows), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: the ids of whole sequences, from rows of :func:`pack` with ids."""
    members = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(m, CAST('' AS BINARY), (a, x) -> concat(a, x.ids))")
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), members.alias("m"))
    return grouped.select("sequence_id", "length", joined.alias("ids"))
