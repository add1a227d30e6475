"""Token ids in compressed files: Re-Pair grammars, shard by shard.

Documents are encoded in ascending ``doc_id`` order and packed into shards. In each shard frequent pairs of
neighbours are replaced by nonterminals, round by round, until none is left. A round replaces many pairs at
once: where two chosen pairs overlap, the more frequent one is replaced. A document of more ids than a shard is cut into
blocks with a grammar each. A block stores its rules, the length of each rule's expansion and the remaining row
of symbols, so any range of ids is decoded without the rest.

A shard file is one binary value of a Parquet table in the shared folder: Spark's writer commits
it, and a lost task writes it again.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, Remembered, blocks, kept_by_worker, partitions, pick, stored, texts

END_ID = 1
BLOCK_IDS = 1 << 17
SHARD_IDS = BLOCK_IDS
LEAST_USES = 4  # a rule costs two symbols and a length
CACHED = 500_000  # parts of text a worker remembers, and as many old ones
BLOCK_BYTES = 1 << 20  # of text that is encoded at once

MAGIC = b"TIDEIDS1"
_SHARD = "<8sIIQ"  # magic, documents, blocks, ids
_BLOCK = "<IIIIII"  # ids, first nonterminal, rules, symbols, bytes per symbol, bytes in total


def _round(seq: np.ndarray, live: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Sequence with frequent pairs replaced from ``base`` on, places that can still start a frequent pair, and left and
    right sides of the rules.

    Counts of a pair only fall, so pairs that were rare come back only with a new symbol: places of ``live`` are looked at.
    """
    at = np.flatnonzero(live[:-1])
    left, right = seq[at], seq[at + 1]
    codes = (left.astype(np.uint64) << np.uint64(32)) | right if base > 0xFFFF else (left << np.uint32(16)) | right
    if not len(codes):
        return None
    ordered = np.sort(codes)
    edges = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
    counts = np.diff(edges)
    often = np.flatnonzero(counts >= LEAST_USES)
    if not len(often):
        return None
    pairs = ordered[edges[often]]
    pairs = pairs[np.argsort(-counts[often], kind="stable")]
    most = 0x10000 - base if base <= 0xFFFF else len(pairs)  # more symbols need wider codes, from the next round on
    # Rank of the pair at every place by a hash table; of pairs that collide the less frequent waits for a later round.
    bits = min(len(pairs).bit_length() + 3, 18)
    mix = np.uint64(0x9E3779B97F4A7C15) if codes.dtype == np.uint64 else np.uint32(0x9E3779B1)
    shift = codes.dtype.type(codes.dtype.itemsize * 8 - bits)
    table = np.full(1 << bits, -1, dtype=np.int32)
    table[((pairs * mix) >> shift)[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]
    found = table[(codes * mix) >> shift]
    none = np.int32(len(pairs))
    rank = np.full(len(seq) - 1, none)
    rank[at] = np.where((found >= 0) & (found < most) & (pairs[np.maximum(found, 0)] == codes), found, none)
    again = np.zeros(len(seq), dtype=bool)
    again[at[found >= 0]] = True
    # Of a run of one symbol every second pair counts.
    inside = np.flatnonzero((seq[2:] == seq[1:-1]) & (seq[1:-1] == seq[:-2])) + 1
    if len(inside):
        place = np.arange(len(rank))
        start = place.copy()
        start[inside] = 0
        rank[((place - np.maximum.accumulate(start)) & 1).astype(bool)] = none
    # A place is replaced if its pair comes before the pairs it overlaps, the left one in a tie.
    here = rank < none
    here[1:] &= rank[1:] < rank[:-1]
    here[:-1] &= rank[:-1] <= rank[1:]
    at = np.flatnonzero(here)
    uses = np.bincount(rank[at], minlength=len(pairs))
    worth = uses >= 2
    at = at[worth[rank[at]]]
    if not len(at):
        return None
    names = np.cumsum(worth) - 1 + base
    out = seq.copy()
    out[at] = names[rank[at]]
    again[at] = True
    again[at[at > 0] - 1] = True
    keep = np.ones(len(seq), dtype=bool)
    keep[at + 1] = False
    half = codes.dtype.type(codes.dtype.itemsize * 4)
    chosen = pairs[worth]
    return out[keep], again[keep], (chosen >> half).astype(np.uint32), (chosen & codes.dtype.type((1 << int(half)) - 1)).astype(np.uint32)


def compress(ids: np.ndarray) -> bytes:
    """Grammar of one block of ids (below 2**31)."""
    seq = ids.astype(np.uint32)
    first = base = int(seq.max(initial=0)) + 1
    left, right = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    live = np.ones(len(seq), dtype=bool)
    while len(seq) > 1 and (made := _round(seq, live, base)):
        seq, live = made[:2]
        left.append(made[2])
        right.append(made[3])
        base += len(made[2])
    a, b = np.concatenate(left), np.concatenate(right)
    spans = np.ones(base, dtype=np.uint32)
    done = first
    for side_a, side_b in zip(left, right, strict=True):
        spans[done : done + len(side_a)] = spans[side_a] + spans[side_b]
        done += len(side_a)
    symbol = np.dtype("<u2" if base <= 0x10000 else "<u4")
    rounds = np.array([len(x) for x in left[1:]], dtype="<u4")
    body = b"".join([
        struct.pack("<I", len(rounds)), rounds.tobytes(), a.astype(symbol).tobytes(), b.astype(symbol).tobytes(),
        spans[first:].astype("<u4").tobytes(), seq.astype(symbol).tobytes(),
    ])
    return struct.pack(_BLOCK, len(ids), first, len(a), len(seq), symbol.itemsize, len(body)) + body


class Block:
    """A stored block: its rules and symbols as arrays over the file's bytes."""

    def __init__(self, raw: bytes, at: int) -> None:
        self.n_ids, self.first, rules, symbols, width, size = struct.unpack_from(_BLOCK, raw, at)
        at += struct.calcsize(_BLOCK)
        self.end = at + size
        kind = np.dtype(f"<u{width}")
        (n,) = struct.unpack_from("<I", raw, at)
        self.rounds = np.frombuffer(raw, "<u4", n, at + 4).tolist()
        at += 4 + 4 * n
        self.left = np.frombuffer(raw, kind, rules, at)
        self.right = np.frombuffer(raw, kind, rules, at + width * rules)
        self.spans = np.frombuffer(raw, "<u4", rules, at + 2 * width * rules)
        self.seq = np.frombuffer(raw, kind, symbols, at + (2 * width + 4) * rules)

    def expand(self, seq: np.ndarray) -> np.ndarray:
        """Ids of symbols: the rules of the last round are resolved first."""
        seq = seq.astype(np.uint32)
        top = len(self.left)
        for n in reversed(self.rounds):
            low = top - n
            rule = np.flatnonzero(seq >= self.first + low)
            # Every symbol moves right by the number of rules before it.
            name = seq[rule] - self.first
            wide = np.repeat(seq, 1 + (seq >= self.first + low))
            at = rule + np.arange(len(rule))
            wide[at] = self.left[name]
            wide[at + 1] = self.right[name]
            seq, top = wide, low
        return seq

    def expand_all(self) -> np.ndarray:
        """Ids of the block: the expansions of all rules, those of the first round first, are looked up in one step."""
        spans = self.spans.astype(np.int64)
        begins = np.cumsum(spans) - spans
        flat = np.zeros(0, dtype=np.uint32)

        def looked_up(seq: np.ndarray) -> np.ndarray:
            rule = np.flatnonzero(seq >= self.first)
            name = seq[rule].astype(np.int64) - self.first
            sizes = np.ones(len(seq), dtype=np.int64)
            sizes[rule] = spans[name]
            out = np.repeat(seq, sizes)
            ends = np.cumsum(sizes)[rule]
            own = spans[name]
            step = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[step + np.repeat(ends - own, own)] = flat[step + np.repeat(begins[name], own)]
            return out

        done = 0
        for n in self.rounds:
            sides = np.stack((self.left[done : done + n], self.right[done : done + n]), axis=1).astype(np.uint32)
            flat = np.concatenate((flat, looked_up(sides.ravel())))
            done += n
        return looked_up(self.seq.astype(np.uint32))

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the block; only symbols that cover them are expanded."""
        stop = self.n_ids if stop is None else stop
        if start == 0 and stop == self.n_ids:
            return self.expand_all()
        spans = np.ones(len(self.seq), dtype=np.int64)
        rule = self.seq >= self.first
        spans[rule] = self.spans[self.seq[rule] - self.first]
        ends = np.cumsum(spans)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.seq[a:b])[skip : skip + stop - start]


def pack(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard file: documents, then blocks."""
    blocks = [compress(ids[i : i + BLOCK_IDS]) for i in range(0, len(ids), BLOCK_IDS)]
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d or 0 for d in doc_ids], dtype="<i8")
    return b"".join([
        struct.pack(_SHARD, MAGIC, len(doc_ids), len(blocks), len(ids)), known.tobytes(), names.tobytes(), np.array(lengths, dtype="<u4").tobytes(), *blocks,
    ])


class Shard:
    """A shard file to read."""

    def __init__(self, raw: bytes) -> None:
        magic, docs, blocks, self.n_ids = struct.unpack_from(_SHARD, raw)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        at = struct.calcsize(_SHARD)
        known = np.frombuffer(raw, np.uint8, docs, at)
        names = np.frombuffer(raw, "<i8", docs, at + docs)
        self.doc_ids = [int(n) if k else None for n, k in zip(names, known, strict=True)]
        self.lengths = np.frombuffer(raw, "<u4", docs, at + 9 * docs).astype(np.int64)
        at += 13 * docs
        self.blocks = []
        for _ in range(blocks):
            self.blocks.append(Block(raw, at))
            at = self.blocks[-1].end

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Any range of the shard's ids."""
        stop = self.n_ids if stop is None else stop
        parts = [
            block.ids(max(0, start - k * BLOCK_IDS), min(block.n_ids, stop - k * BLOCK_IDS))
            for k, block in enumerate(self.blocks)
            if start < k * BLOCK_IDS + block.n_ids and stop > k * BLOCK_IDS
        ]
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


# -- tokens --------------------------------------------------------------------

# Text of these characters and ASCII white space is cut as the library cuts it; all else goes to it word by word.
_ODD = re.compile(r"[^A-Za-zÀ-ÖØ-öø-įĲ-ž\x20-~\x09-\x0D]")
_PARTS = re.compile(r"[a-zß-öø-įĲ-ž]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")


class Tokens:
    """The tokenizers library with a memory of the parts between which it never merges.

    A part of common characters goes to the library together with other new parts, blanks
    between them; each part ends with a token of its own kind, which tells them apart again. A word
    with other characters, or with a special token's text, goes to the library by itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.known = Remembered(CACHED)

    def _odd(self, text: str) -> bool:
        return bool(_ODD.search(text)) or any(s in text for s in self.special)

    def parts(self, text: str) -> list[str]:
        if not self._odd(text):
            return _PARTS.findall(text.lower())
        out: list[str] = []
        for word in text.encode().split():
            w = word.decode()
            out += [w] if self._odd(w) else _PARTS.findall(w.lower())
        return out

    def _learn(self, parts: list[str]) -> None:
        odd = [p for p in parts if self._odd(p)]
        plain = [p for p in parts if not self._odd(p)] if odd else parts
        for start in range(0, len(plain), 512):
            group = plain[start : start + 512]
            ids = np.array(self.library.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) == len(group):
                raw = ids.tobytes()
                self.known.update((p, raw[4 * a : 4 * b]) for p, a, b in zip(group, [0, *ends], ends, strict=False))
            else:
                odd += group
        found = self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else []
        self.known.update((p, np.array(e.ids, dtype="<u4").tobytes()) for p, e in zip(odd, found, strict=True))

    def encode_all(self, items: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        rows = [self.parts(t) for t in items]
        known = self.known
        new = known.missing(rows)
        if new:
            self._learn(sorted(new))
        of = known.__getitem__
        out = [b"".join(map(of, row)) for row in rows]
        known.age()
        return out


def tokens(path: str | None) -> Tokens:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return kept_by_worker(f"tokens {path}", lambda: Tokens(path))


# -- operator ------------------------------------------------------------------

FILES = "part int, shard int, first long, n_ids long, n_docs long, file binary"
_FILES = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("file", pa.binary())])


def _write(batches: Batches, path: str | None) -> Batches:
    part = TaskContext.get().partitionId()
    encoder, end = tokens(path), np.array([END_ID], dtype="<u4").tobytes()
    names: list = []
    raws: list[bytes] = []
    size = first = number = 0

    def flush() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(raws), dtype="<u4")
        file = pack(names, [len(r) // 4 for r in raws], ids)
        return pa.RecordBatch.from_pylist(
            [{"part": part, "shard": number, "first": first, "n_ids": len(ids), "n_docs": len(names), "file": file}], schema=_FILES
        )

    for batch in batches:
        doc_ids = batch.column("doc_id").to_pylist()
        for a, b in blocks(batch.column("text"), BLOCK_BYTES):
            found = encoder.encode_all(texts(batch.column("text").slice(a, b - a)))
            for doc_id, raw in zip(doc_ids[a:b], found, strict=True):
                names.append(doc_id)
                raws.append(raw + end)
                size += len(raw) // 4 + 1
                if size >= SHARD_IDS:
                    yield flush()
                    first, number = first + size, number + 1
                    names, raws, size = [], [], 0
    if names:
        yield flush()


def write_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Files of token ids: ``part, shard, first, n_ids, n_docs, file`` in a new folder of the shared folder.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. Documents follow each
    other by ``doc_id`` (null first, ties by text) through ``part`` and ``shard``; ``first`` counts ids before the
    shard within its part. Null and empty texts have the end id only. ``path`` is a tokenizer file
    that workers can read. An empty table writes no shards.
    """
    ordered = pick(docs, "doc_id", "text").repartitionByRange(partitions(docs), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(partial(_write, path=path), FILES), "ids")


def _read(batches: Batches) -> Batches:
    for batch in batches:
        for raw, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
            shard = Shard(raw)
            ids = shard.ids().astype("<u4").tobytes()
            ends = np.cumsum(shard.lengths)
            starts = (ends - shard.lengths).tolist()
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.doc_ids, pa.int64()), pa.array([first + a for a in starts], pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_ids(files: DataFrame) -> DataFrame:
    """Documents in files of :func:`write_ids`: ``doc_id, start, n_tokens, ids_crc32``, decoded from the files.

    ``start`` counts the ids of all documents before. Only totals by part, one row per shuffle
    partition of the writer, are ordered in one task and joined to the files.
    """
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(bases), "part").select((F.col("first") + F.col("base")).alias("first"), "file")
    return placed.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
