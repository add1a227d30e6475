"""Trie of conversation prefixes by vertical bitmaps.

Conversations are dealt into shards by ranges of their ids. A shard indexes (position, turn) to the bitset of its
conversations that have this turn there. Starting with all conversations, depth-first intersection
of a node's bitset with the postings of the next position gives its children; popcounts give members, and the
conversations that end at a node give its end list.

Shards see only their own part of a node, so nodes are merged by the digest of their path, one row per shard and
node. Sums over subtrees need every distinct node once: a node belongs to the shard with its smallest member, which also has
its ancestors. Each shard adds up the nodes that belong to it below every node it knows, and the sums of the shards
are added. No step needs as many passes as conversations have turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, partitions, pick, stored

SHARD_CONVERSATIONS = 4096
SHARD_TURNS = 1 << 16  # one conversation at least
ROOT = bytes(16)
ROWS = 8192  # of an Arrow batch

_LOCAL = pa.schema([
    ("part", pa.int64()), ("shard", pa.int64()), ("node", pa.int64()), ("parent", pa.int64()), ("key", pa.binary()), ("depth", pa.int64()),
    ("bytes", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("n_ends", pa.int64()), ("ends", pa.string()),
])
_LOCAL_DDL = "part long, shard long, node long, parent long, key binary, depth long, bytes long, n long, first long, n_ends long, ends string"

Turns = list[tuple[bytes, int]]  # digest of role and text, bytes of the text
Borrowed = Callable[[int], int]


def _tables(rows: Iterator[tuple], schema: pa.Schema) -> Batches:
    """Row tuples as batches of bounded size."""
    chunk: list[tuple] = []
    for row in rows:
        chunk.append(row)
        if len(chunk) == ROWS:
            yield _table(chunk, schema)
            chunk = []
    if chunk:
        yield _table(chunk, schema)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _conversations(batches: Batches) -> Iterator[tuple[int, int, Turns]]:
    """Family, id and turns of each conversation; rows are sorted by them."""
    last, turns = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("family", "conv_id", "digest", "bytes")]
        for family, conv_id, digest, size in zip(*columns, strict=True):
            if last is not None and conv_id != last[1]:
                yield *last, turns
                turns = []
            last = family, conv_id
            turns.append((digest, size))
    if last is not None:
        yield *last, turns


def _rebuilt(found: Iterator[tuple[int, int, Turns]], family: int, borrowed: Borrowed | None) -> Iterator[tuple[int, Turns]]:
    known, head = None, []
    for group, conv_id, turns in found:
        if borrowed is None:
            yield conv_id, turns
            continue
        if group != known:
            known, head = group, turns if conv_id % family == 0 else []
        h = borrowed(conv_id)
        yield conv_id, head[:h] + turns[h:]


def _nodes(part: int, shard: int, members: list[tuple[int, Turns]]) -> Iterator[tuple]:
    """The trie of one shard, parents before their children."""
    lengths = [len(turns) for _, turns in members]
    # Below the second longest only one conversation is left, which needs no postings.
    shared = sorted(lengths)[-2] if len(lengths) > 1 else 0
    postings: list[dict[bytes, int]] = [{} for _ in range(shared)]
    ends: dict[int, int] = {}
    for i, (_, turns) in enumerate(members):
        bit = 1 << i
        ends[len(turns)] = ends.get(len(turns), 0) | bit
        for own, (digest, _) in zip(postings, turns):
            own[digest] = own.get(digest, 0) | bit
    todo = [((1 << len(members)) - 1, 0, ROOT, -1, 0)]
    node = 0
    while todo:
        bits, depth, key, parent, size = todo.pop()
        ended = bits & ends.get(depth, 0)
        first = members[(bits & -bits).bit_length() - 1][0]
        names, left = [], ended
        while left:
            low = left & -left
            names.append(str(members[low.bit_length() - 1][0]))
            left ^= low
        yield part, shard, node, parent, key, depth, size, bits.bit_count(), first, len(names), ",".join(names)
        rest = bits ^ ended
        while rest:
            digest, size = members[(rest & -rest).bit_length() - 1][1][depth]
            child = rest & postings[depth][digest] if depth < shared else rest
            todo.append((child, depth + 1, hashlib.blake2b(key + digest, digest_size=16).digest(), node, size))
            rest ^= child
        node += 1


def _tries(batches: Batches, family: int, borrowed: Borrowed | None) -> Batches:
    part = TaskContext.get().partitionId()

    def rows() -> Iterator[tuple]:
        shard, turns, members = 0, 0, []
        for conv in _rebuilt(_conversations(batches), family, borrowed):
            members.append(conv)
            turns += len(conv[1])
            if len(members) == SHARD_CONVERSATIONS or turns >= SHARD_TURNS:
                yield from _nodes(part, shard, members)
                shard, turns, members = shard + 1, 0, []
        if members:
            yield from _nodes(part, shard, members)

    yield from _tables(rows(), _LOCAL)


_MERGED = pa.schema([
    ("key", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("leaf", pa.bool_()), ("ends_sha256", pa.string()),
])
_MERGED_DDL = "key binary, depth long, bytes long, conv_id long, n_convs long, leaf boolean, ends_sha256 string"


def _merge(batches: Batches) -> Batches:
    """One row per node; rows are sorted by path and shard, so that end lists follow each other in ascending order."""

    def rows() -> Iterator[tuple]:
        last, digest, depth, size, first, n, ended = None, None, 0, 0, 0, 0, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "depth", "bytes", "n", "first", "n_ends", "ends")]
            for key, d, b, own, low, n_ends, ends in zip(*columns, strict=True):
                if key != last:
                    if last is not None:
                        yield last, depth, size, first, n, n == ended, digest.hexdigest()
                    last, digest, depth, size, first, n, ended = key, hashlib.sha256(), d, b, low, 0, 0
                if n_ends:
                    digest.update(("," * (ended > 0) + ends).encode())
                first, n, ended = min(first, low), n + own, ended + n_ends
        if last is not None:
            yield last, depth, size, first, n, n == ended, digest.hexdigest()

    yield from _tables(rows(), _MERGED)


_SUMS = pa.schema([
    ("key", pa.binary()), ("saved", pa.int64()), ("leaves", pa.int64()), ("children", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends_sha256", pa.string()),
])
_SUMS_DDL = "key binary, saved long, leaves long, children long, conv_id long, depth long, parent_conv_id long, n_convs long, ends_sha256 string"


def _subtrees(rows: list[dict]) -> Iterator[tuple]:
    """Sums over the nodes of one shard, sorted parents first, that belong to it."""
    saved, leaves, children = ([0] * len(rows) for _ in range(3))
    for i in range(len(rows) - 1, -1, -1):
        r = rows[i]
        if r["own"]:
            saved[i] += (r["n_convs"] - 1) * r["bytes"]
            leaves[i] += r["leaf"]
        up = r["parent"]
        if up >= 0:
            saved[up] += saved[i]
            leaves[up] += leaves[i]
            children[up] += r["own"]
    for i, r in enumerate(rows):
        if r["own"]:
            above = rows[r["parent"]]["conv_id"] if r["parent"] >= 0 else None
            yield r["key"], saved[i], leaves[i], children[i], r["conv_id"], r["depth"], above, r["n_convs"], r["ends_sha256"]
        elif saved[i] or leaves[i] or children[i]:
            yield r["key"], saved[i], leaves[i], children[i], None, None, None, None, None


def _sums(batches: Batches) -> Batches:
    def rows() -> Iterator[tuple]:
        shard, group = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["part"], r["shard"]) != shard:
                    yield from _subtrees(group)
                    shard, group = (r["part"], r["shard"]), []
                group.append(r)
        yield from _subtrees(group)

    yield from _tables(rows(), _SUMS)


def prefix_trie(turns: DataFrame, family: int = 1, borrowed: Borrowed | None = None) -> DataFrame:
    """Every distinct conversation prefix: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key``.

    ``turns`` has ``conv_id, turn`` (long), ``role, text``; other columns are ignored. Turns are ordered by ``turn`` (null first),
    equal ones by role and then by digest; repeated rows are repeated turns. Null roles and texts are
    empty. Rows without ``conv_id`` belong to no conversation and are left out. An empty table gives no nodes.

    With ``borrowed``, conversation ``c`` starts with the first ``borrowed(c)`` turns of conversation ``c - c % family`` (all if it has
    fewer, none if it is absent), followed by its own turns after that many.

    A node is a sequence of ``depth`` turns (role, text); ``conv_id`` its smallest member, ``n_convs`` its members, ``n_leaves`` the
    childless nodes of its subtree, itself included, ``saved_tokens`` the sum over its subtree of ``n_convs - 1`` times
    the UTF-8 bytes of a node's last text, ``ends_sha256`` the digest of the comma-joined ids that end there, ``key`` the digest of
    its path. Texts stay where they are read; digests of 16 bytes are shuffled. A conversation is rebuilt in one task, with
    memory in proportion to its number of turns; the end list of a node is digested in one pass, as SHA-256 asks for.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = pick(turns, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    slim = named.select(
        # Rounded down also for negative ids, without leaving the range of a long.
        (F.expr(f"conv_id div {family}") - F.expr(f"IF(conv_id < 0 AND conv_id % {family} <> 0, 1, 0)")).alias("family"),
        "conv_id", "turn", role.alias("role"), F.octet_length(text).cast("long").alias("bytes"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("digest"),
    )
    dealt = slim.repartitionByRange(partitions(turns), "family").sortWithinPartitions("family", "conv_id", "turn", "role", "digest")
    local = stored(dealt.drop("turn", "role").mapInArrow(partial(_tries, family=family, borrowed=borrowed), _LOCAL_DDL), "trie")

    n = partitions(turns)
    merged = local.select("key", "part", "shard", "depth", "bytes", "n", "first", "n_ends", "ends")
    merged = merged.repartition(n, "key").sortWithinPartitions("key", "part", "shard").mapInArrow(_merge, _MERGED_DDL)
    known = local.select("part", "shard", "node", "parent", "key", "first").join(merged, "key").withColumn("own", F.expr("first = conv_id")).drop("first")
    sums = known.repartition(n, "part", "shard").sortWithinPartitions("part", "shard", "node").mapInArrow(_sums, _SUMS_DDL)
    return sums.groupBy("key").agg(
        F.max("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_conv_id").alias("parent_conv_id"),
        F.max("n_convs").alias("n_convs"), F.sum("children").alias("n_children"), F.sum("leaves").alias("n_leaves"),
        F.sum("saved").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"),
    )
