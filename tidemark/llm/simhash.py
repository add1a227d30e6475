"""Near-duplicate search by SimHash and covering locality-sensitive hashing.

Every bit position gets a non-zero vector of ``radius + 1`` bits; a mask keeps the positions whose
vector has odd overlap with the mask's number. The vectors of at most ``radius`` differing
positions never span the whole space, so some mask keeps none of them: every pair within the
radius shares a bucket of some of the ``2 ** (radius + 1) - 1`` tables, and no pair is lost.

Near copies of a corpus (:func:`keep_one`) are the components of :func:`near_duplicates` as far as their
texts verify them; a prefix filter on shingle sets finds the pairs beyond the radius.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, give_back, in_blocks, partitions, pick, stored, texts
from tidemark.llm.graph import components
from tidemark.session import cut_lineage, drop_unused

BITS = 64
SEED = 42  # of XXH64 and of the masks
SMALL_BUCKET = 64  # distinct fingerprints compared pair by pair; larger buckets take another exact way
SHARD_CHARS = 8 << 20  # bytes of shingle hashes in a block of documents compared with each other
BLOCK_DOCS = 256  # documents in such a block
SMALL_GROUP = 64  # documents of a bucket of shingles that gives its pairs; larger ones are compared in blocks
SAMPLE_DOCS = 16384  # documents in which common shingles are looked for
HOT_DOCS = 4  # of them have a common shingle
HOT_SHINGLES = 1 << 16  # common shingles at most
SKETCH_LONGS = (4, 32)  # words of a parity sketch: least and most
SKETCH_DOCS = 2048  # documents in a block whose sketches are compared with each other
FILTER_LONGS = 1 << 20  # words of the bitmap of ids that are looked for, at most


def covering_masks(radius: int, seed: int = SEED) -> list[int]:
    """Bit masks of the tables, as signed longs."""
    space = (1 << (radius + 1)) - 1
    vectors = [1 + i % space for i in range(BITS)]
    random.Random(seed).shuffle(vectors)
    masks = []
    for number in range(1, space + 1):
        mask = sum(1 << i for i, v in enumerate(vectors) if (v & number).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def word_list(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode().lower().split()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """All runs of ``n`` words joined by a space; fewer words give one run, none gives none."""
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return [line[a:b] for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def _bits(hashes: np.ndarray) -> int:
    """Fingerprint as a signed long: a bit is set where over half of the hashes have it.

    Bits are counted in bytes, eight to a machine word, so 255 rows are added at a time.
    """
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 255 << 8):
        part = hashes[start : start + (255 << 8)]
        rows = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        for k in range(0, len(rows), 255):
            ones += rows[k : k + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _hashes(features: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(f, SEED) for f in features], dtype="<u8")


def majority(features: list[bytes]) -> int:
    return _bits(_hashes(features)) if features else 0


def _fingerprint(batches: Batches, words: int) -> Batches:
    for batch in in_blocks(batches):
        values = [majority(shingles(word_list(t), words)) for t in texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp``: SimHash over all runs of ``words`` words."""
    return pick(docs, "doc_id", "text").mapInArrow(partial(_fingerprint, words=words), "doc_id long, fp long")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """``a, b``: links between ``node`` values that connect all fingerprints ``fp`` of one series ``s``
    within ``radius`` bits. A node has one fingerprint in a series, and a fingerprint one node.

    Buckets of up to ``SMALL_BUCKET`` fingerprints give their pairs. Larger ones emit no pairs. For a radius of 1 or 2 their members are laid out by every
    value that differs in one bit at most: those that meet are at most 2 bits apart, two that are at
    most 2 apart do meet, and no such group has more than 65 members, so a star per group gives the
    same components (for radius 1 members of a group are compared in pairs).
    """
    if radius > 2:
        raise ValueError("the exact way for large buckets covers a radius of at most 2")
    masks = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in covering_masks(radius)])
    # Few bytes become many rows: spread them before, as adaptive execution would join the parts.
    spread = fps.select("s", "fp", "node").repartition(partitions(fps))
    laid = spread.select("s", "fp", "node", F.posexplode(masks).alias("t", "key"))
    table = ["s", "t", "key"]
    sizes = laid.groupBy(*table).agg(F.count("*").alias("n")).where("n > 1")
    shared = laid.join(sizes, table)

    def pairs(limit: int) -> str:
        both = "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x AS a, y AS b))))"
        return f"filter({both}, p -> bit_count(p.a.fp ^ p.b.fp) <= {limit})"

    def compared(groups: DataFrame, limit: int) -> DataFrame:
        return groups.select(F.explode(F.expr(pairs(limit))).alias("p")).select(F.col("p.a.node").alias("a"), F.col("p.b.node").alias("b"))

    members = F.collect_list(F.struct("fp", "node")).alias("m")
    small = compared(shared.where(F.col("n") <= SMALL_BUCKET).groupBy(*table).agg(members), radius)
    large = shared.where(F.col("n") > SMALL_BUCKET)
    around = [F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(m)) for m in (*[1 << i for i in range(BITS - 1)], -(1 << 63))]]
    met = (
        large.select("s", "fp", "node").distinct().select("s", "fp", "node", F.explode(F.array(*around)).alias("z"))
        .groupBy("s", "z").agg(members).where("size(m) > 1")
    )
    if radius == 2:
        star = met.select(F.explode("m.node").alias("a"), F.array_min("m.node").alias("b")).where("a <> b")
    else:
        star = compared(met, radius)
    return small.unionAll(star).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """Group of every document: ``doc_id, fingerprint, component_id``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored. One row per input
    row comes back. A-Z count as a-z, words stand between ASCII white space, shingles keep repeats.
    Null, empty and white texts have fingerprint zero, which links like any other. Documents link
    when at most ``radius`` (1 or 2) bits differ; ``component_id`` is the smallest ``doc_id``
    reachable over links, the document's own included. Null ids take part but never name a
    component unless all its ids are null. Repeated rows come back repeated; an empty table gives none.
    """
    marked = cut_lineage(fingerprints(docs, words))
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = classes.select(F.lit(0).alias("s"), "fp", F.col("fp").alias("node"))
    labels = components(links(nodes, radius)).withColumnRenamed("node", "fp")
    rooted = classes.join(labels, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    found = marked.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def _shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``words`` words."""
    return np.unique(np.array([xxhash.xxh3_64_intdigest(s) for s in shingles(word_list(text), words)], dtype=np.uint64))


def _sampled(batches: Batches, words: int) -> Batches:
    for batch in in_blocks(batches):
        for text in texts(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(_shingle_set(text, words).view(np.int64))], names=["h"])


def _hot(docs: DataFrame, words: int) -> np.ndarray:
    """Sorted hashes of shingles that are common in a bounded sample of documents."""
    rows = max(docs.count(), 1)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) < int(min(1, SAMPLE_DOCS / rows) * (1 << 30))
    counts = docs.where(chosen).mapInArrow(partial(_sampled, words=words), "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).collect()
    return np.sort(np.array([r.h for r in top], dtype=np.int64).view(np.uint64))


def _prefixes(batches: Batches, words: int, similarity: float, hot: np.ndarray) -> Batches:
    empty = np.zeros(0, dtype=np.int64)
    for batch in in_blocks(batches):
        prefixes, sizes = [empty], []
        for text in texts(batch.column("text")):
            own = _shingle_set(text, words)
            late = np.isin(own, hot, assume_unique=True)
            ordered = np.concatenate((own[~late], own[late]))
            prefixes.append(ordered[: len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1].view(np.int64))
            sizes.append(len(own))
        lengths = [len(p) for p in prefixes[1:]]
        ids = np.repeat(batch.column("doc_id").to_numpy(), lengths)
        m = np.repeat(np.array(sizes, dtype=np.int32), lengths)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(prefixes)), pa.array(ids), pa.array(m)], names=["h", "doc_id", "m"])


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Sketch of a set of hashes: every bit is the parity of the number of hashes that fall on it.

    Two sketches differ in no more bits than the sets differ in members. A sketch twice as long becomes the shorter one
    when its halves are combined by exclusive or. Beyond the longest sketch more pairs of different sets look near.
    """
    longs, most = SKETCH_LONGS
    while longs < most and 64 * longs < len(hashes):
        longs *= 2
    odd = np.bincount((hashes % np.uint64(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _sketched(batches: Batches, words: int) -> Batches:
    for batch in in_blocks(batches):
        sets = [_shingle_set(t, words) for t in texts(batch.column("text"))]
        columns = [batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int32()), pa.array([_parity(x) for x in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "m", "s"])


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def _star_links(batches: Batches, words: int, similarity: float) -> Batches:
    """Members like the centre of their star; rows are sorted by star, its centre first."""
    star, centres = None, []
    for batch in in_blocks(batches):
        found = []
        keys = zip(*[batch.column(c).to_pylist() for c in ("a", "salt", "member", "doc_id")], strict=True)
        for (a, salt, member, doc_id), text in zip(keys, texts(batch.column("text")), strict=True):
            if (a, salt) != star:
                star, centres = (a, salt), []
            own = _shingle_set(text, words)
            if not member:
                centres.append(own)
            elif any(_alike(own, c, similarity) for c in centres):
                found.append((a, doc_id))
        yield _pairs_batch(found)


def _block_links(batches: Batches, words: int, similarity: float) -> Batches:
    """Links between the rows of each group that other links do not connect already."""

    def linked(group: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        found, sizes = [], np.array([len(g[2]) for g in group])
        label = np.unique([g[1] for g in group], return_inverse=True)[1]
        for i in range(1, len(group)):
            low, high = np.minimum(sizes[:i], sizes[i]), np.maximum(sizes[:i], sizes[i])
            for j in np.flatnonzero((low >= similarity * high - 1e-9) & (label[:i] != label[i])).tolist():
                if label[j] != label[i] and _alike(group[i][2], group[j][2], similarity):
                    found.append((group[j][0], group[i][0]))
                    label[label == label[i]] = label[j]
        return found

    current, group = None, []
    for batch in in_blocks(batches):
        keys = zip(*[batch.column(c).to_pylist() for c in ("h", "x", "y", "doc_id", "root")], strict=True)
        for (h, x, y, doc_id, root), text in zip(keys, texts(batch.column("text")), strict=True):
            if (h, x, y) != current:
                yield _pairs_batch(linked(group))
                current, group = (h, x, y), []
            group.append((doc_id, root, _shingle_set(text, words)))
    yield _pairs_batch(linked(group))


def _perhaps(ids: DataFrame) -> Column:
    """Whether ``doc_id`` may be one of ``ids``: true for each of them and for few others, so that few texts go through the exchange of a join.

    A bitmap of hashes with 64 bits or more for each id, as far as ``FILTER_LONGS`` goes; beyond it more others get through.
    """
    longs = 1 << min(ids.count(), FILTER_LONGS - 1).bit_length()
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(64 * longs).cast("long"))
    word, bit = F.floor(place / 64), F.pmod(place, F.lit(64)).cast("int")
    marks = ids.groupBy(word.alias("id")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("x"))
    every = ids.sparkSession.range(longs).join(marks, "id", "left").select(F.struct("id", F.coalesce("x", F.lit(0).cast("long")).alias("x")).alias("e"))
    bitmap = every.agg(F.sort_array(F.collect_list("e"))["x"]).scalar()
    return F.bit_get(F.get(bitmap, word.cast("int")), bit) == 1


def _links_of_stars(ours: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those distinct ``a, b`` pairs whose texts are alike. The pairs of an ``a`` are dealt out in parts."""
    parts = F.ceil(F.col("n") / BLOCK_DOCS)
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), parts).alias("salt"), F.lit(1).alias("member"), F.col("b").alias("doc_id"))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))
    centres = sizes.select("a", salts.alias("salt"), F.lit(0).alias("member"), F.col("a").alias("doc_id"))
    sought = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    rows = members.unionAll(centres).join(ours.where(_perhaps(sought)), "doc_id").select("a", "salt", "member", "doc_id", "text")
    return (
        rows.repartition(partitions(ours), "a", "salt").sortWithinPartitions("a", "salt", "member")
        .mapInArrow(partial(_star_links, words=words, similarity=similarity), "a long, b long")
    )


def _near_links(ours: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those links of the smallest document of each SimHash component to its others that texts verify."""
    found = near_duplicates(ours).where("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    return _links_of_stars(ours, cut_lineage(found.distinct()), words, similarity)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those ``a, b`` pairs that ``node, root`` does not connect."""
    for c in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def _fit(one: str, other: str, similarity: float) -> str:
    """SQL: whether sizes ``m`` and sketches ``s`` of two structs allow the similarity.

    Sets of ``m`` and ``m'`` members with that similarity differ in ``(1 - similarity) / (1 + similarity) * (m + m')`` members
    at most, and their sketches in no more bits. Their sizes are near, so one sketch is at most twice as long as the other.
    """
    folded = "IF(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (u, v) -> u ^ v), {0})"
    x, y = folded.format(f"{one}.s", f"{other}.s"), folded.format(f"{other}.s", f"{one}.s")
    differ = f"aggregate(zip_with({x}, {y}, (u, v) -> bit_count(u ^ v)), 0, (t, n) -> t + n)"
    return (
        f"IF(least({one}.m, {other}.m) >= {similarity}D * greatest({one}.m, {other}.m) - 1e-9D,"
        f" {differ} <= {(1 - similarity) / (1 + similarity)}D * ({one}.m + {other}.m) + 1e-6D, false)"
    )


def _fitting(m: np.ndarray, root: np.ndarray, sketches: list[np.ndarray], similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a bucket, each with others of other roots whose sizes and sketches allow the similarity as in :func:`_fit`; a pair once."""
    longs = np.array([len(s) for s in sketches])
    for size in np.unique(longs).tolist():
        at = np.flatnonzero(longs >= size)
        folded = np.stack([np.bitwise_xor.reduce(sketches[j].reshape(-1, size), axis=0) for j in at])
        for row in np.flatnonzero(longs[at] == size).tolist():
            i = at[row]
            near = np.minimum(m[at], m[i]) >= similarity * np.maximum(m[at], m[i]) - 1e-9
            others = np.flatnonzero(near & (root[at] != root[i]) & ((longs[at] > size) | (at < i)))
            differ = np.bitwise_count(folded[others] ^ folded[row]).sum(axis=1, dtype=np.int64)
            found = at[others[differ <= (1 - similarity) / (1 + similarity) * (m[at[others]] + m[i]) + 1e-6]]
            if len(found):
                yield i, found


def _fitting_rows(batches: Batches, keys: tuple[str, ...], similarity: float, pairs: bool) -> Batches:
    """Of each bucket, whose rows follow each other, its fitting pairs or the members that are in one of them."""

    names = ["k", "a", "m", "b", "o"] if pairs else ["h", "doc_id"]
    ready: list[list[np.ndarray]] = []

    def settle(key: tuple, group: list[tuple]) -> None:
        ids, m, root = (np.array([g[k] for g in group], dtype=np.int64) for k in range(3))
        if len(group) < 2 or root.min() == root.max():
            return
        for i, j in _fitting(m, root, [g[3] for g in group], similarity):
            if pairs:
                first, i = ids[i] < ids[j], np.full(len(j), i)
                a, b = np.where(first, i, j), np.where(first, j, i)
                ready.append([np.full(len(j), key[1]), ids[a], m[a], ids[b], m[b]])
            else:
                own = ids[np.append(j, i)]
                ready.append([np.full(len(own), key[0]), own])

    def given() -> pa.RecordBatch:
        columns = [pa.array(np.concatenate(c)) for c in zip(*ready, strict=True)] or [pa.array([], pa.int64())] * len(names)
        ready.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    current, group = (), []
    for batch in batches:
        sketch = batch.column("s")
        ends, values = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint64)
        rows = zip(*[batch.column(c).to_pylist() for c in (*keys, "doc_id", "m", "root")], strict=True)
        for n, row in enumerate(rows):
            if row[: len(keys)] != current:
                if group:
                    settle(current, group)
                current, group = row[: len(keys)], []
            group.append((*row[len(keys) :], values[ends[n] : ends[n + 1]]))
        yield given()
    if group:
        settle(current, group)
    yield given()


def _pairs_within(rooted: DataFrame, similarity: float) -> DataFrame:
    """``k, p`` for the pairs ``p`` of different roots in each bucket whose sizes and sketches ``s`` allow the similarity."""
    spread = rooted.select("h", "k", "doc_id", "m", "root", "s").repartition(partitions(rooted), "h", "k").sortWithinPartitions("h", "k")
    pairs = spread.mapInArrow(partial(_fitting_rows, keys=("h", "k"), similarity=similarity, pairs=True), "k long, a long, m long, b long, o long")
    one, other = (F.struct(F.col(d).alias("doc_id"), F.col(n).alias("m")) for d, n in (("a", "m"), ("b", "o")))
    return pairs.select("k", F.struct(one.alias("a"), other.alias("b")).alias("p"))


def _fitting_members(rooted: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """``h, doc_id`` of the documents of large buckets that fit another one of another root there; their sketches meet in pairs of blocks."""
    rows = _met(rooted, SKETCH_DOCS, None).join(sketches, ["doc_id", "m"]).select("h", "x", "y", "doc_id", "m", "root", "s")
    spread = rows.repartition(partitions(rooted), "h", "x", "y").sortWithinPartitions("h", "x", "y")
    return spread.mapInArrow(partial(_fitting_rows, keys=("h", "x", "y"), similarity=similarity, pairs=False), "h long, doc_id long").distinct()


def _frequent(rooted: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a, b`` of different roots that share enough prefix shingles in buckets of bounded size.

    Of sets of ``m`` and ``m'`` shingles that share ``o`` of them, the first ``m - o + l`` and ``m' - o + l`` share ``l`` at
    least. A pair that shares a larger bucket too may fall out here, as it meets there.
    """
    pairs = _pairs_within(rooted, similarity)
    shared = pairs.groupBy(F.col("p.a.doc_id").alias("a"), F.col("p.b.doc_id").alias("b"), F.col("p.a.m").alias("m"), F.col("p.b.m").alias("o")).agg(F.sum("k").alias("k"))
    overlap = F.ceil(similarity / (1 + similarity) * (F.col("m") + F.col("o")) - 1e-9)
    least = overlap + 1 - F.ceil(similarity * F.greatest("m", "o") - 1e-9)
    return shared.where(F.col("k") >= least).select("a", "b").distinct()


def _met(rooted: DataFrame, docs: int | None = None, chars: int | None = 0) -> DataFrame:
    """Buckets of several roots as pairs of blocks ``h, x, y`` of bounded size, in some of which any two documents meet.

    A block has about ``docs`` documents and ``chars`` bytes of hashes, ``BLOCK_DOCS`` and ``SHARD_CHARS`` unless given, or any
    number of bytes (None).
    """
    by_docs = F.count("*") / (docs or BLOCK_DOCS)
    blocks = F.ceil(by_docs if chars is None else F.greatest(by_docs, F.sum("m") * 8 / (chars or SHARD_CHARS)))
    ends = (F.min("root").alias("low"), F.max("root").alias("high"))
    unsettled = rooted.groupBy("h").agg(blocks.alias("blocks"), *ends).where("low < high").select("h", "blocks")
    laid = rooted.join(unsettled, "h").select("h", "doc_id", "m", "root", "blocks", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("blocks")).alias("i"))
    spread = laid.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return spread.select("h", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "doc_id", "m", "root")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``doc_id, root`` of every document that is connected to another one: components of all pairs whose
    ``words``-word shingle sets have a Jaccard similarity of ``similarity`` or more. No pair is left out.

    First come the components of :func:`near_duplicates`, whose documents are verified against the smallest one. SimHash
    misses pairs beyond its radius; an exact way for the rest follows.

    Under any common order of shingles, such sets share one of the first ``m - ceil(similarity * m) + 1``
    of either (prefix filter), so documents meet in buckets of equal prefix shingles. The order is by hash, shingles
    common in a sample last; it changes the work, never the result. Buckets with the same documents count once.
    Every bucket is a star around its smallest document, as far as SimHash did not connect them. A bucket that verified links connect is done.
    Others of up to ``SMALL_GROUP`` documents give those pairs whose sketches are near, of which those that share enough prefix shingles are verified; the
    documents of larger ones that have a partner of near sketch there meet in pairs of blocks of at most about ``BLOCK_DOCS`` documents and
    ``SHARD_CHARS`` bytes of hashes, where pairs not connected yet are verified. Texts go through an exchange only for such pairs.
    """
    ours = pick(docs, "doc_id", "text").where("doc_id IS NOT NULL")
    near_links = stored(_near_links(ours, words, similarity), "near_links")
    near = cut_lineage(components(near_links))
    drop_unused(docs.sparkSession)
    prefixes = partial(_prefixes, words=words, similarity=similarity, hot=_hot(ours, words))
    # One exchange finds the shingles of two documents or more; most occur once and are left behind there.
    counted = F.count("*").over(Window.partitionBy("h"))
    prefix = ours.mapInArrow(prefixes, "h long, doc_id long, m int").withColumn("n", counted).where("n > 1")
    drop_unused(docs.sparkSession)
    met = stored(prefix, "prefixes")
    drop_unused(docs.sparkSession)
    # The sum and the exclusive or of 64-bit hashes stand for the documents of a bucket.
    mark = F.xxhash64("doc_id")
    marked = met.groupBy("h", "n").agg(
        F.min(F.struct("doc_id", "m")).alias("low"), F.bit_xor(mark).alias("p"), F.sum(F.pmod(mark, F.lit(1 << 30))).alias("q")
    )
    buckets = cut_lineage(marked.groupBy("n", "low", "p", "q").agg(F.min("h").alias("h"), F.count("*").alias("k")).select("h", "low", "k"))
    shared = stored(met.join(buckets, "h"), "buckets")
    give_back(met)
    drop_unused(docs.sparkSession)

    fits = F.least("m", "low.m") >= similarity * F.greatest("m", "low.m") - 1e-9
    stars = shared.where(F.col("doc_id") != F.col("low.doc_id")).where(fits).select(F.col("low.doc_id").alias("a"), F.col("doc_id").alias("b"))
    # Sketches are small: they tell which texts are worth an exchange.
    sketches = stored(ours.mapInArrow(partial(_sketched, words=words), "doc_id long, m int, s array<long>").distinct(), "sketches")
    apart = _apart(stars.distinct(), near)
    for c in ("a", "b"):
        apart = apart.join(sketches.select(F.col("doc_id").alias(c), F.struct("m", "s").alias(f"of_{c}")), c)
    apart = cut_lineage(apart.where(_fit("of_a", "of_b", similarity)).select("a", "b").distinct())
    star_links = stored(_links_of_stars(ours, apart, words, similarity), "star_links")
    drop_unused(docs.sparkSession)
    roots = cut_lineage(components(near_links.unionAll(star_links))).withColumnRenamed("node", "doc_id")

    rooted = shared.where("n > 2").join(roots, "doc_id", "left").select("h", "n", "k", "doc_id", "m", F.coalesce("root", "doc_id").alias("root"))
    few = cut_lineage(_frequent(rooted.where(F.col("n") <= SMALL_GROUP).join(sketches, ["doc_id", "m"]), similarity))
    pair_links = stored(_links_of_stars(ours, few, words, similarity), "pair_links")
    drop_unused(docs.sparkSession)
    large = rooted.where(F.col("n") > SMALL_GROUP)
    fitting = cut_lineage(_fitting_members(large, sketches, similarity))
    blocks = cut_lineage(_met(large.join(fitting, ["h", "doc_id"], "left_semi")))
    sought = blocks.select("doc_id").distinct()
    more = (
        blocks.join(ours.where(_perhaps(sought)), "doc_id").select("h", "x", "y", "doc_id", "root", "text")
        .repartition(partitions(ours), "h", "x", "y").sortWithinPartitions("h", "x", "y", "doc_id")
        .mapInArrow(partial(_block_links, words=words, similarity=similarity), "a long, b long")
    )
    block_links = stored(more, "block_links")
    drop_unused(docs.sparkSession)
    groups = components(near_links.unionAll(star_links).unionAll(pair_links).unionAll(block_links)).withColumnRenamed("node", "doc_id")
    give_back(shared, sketches, near_links, star_links, pair_links, block_links)
    return groups


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies; all columns stay.

    Groups are those of :func:`similar_groups`. The longest document of a group stays, of equally long ones that
    with the smallest ``doc_id``. Documents without words stay (they are no copies of a text). Rows are told
    apart by ``doc_id``; rows with a null id always stay.
    """
    gone = cut_lineage(_gone(docs, words, similarity))
    drop_unused(docs.sparkSession)
    perhaps = _perhaps(gone)
    # Only rows that may have to go take part in an exchange.
    return docs.where(~perhaps).unionAll(docs.where(perhaps).join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]))


def _gone(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """``doc_id`` of the documents that do not stay."""
    groups = cut_lineage(similar_groups(docs, words, similarity))
    sizes = pick(docs, "doc_id", "text").select("doc_id", F.length("text").alias("n")).join(groups, "doc_id")
    first = sizes.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("shorter"), "doc_id")).alias("best")).select("best.doc_id")
    return groups.join(first, "doc_id", "left_anti").select("doc_id")
