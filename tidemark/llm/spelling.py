"""Spelling variants: words that differ by one inserted, deleted or replaced character.

Of two such words one half agrees exactly: the error lies in the other. A search scheme therefore matches
either half of a word in an index and extends the match across the other half, allowing one error there.

The index is a bidirectional FM-index over a delimited vocabulary ``#word#word#``: the Burrows-Wheeler transforms of the text and
of its reverse, with the intervals of a pattern among the sorted suffixes of both kept in step, so that a match can grow on either side.

No index holds the whole vocabulary. Words meet in buckets that share the exact half of a search (and the length of the word
searched for); tasks index blocks of buckets. A bucket that many words share is split: its error
region is halved again, until buckets are small or the region is a single character. That changes the work, never the result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, in_blocks, partitions, pick, stored, texts
from tidemark.session import cut_lineage

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10  # a word's form has so many times its occurrences
TALLY = 200_000  # distinct words a task counts before it hands them on
BLOCK_CHARS = 1 << 16  # of the words of an index; one bucket at least
LARGE_BUCKET = 4096  # rows of a bucket that is not split
WORD = re.compile("[a-zÀ-ÿ]+")

Slip = Callable[[int | None, str], str]

# -- vocabulary ----------------------------------------------------------------


def _tally(batches: Batches, least: int, slip: Slip | None) -> Batches:
    found = re.compile(WORD.pattern[:-1] + "{%d,}" % least).findall  # runs are maximal, shorter ones cannot become words
    counts: Counter[str] = Counter()

    def handed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in in_blocks(batches):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text")), strict=True):
            runs = found(text.encode().lower().decode())  # bytes have lower case for A-Z only
            if slip is None:
                counts.update(runs)
                continue
            for run, n in Counter(runs).items():
                word = slip(doc_id, run)
                if len(word) >= least:
                    counts[word] += n
        if len(counts) > TALLY:
            yield handed()
            counts.clear()
    if counts:
        yield handed()


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: Slip | None = None) -> DataFrame:
    """``word, n`` of every word in ``doc_id, text``: runs of letters a-z (A-Z lower-cased) and U+00C0 to U+00FF.

    ``slip`` may change a run by its document. Tasks count before words are shuffled.
    """
    tallied = pick(docs, "doc_id", "text").mapInArrow(partial(_tally, least=least_length, slip=slip), "word string, n long")
    return tallied.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# -- buckets --------------------------------------------------------------------

KEYS = "bucket long, path string, size int, word string, n long"


def region(size: int, path: str) -> tuple[int, int, list[int]]:
    """Where the error of a word of ``size`` characters lies after halving its region along ``path`` (``R`` keeps the
    right half, ``L`` the left), and the ends of those left halves that must not agree, so that a pair is found once."""
    a, b, cuts = 0, size, []
    for side in path:
        mid = (a + b) // 2
        if side == "R":
            a = mid
        else:
            b = mid
            cuts.append(mid)
    return a, b, cuts


def _bucket(word: str, size: int, path: str) -> int:
    a, b, _ = region(size, path)
    exact = f"{path} {size} {word[:a]} {word[len(word) - (size - b) :] if b < size else ''}"
    return xxhash.xxh3_64_intdigest(exact) - (1 << 63)


def _keys(batches: Batches) -> Batches:
    """Buckets of words: as they come, for each size a near word can have; or split further, for rows with a path."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096).to_pydict()
            rows = []
            if "path" in part:
                for path, size, word, n in zip(part["path"], part["size"], part["word"], part["n"], strict=True):
                    rows += [(_bucket(word, size, path + side), path + side, size, word, n) for side in "RL"]
            else:
                for word, n in zip(part["word"], part["n"], strict=True):
                    sizes = (len(word) - 1, len(word), len(word) + 1)
                    rows += [(_bucket(word, size, side), side, size, word, n) for size in sizes for side in "RL" if size]
            types = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["bucket", "path", "size", "word", "n"])


def _buckets(vocabulary: DataFrame, large: int) -> DataFrame:
    """Rows of all searches, in buckets of at most ``large`` rows where halving can bring that about."""
    done, todo = None, vocabulary.mapInArrow(_keys, KEYS)
    while True:
        counts = todo.groupBy("bucket").agg(F.count("*").alias("rows"), F.max("size").alias("size"), F.first("path").alias("path"))
        left = F.col("size") / F.pow(F.lit(2.0), F.length("path"))
        hot = cut_lineage(counts.where((F.col("rows") > large) & (left > 1)).select("bucket"))
        if hot.isEmpty():
            return todo if done is None else done.unionByName(todo)
        cold = todo.join(hot, "bucket", "left_anti").select(*todo.columns)
        done = cold if done is None else done.unionByName(cold)
        split = todo.join(hot, "bucket", "left_semi").select("path", "size", "word", "n")
        todo = stored(split.mapInArrow(_keys, KEYS), "split_buckets")


# -- index --------------------------------------------------------------------


def suffix_ranks(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``text`` in order, by doubling the length compared; the last code is unique."""
    n, bits = len(text), int(text.max()).bit_length()
    step = max(1, 62 // max(1, bits))
    padded = np.concatenate((text, np.zeros(step, dtype=np.int64)))
    key = np.zeros(n, dtype=np.int64)
    for k in range(step):
        key = (key << bits) | padded[k : k + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranks = np.empty(n, dtype=np.int64)
        ranks[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        if ranks[order[-1]] == n - 1:
            return order
        behind = np.zeros(n, dtype=np.int64)
        if step < n:
            behind[: n - step] = ranks[step:] + 1
        key, step = ranks * (n + 1) + behind, 2 * step


class Transform:
    """Burrows-Wheeler transform of a text with counts of every code in, and of smaller codes before, any prefix."""

    def __init__(self, text: np.ndarray, codes: int) -> None:
        self.order = suffix_ranks(text)
        bwt = text[self.order - 1]
        kinds = np.arange(codes)[:, None]
        pad = np.full(-len(bwt) % 64 + 64, codes, dtype=np.int64)
        wide = np.concatenate((bwt, pad))
        self.equal = self._rows(wide == kinds)
        self.less = self._rows(wide < kinds)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=codes))))[:codes]

    @staticmethod
    def _rows(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.packbits(flags, axis=1, bitorder="little").view("<u8")
        sums = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        return words, np.concatenate((np.zeros((len(words), 1), np.int64), sums[:, :-1]), axis=1)

    @staticmethod
    def count(rows: tuple[np.ndarray, np.ndarray], code: np.ndarray, at: np.ndarray) -> np.ndarray:
        words, sums = rows
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return sums[code, word] + np.bitwise_count(words[code, word] & below)


class Match:
    """Matches of patterns: query, suffix interval in the text and in its reverse."""

    __slots__ = ("query", "own", "other", "size")

    def __init__(self, query: np.ndarray, own: np.ndarray, other: np.ndarray, size: np.ndarray) -> None:
        self.query, self.own, self.other, self.size = query, own, other, size

    def __len__(self) -> int:
        return len(self.query)

    def at(self, which: np.ndarray) -> Match:
        return Match(self.query[which], self.own[which], self.other[which], self.size[which])

    @staticmethod
    def join(parts: list[Match]) -> Match:
        return Match(*[np.concatenate([getattr(p, c) for p in parts]) for c in Match.__slots__])


def _grown(side: Transform, m: Match, code: np.ndarray) -> tuple[Match, np.ndarray]:
    """Matches with ``code`` added on the side of ``side``, whose interval is ``own``; and which of them there are."""
    low = side.count(side.equal, code, m.own)
    size = side.count(side.equal, code, m.own + m.size) - low
    there = np.flatnonzero(size > 0)
    m, code, low, size = m.at(there), code[there], low[there], size[there]
    smaller = side.count(side.less, code, m.own + m.size) - side.count(side.less, code, m.own)
    return Match(m.query, side.first[code] + low, m.other + smaller, size), there


class Index:
    """Bidirectional FM-index of distinct words: codes 0 ends the text, 1 delimits words, letters follow."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        line = "#" + "#".join(words) + "#"
        raw = np.frombuffer(line.encode("utf-32-le"), dtype="<u4")
        letters = np.unique(raw[raw != 35])
        self.letters = letters
        text = np.where(raw == 35, 1, np.searchsorted(letters, raw) + 2).astype(np.int64)
        self.starts = np.flatnonzero(text == 1)[:-1]
        codes = len(letters) + 2
        end = np.zeros(1, dtype=np.int64)
        self.left = Transform(np.concatenate((text, end)), codes)
        self.right = Transform(np.concatenate((text[::-1], end)), codes)
        self.n, self.codes = len(text) + 1, codes

    def coded(self, word: str) -> np.ndarray:
        """Codes of an indexed word between delimiters."""
        raw = np.frombuffer(word.encode("utf-32-le"), dtype="<u4")
        return np.concatenate(([1], np.searchsorted(self.letters, raw) + 2, [1]))

    def search(self, queries: list[tuple[int, int, int]], forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Words with one error against word ``i`` inside its characters ``a`` to ``b``, for each ``(i, a, b)``: queries, words.

        Forward, patterns grow to the right from the delimiter before a word, else to the left from the one behind it.
        """
        if not queries:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        side = self.right if forward else self.left
        step = 1 if forward else -1
        rows = [self.coded(self.words[i])[::step] for i, _, _ in queries]
        sizes = np.array([len(r) for r in rows])
        chars, base = np.concatenate(rows), np.concatenate(([0], np.cumsum(sizes)[:-1]))
        # Steps 1 to len(word) match characters, here in the direction of growth.
        low = np.array([a + 1 if forward else size - 1 - b for (_, a, b), size in zip(queries, sizes.tolist())])
        high = np.array([b + 1 if forward else size - 1 - a for (_, a, b), size in zip(queries, sizes.tolist())])
        every = np.arange(len(queries))
        zero = np.zeros(len(queries), dtype=np.int64)
        exact, wrong = Match(every, zero, zero, zero + self.n), Match(every[:0], zero[:0], zero[:0], zero[:0])
        letters = np.arange(2, self.codes)
        found = []
        p = 0
        while len(exact) or len(wrong):
            now, later = [wrong], []
            here = exact.at(np.flatnonzero((p >= low[exact.query]) & (p <= high[exact.query])))
            if len(here):
                wide = here.at(np.repeat(np.arange(len(here)), len(letters)))
                code = np.tile(letters, len(here))
                more, there = _grown(side, wide, code)
                now.append(more)  # a character too many in the word found
                inside = p < high[more.query]
                other = chars[np.minimum(base[more.query] + p, len(chars) - 1)] != code[there]
                later.append(more.at(np.flatnonzero(inside & other)))  # another character
                later.append(here.at(np.flatnonzero(p < high[here.query])))  # a character too few
            wrong = Match.join(now)
            if len(wrong):
                grown, _ = _grown(side, wrong, chars[base[wrong.query] + p])
                last = p == sizes[grown.query] - 1
                found.append(grown.at(np.flatnonzero(last)))
                later.append(grown.at(np.flatnonzero(~last)))
            wrong = Match.join(later) if later else wrong
            exact = exact.at(np.flatnonzero(p < high[exact.query]))
            if len(exact):
                exact, _ = _grown(side, exact, chars[base[exact.query] + p])
            p += 1
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        whole = Match.join(found)
        suffix = whole.other if forward else whole.own  # interval among the suffixes of the text itself
        word = np.searchsorted(self.starts, self.left.order[suffix])
        pairs = np.unique(whole.query * len(self.words) + word)
        return pairs // len(self.words), pairs % len(self.words)


# -- search --------------------------------------------------------------------

NEAR = "word string, n_near long, near string, near_n long"


def _best(rows: list[tuple[str, str, int]]) -> Iterator[tuple[str, int, str, int]]:
    """For the searches of a block (path, word, n of all rows in it): word, near words found, the most frequent of them."""
    counts = {word: n for _, _, word, n in rows}
    words = list(counts)
    place = {w: i for i, w in enumerate(words)}
    index = Index(words)
    searches: dict[bool, list[tuple[int, int, int]]] = {True: [], False: []}
    cuts: dict[bool, list[list[int]]] = {True: [], False: []}
    for path, size, word, _ in rows:
        if size == len(word):
            a, b, ends = region(size, path)
            forward = a >= size - b  # the longer exact part first
            searches[forward].append((place[word], a, b))
            cuts[forward].append(ends)
    for forward, queries in searches.items():
        best: dict[int, tuple[int, int, str]] = {}
        for q, v in zip(*[x.tolist() for x in index.search(queries, forward)], strict=True):
            word, near = words[queries[q][0]], words[v]
            # A pair whose left half agrees is found by the other search.
            if any(word[:cut] == near[:cut] for cut in cuts[forward][q]):
                continue
            seen, n, name = best.get(q, (0, 0, ""))
            own = counts[near]
            if own > n or (own == n and near < name):
                n, name = own, near
            best[q] = (seen + 1, n, name)
        for q, (seen, n, name) in best.items():
            yield words[queries[q][0]], seen, name, n


def _search(batches: Batches) -> Batches:
    """Near words in each block of buckets; rows are sorted by bucket."""

    def found(rows: list) -> pa.RecordBatch:
        columns = zip(*out) if (out := list(_best(rows))) else [[]] * 4
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["word", "n_near", "near", "near_n"])

    block, chars, last, own = [], 0, None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("bucket", "path", "size", "word", "n")]
        for bucket, *row in zip(*columns, strict=True):
            if bucket != last:
                if len(own) > 1:  # a word alone has no near one
                    block += own
                    chars += sum(len(r[2]) for r in own)
                last, own = bucket, []
                if chars > BLOCK_CHARS:
                    yield found(block)
                    block, chars = [], 0
            own.append(row)
    if len(own) > 1:
        block += own
    if block:
        yield found(block)


def near_words(vocabulary: DataFrame, large: int = LARGE_BUCKET) -> DataFrame:
    """``word, n_near, near, near_n``: number of words in ``word, n`` that differ by one character, and the most frequent of
    them (ties: the smallest in code-point order). Words without a near one are left out."""
    rows = _buckets(vocabulary, large).repartition(partitions(vocabulary), "bucket").sortWithinPartitions("bucket")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = rows.mapInArrow(_search, NEAR).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slip: Slip | None = None,
    large: int = LARGE_BUCKET,
) -> DataFrame:
    """Words and the form each is a variant of: ``word, n, n_near, form, form_n, root``.

    ``docs`` has ``doc_id`` and ``text``; other columns are ignored. Words are the runs of :func:`word_counts` with at least
    ``least_length`` code points and ``least_count`` occurrences. A word's form is its most frequent near word, if that
    has at least ``ratio`` times its occurrences, else null; ``root`` follows forms to the last and is the word itself without one. Null
    and empty texts have no words; repeated rows count again; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms lead to a root only if each is more frequent than its variants")
    vocabulary = stored(word_counts(docs, least_length, least_count, slip), "vocabulary")
    near = near_words(vocabulary, large)
    fits = F.col("near_n") >= ratio * F.col("n")
    known = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n")
    )
    known = stored(known, "forms")
    # Occurrences grow by the ratio with every form, so paths are short; each round doubles the steps taken.
    roots = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = cut_lineage(roots.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        roots = further.select("word", "root")
        if further.where("_moved").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
