"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is a row of symbols, at first its characters. An agenda orders all adjacent pairs whose
joined string is a piece by the piece's score, then from left to right; the first pair is
merged and its neighbours' pairs enter the agenda, until none is left. Text is cut at places that no
piece spans, and the agendas of all new segments of a batch advance together as arrays, one
merge per segment and round. Segments of more than ``LONG`` characters have a heap as agenda. Every new
segment is checked against the sentencepiece library in the same Arrow batch.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable
from functools import partial

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame

from tidemark.llm.common import Batches, Remembered, blocks, kept_by_worker, pick, texts

SPACE = "▁"  # stands for a blank inside pieces
LONG = 256  # characters of a segment from which a heap is used
TOGETHER = 8192  # segments whose agendas advance together
CACHED = 250_000  # segments a worker remembers, and as many old ones
BLOCK_CHARS = 1 << 20  # bytes of text that are worked on at once
BARRIER = "\ue000"  # a character no vocabulary joins with others; fences a segment for the check
NONE = np.iinfo(np.int64).max


def _families(pieces: Iterable[str]) -> list[list[str]]:
    """Characters that pieces chain together as neighbours, blanks aside; largest family first."""
    parent: dict[str, str] = {}

    def top(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for p in pieces:
        p = p.lstrip(SPACE)
        for a, b in zip(p, p[1:], strict=False):
            parent[top(a)] = top(b)
    families: dict[str, list[str]] = {}
    for c in sorted(parent):
        families.setdefault(top(c), []).append(c)
    return sorted(families.values(), key=len, reverse=True)


class Vocabulary:
    """Pieces of a model file, the pairs that may merge, and the segments encoded so far."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        size = sp.get_piece_size()
        self.end = sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(size)]
        pieces = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(sp.is_unused(i) for i in range(size)) or not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("the vocabulary must have byte pieces and no unused ones")
        for probe in ("a", " a  b ", "\t\n AÅＡ▁ x", "fiﬁ"):
            if sp.normalize(probe) != self.normal(probe):
                raise ValueError("the model changes texts before it encodes them")
        # Symbols: pieces by id, then characters that are only parts of pieces.
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - symbols.keys()):
            symbols[c] = size + len(symbols)
        self.span = max(symbols.values()) + 1
        self.symbols = symbols
        self.pieces = pieces
        self.of_char = np.full(0x110000, -1, dtype=np.int64)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        scores = np.array([sp.get_score(i) for i in range(size)])
        # Equal scores share a rank: then the left pair goes first.
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        merged = {
            symbols[p[:k]] * self.span + symbols[p[k:]]: i
            for p, i in pieces.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        }
        self.pair_keys = np.array(sorted(merged), dtype=np.int64)
        self.pair_into = np.array([merged[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        # No piece holds a blank behind another character, nor two neighbours of different families.
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces)
        some = "|".join(f"[{''.join(map(re.escape, f))}]+" for f in _families(pieces))
        self.cut = None if inner else re.compile(f"{SPACE}*(?:{some}|[^{SPACE}])|{SPACE}+", re.DOTALL)
        self.known = Remembered(CACHED)
        self.pairs: dict[int, int] | None = None

    @staticmethod
    def normal(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def segments(self, text: str) -> list[str]:
        """Parts that no piece spans."""
        whole = self.normal(text)
        return self.cut.findall(whole) if self.cut else [whole] * bool(whole)

    # -- agendas ---------------------------------------------------------------

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or NONE) and merged symbol of pairs."""
        keys = np.where((left < 0) | (right < 0), -1, left * self.span + right)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        into = self.pair_into[at]
        return np.where(self.pair_keys[at] == keys, self.rank[into], NONE), into

    def merge_all(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which segment, how many symbols, and the final symbols of all in turn.

        -1 - c stands for a character c that no piece holds.
        """
        sizes = np.array([len(s) for s in segments], dtype=np.int64)
        points = np.frombuffer("".join(segments).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sym = self.of_char[points]
        sym = np.where(sym < 0, -1 - points, sym)
        done: list[tuple[np.ndarray, ...]] = []
        names = np.arange(len(segments))
        last = np.zeros(len(sym), dtype=bool)
        last[np.cumsum(sizes) - 1] = True
        right = np.append(sym[1:], -1)
        rank, into = self._pairs(sym, np.where(last, -1, right))
        while len(names):
            starts = np.cumsum(sizes) - sizes
            # Agenda of each segment: lowest rank, then leftmost place.
            order = np.where(rank == NONE, NONE, (rank << 32) | np.arange(len(rank)))
            best = np.minimum.reduceat(order, starts)
            alive = best != NONE
            if not alive.all():
                keep = np.repeat(alive, sizes)
                done.append((names[~alive], sizes[~alive], sym[~keep]))
                moved = np.cumsum(keep) - 1
                sym, rank, into, last = sym[keep], rank[keep], into[keep], last[keep]
                names, sizes, best = names[alive], sizes[alive], best[alive]
                at = moved[best & 0xFFFFFFFF]
            else:
                at = best & 0xFFFFFFFF
            if not len(names):
                break
            sym[at] = into[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), dtype=bool)
            keep[at + 1] = False
            sym, rank, into, last = sym[keep], rank[keep], into[keep], last[keep]
            sizes = sizes - 1
            at = at - np.arange(len(at))
            touched = np.concatenate([at, at[(at > 0) & ~last[at - 1]] - 1])
            nxt = sym[np.minimum(touched + 1, len(sym) - 1)]
            rank[touched], into[touched] = self._pairs(sym[touched], np.where(last[touched], -1, nxt))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def merge_long(self, segment: str) -> np.ndarray:
        """The same for one long segment, by a heap of pairs and linked symbols."""
        points = np.frombuffer(segment.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        sym = self.of_char[points]
        sym = np.where(sym < 0, -1 - points, sym)
        rank, into = self._pairs(sym[:-1], sym[1:])
        items, n = sym.tolist(), len(sym)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        agenda = [(r, i, items[i], items[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), into.tolist(), strict=True)) if r != NONE]
        heapq.heapify(agenda)
        table = self._table()
        while agenda:
            _, i, a, b, m = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or items[i] != a or j >= n or items[j] != b:
                continue
            items[i], gone[j] = m, True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := table.get(items[left] * self.span + items[right])) is not None:
                    heapq.heappush(agenda, (int(self.rank[found]), left, items[left], items[right], found))
        return np.array([x for x, g in zip(items, gone, strict=True) if not g], dtype=np.int64)

    def _table(self) -> dict[int, int]:
        if self.pairs is None:
            self.pairs = dict(zip(self.pair_keys.tolist(), self.pair_into.tolist(), strict=True))
        return self.pairs

    # -- encoding --------------------------------------------------------------

    def _ids(self, symbols: np.ndarray) -> list[int]:
        """Ids of symbols; those that are no pieces fall back to their bytes."""
        names = {i: c for c, i in self.symbols.items() if i >= len(self.rank)}
        out: list[int] = []
        for s in symbols.tolist():
            if 0 <= s < len(self.rank):
                out.append(s)
            else:
                out += [self.bytes[b] for b in (chr(-1 - s) if s < 0 else names[s]).encode()]
        return out

    def learn(self, segments: list[str], check: bool) -> None:
        """Encode new segments; with ``check`` compare each with the library."""
        known = self.known
        for s in segments:
            if len(s) > LONG:
                known[s] = np.array(self._ids(self.merge_long(s)), dtype="<i4").tobytes()
        short = sorted([s for s in segments if len(s) <= LONG], key=len)
        for start in range(0, len(short), TOGETHER):
            part = short[start : start + TOGETHER]
            which, sizes, symbols = self.merge_all(part)
            ends = np.cumsum(sizes)
            raw = symbols.astype("<i4").tobytes()
            for k, a, b in zip(which.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                known[part[k]] = raw[4 * a : 4 * b]
            odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.rank)))
            for k in np.unique(np.searchsorted(ends, odd, "right")).tolist():
                own = symbols[ends[k] - sizes[k] : ends[k]]
                known[part[which[k]]] = np.array(self._ids(own), dtype="<i4").tobytes()
        if check:
            fence = self.library.encode(BARRIER)
            for start in range(0, len(segments), TOGETHER):
                part = segments[start : start + TOGETHER]
                theirs = self.library.encode([BARRIER + s.replace(SPACE, " ") for s in part], num_threads=1)
                head = len(fence)
                sizes = [len(x) for x in theirs]
                ours = np.frombuffer(b"".join([known[s] for s in part]), dtype="<i4").tolist()
                if [len(known[s]) // 4 + head for s in part] != sizes or fence * len(part) + ours != [
                    *[i for x in theirs for i in x[:head]], *[i for x in theirs for i in x[head:]]
                ]:
                    raise ValueError(f"segments are encoded in another way than by the library: {part[:3]} ...")

    def encode(self, items: list[str], check: bool = True) -> list[np.ndarray]:
        """Ids of every text, end id included."""
        end = np.array([self.end], dtype="<i4").tobytes()
        rows = [self.segments(t) for t in items]
        known = self.known
        new = known.missing(rows)
        if new:
            self.learn(sorted(new), check)
        ids = [np.frombuffer(b"".join([known[s] for s in r]) + end, dtype="<i4") for r in rows]
        known.age()
        return ids


def vocabulary(path: str | None) -> Vocabulary:
    """The vocabulary of this worker; by default the public 32k merge model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return kept_by_worker(f"pieces {path}", lambda: Vocabulary(path))


def _encode(batches: Batches, path: str | None, check: bool, remember: bool = True) -> Batches:
    vocab = vocabulary(path)
    try:
        yield from _encoded(batches, vocab, check)
    finally:
        if not remember:
            vocab.known = Remembered(CACHED)


def _encoded(batches: Batches, vocab: Vocabulary, check: bool) -> Batches:
    for batch in batches:
        for a, b in blocks(batch.column("text"), BLOCK_CHARS):
            ids = vocab.encode(texts(batch.column("text").slice(a, b - a)), check)
            offsets = np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], names=["doc_id", "ids"])


def _decode(batches: Batches, path: str | None) -> Batches:
    library = vocabulary(path).library
    for batch in batches:
        lists = batch.column("ids")
        values, ends = lists.values.to_numpy().tolist(), lists.offsets.to_numpy().tolist()
        rows = [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        decoded = pa.array(library.decode(rows, num_threads=1) if rows else [], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), decoded], names=["doc_id", "ids", "text"])


def _digest(batches: Batches) -> Batches:
    digits = None
    for batch in batches:
        counts, ids_sha, text_sha = [], [], []
        lists = batch.column("ids")
        values, ends = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
        if digits is None or values.max(initial=0) >= len(digits):
            digits = [str(i).encode() for i in range(int(values.max(initial=0)) + 32768)]
        written = [digits[i] for i in values.tolist()]
        for a, b, text in zip(ends, ends[1:], batch.column("text").to_pylist(), strict=False):
            counts.append(b - a)
            ids_sha.append(hashlib.sha256(b" ".join(written[a:b])).hexdigest())
            text_sha.append(hashlib.sha256(text.encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def encode(docs: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """``doc_id, ids``: ids of every whole text with an end id, as the library gives them.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored, each row gives one row.
    A null or empty text has the end id only. ``path`` is a model file that workers can read.
    With ``check`` every new segment is encoded by the library as well and a difference raises.
    """
    return pick(docs, "doc_id", "text").mapInArrow(partial(_encode, path=path, check=check), "doc_id long, ids array<int>")


def encode_decode(docs: DataFrame, path: str | None = None, check: bool = True, remember: bool = True) -> DataFrame:
    """``doc_id, ids, text``: as :func:`encode`, with the text that the library decodes from the ids.

    Without ``remember`` a task gives the memory of its segments back, for jobs whose workers go on to other work.
    """

    def run(batches: Batches) -> Batches:
        return _decode(_encode(batches, path, check, remember), path)

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, text string")


def encode_decode_digests(docs: DataFrame, path: str | None = None, check: bool = True) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of :func:`encode_decode`, in the same Arrow pass."""

    def run(batches: Batches) -> Batches:
        return _digest(_decode(_encode(batches, path, check), path))

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
