"""Language of a text by a bidirectional gated recurrent network over its bytes.

Texts are cut into windows of ``WINDOW`` bytes, so every byte of a text of any length is read, and
a batch of windows moves through the network together. At each byte the states of both directions
give a distribution over the learned languages, which labels the position; a document's
probabilities are the mean over all its positions. The network is trained in numpy by
backpropagation through time on a bounded sample of labelled windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, blocks, pick, texts

WINDOW = 64  # bytes read together
HIDDEN = 8  # units per direction
LANES = 1024  # windows that move together
BLOCK_BYTES = 2 << 20  # of text that is cut into windows at once
PAD = 256  # symbol behind the end of a text
UNDETERMINED = "und"

# Bounds of the training sample.
DOCS_PER_LANGUAGE = 96
PARTS = 64  # of the rows of a language, ranked by themselves first
WINDOWS_PER_DOC = 6
STEPS = 400

_LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    """``x``: (2, 3H, 257) input weights by symbol; ``u``: (2, 3H, H); ``b``: (2, H) bias inside
    the reset gate; ``v``: (L, 2H) and ``c``: (L) of the output. Gates: update, reset, candidate."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    v: np.ndarray
    c: np.ndarray

    @staticmethod
    def fresh(languages: list[str], seed: int, hidden: int = HIDDEN) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        return Network(
            languages,
            draw(2, 3 * hidden, 257, scale=0.3),
            draw(2, 3 * hidden, hidden, scale=hidden**-0.5),
            np.zeros((2, hidden), np.float32),
            draw(len(languages), 2 * hidden, scale=hidden**-0.5),
            np.zeros(len(languages), np.float32),
        )

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.b, self.v, self.c]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(a, out=a)
    np.exp(a, out=a)
    a += 1
    return np.reciprocal(a, out=a)


def _states(net: Network, codes: np.ndarray, tape: list | None = None) -> np.ndarray:
    """States (T, 2, H, B) of both directions in their own reading order; codes: (T, B)."""
    steps, lanes = codes.shape
    hidden = net.b.shape[1]
    h = np.zeros((2, hidden, lanes), np.float32)
    out = np.empty((steps, 2, hidden, lanes), np.float32)
    a = np.empty((2, 3 * hidden, lanes), np.float32)
    bias = net.b[:, :, None]
    for t in range(steps):
        np.take(net.x[0], codes[t], axis=1, out=a[0], mode="clip")
        np.take(net.x[1], codes[steps - 1 - t], axis=1, out=a[1], mode="clip")
        from_h = net.u @ h
        gates = _sigmoid(a[:, : 2 * hidden] + from_h[:, : 2 * hidden])
        update, reset = gates[:, :hidden], gates[:, hidden:]
        inner = from_h[:, 2 * hidden :] + bias
        new = reset * inner
        new += a[:, 2 * hidden :]
        np.tanh(new, out=new)
        before, h = h, h - new
        h *= update
        h += new
        out[t] = h
        if tape is not None:
            tape.append((before, update, reset, inner, new))
    return out


def _distributions(net: Network, states: np.ndarray) -> np.ndarray:
    """(T, L, B) probabilities of the languages at every position."""
    hidden = net.b.shape[1]
    scores = net.v[:, :hidden] @ states[:, 0] + net.v[:, hidden:] @ states[::-1, 1]
    scores += net.c[:, None]
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def _gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross entropy over all real positions, through time."""
    steps, lanes = codes.shape
    hidden = net.b.shape[1]
    tape: list = []
    states = _states(net, codes, tape)
    d = _distributions(net, states)
    d[:, labels, np.arange(lanes)] -= 1
    real = codes != PAD
    d *= real[:, None, :] / real.sum()
    aligned = np.concatenate([states[:, 0], states[::-1, 1]], axis=1)
    dv = np.einsum("tlb,thb->lh", d, aligned, optimize=True)
    dc = d.sum(axis=(0, 2))
    dstate = np.einsum("lh,tlb->thb", net.v, d, optimize=True)
    dx, du, db = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.b)
    dh = np.zeros((2, hidden, lanes), np.float32)
    for t in reversed(range(steps)):
        before, update, reset, inner, new = tape[t]
        dh[0] += dstate[t, :hidden]
        dh[1] += dstate[steps - 1 - t, hidden:]
        dnew = dh * (1 - update) * (1 - new * new)
        dupdate = dh * (before - new) * update * (1 - update)
        dinner = dnew * reset
        dreset = dnew * inner * reset * (1 - reset)
        da = np.concatenate([dupdate, dreset, dnew], axis=1)
        dfrom = np.concatenate([dupdate, dreset, dinner], axis=1)
        du += dfrom @ before.transpose(0, 2, 1)
        db += dinner.sum(axis=2)
        for side, row in ((0, codes[t]), (1, codes[steps - 1 - t])):
            np.add.at(dx[side].T, row, da[side].T)
        dh = dh * update + net.u.transpose(0, 2, 1) @ dfrom
    return [dx, du, db, dv, dc]


def train(windows: list[bytes], labels: list[str], steps: int = STEPS, lanes: int = 96, rate: float = 0.02, seed: int = 7) -> Network:
    """Network fitted by Adam on windows of at most ``WINDOW`` bytes; equal inputs give an equal network."""
    languages = sorted(set(labels))
    net = Network.fresh(languages, seed)
    codes = np.full((WINDOW, len(windows)), PAD, dtype=np.int64)
    for i, w in enumerate(windows):
        codes[: len(w), i] = np.frombuffer(w, np.uint8)[:WINDOW]
    targets = np.array([languages.index(x) for x in labels])
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(w) for w in net.weights()]
    second = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        chosen = rng.integers(0, len(windows), lanes)
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, s in zip(net.weights(), _gradients(net, codes[:, chosen], targets[chosen]), first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            w -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def _learned(docs: DataFrame, docs_per_language: int, most_languages: int | None = None) -> Network | None:
    """Network of the bounded sample: the rows with the smallest hash of ``doc_id`` by language.

    Ranks need ids and languages only and are cut before the shuffle; texts are read for the
    chosen rows, and of those only evenly spaced windows leave the executors.
    """
    marked = pick(docs, "doc_id", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL").where(~_held_out()).distinct()
    if most_languages is not None:
        marked = marked.join(marked.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).select("lang"), "lang")
    # A frequent language is ranked in parts first, so that no task reads all of its rows.
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS))
    in_part = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    few = marked.withColumn("part", part).withColumn("r", in_part).where(F.col("r") <= docs_per_language)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    chosen = few.select("doc_id", "lang", rank.alias("r")).where(F.col("r") <= docs_per_language)
    ids = [tuple(r) for r in chosen.select("doc_id", "lang").collect()]
    if not ids:
        return None
    small = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, lang string"))
    spread = (
        f"array_distinct(transform(sequence(0, {WINDOWS_PER_DOC - 1}), i ->"
        f" substring(text, 1 + int(i * (length(text) / {WINDOWS_PER_DOC})), {WINDOW})))"
    )
    rows = (
        pick(docs, "doc_id", "text", "lang").where("length(text) > 0").join(small, ["doc_id", "lang"])
        .select("doc_id", "lang", F.explode(F.expr(spread)).alias("w")).orderBy("doc_id", "lang", "w").collect()
    )
    windows = [(r.w.encode()[:WINDOW], r.lang) for r in rows if _LETTER.search(r.w)]
    if not windows:
        return None
    return train([w for w, _ in windows], [x for _, x in windows])


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def _windows(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(W, WINDOW) codes of all texts in turn, and the text every window belongs to."""
    raw = [t.encode() for t in items]
    sizes = np.array([len(r) for r in raw], dtype=np.int64)
    counts = -(-sizes // WINDOW)
    codes = np.full(int(counts.sum()) * WINDOW, PAD, dtype=np.int16)
    at = 0
    for r, n in zip(raw, counts.tolist(), strict=True):
        codes[at : at + len(r)] = np.frombuffer(r, np.uint8)
        at += n * WINDOW
    return codes.reshape(-1, WINDOW), np.repeat(np.arange(len(items)), counts)


def _labelled(net: Network, items: list[str], spans: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Per group of windows: owner, sum of the probabilities (W, L), and labels (W, WINDOW) if asked for."""
    codes, owner = _windows(items)
    for start in range(0, len(codes), LANES):
        part = np.ascontiguousarray(codes[start : start + LANES].T)
        d = _distributions(net, _states(net, part))
        labels = d.argmax(axis=1).T.astype(np.int16) if spans else None
        d *= (part != PAD)[:, None, :]
        yield owner[start : start + LANES], d.sum(axis=0).T, labels


def probabilities(net: Network, items: list[str]) -> np.ndarray:
    """(texts, languages): mean over all bytes; zeros for an empty text."""
    total = np.zeros((len(items), len(net.languages)))
    for owner, sums, _ in _labelled(net, items):
        np.add.at(total, owner, sums)
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-9)


def position_labels(net: Network, text: str) -> list[tuple[int, int, str]]:
    """Runs ``(start, end, language)`` of equally labelled bytes of a text, end exclusive."""
    labels = [row for _, _, rows in _labelled(net, [text], spans=True) for row in rows]
    flat = np.concatenate(labels)[: len(text.encode())] if labels else np.zeros(0, np.int16)
    edges = [0, *(np.flatnonzero(np.diff(flat)) + 1).tolist(), len(flat)] if len(flat) else [0]
    return [(a, b, net.languages[flat[a]]) for a, b in zip(edges, edges[1:], strict=False)]


def _verdicts(net: Network | None, column: pa.Array) -> Iterator[tuple[str, float]]:
    """Language and score of every text of a column."""
    for a, b in blocks(column, BLOCK_BYTES):
        items = texts(column.slice(a, b - a))
        found = probabilities(net, items) if net else None
        for i, text in enumerate(items):
            if found is None or not _LETTER.search(text):
                yield UNDETERMINED, 0.0
            else:
                best = int(found[i].argmax())
                yield net.languages[best], min(1.0, float(found[i, best]))


def _predict(batches: Batches, net: Network | None) -> Batches:
    for batch in batches:
        found = list(_verdicts(net, batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("held_out"), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
            names=["doc_id", "held_out", "lang_pred", "score"],
        )


def identify(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """Language of every document: ``doc_id, held_out, lang_pred, score``.

    ``docs`` needs ``doc_id`` (long), ``text`` and ``lang``; other columns are ignored. One row per
    input row comes back. Documents with crc32(doc_id as text) mod 3 = 1 are held out; null ids
    count as not held out but teach nothing. Training reads text and non-null ``lang`` of at most
    ``docs_per_language`` other documents in each language.
    Null texts and texts without a letter are ``und`` with score 0, as are all texts when nothing
    could be learned. ``score`` is the mean probability of the predicted language over all bytes.
    Of tied languages the alphabetically first wins; an empty table gives no rows.
    """
    net = _learned(docs, docs_per_language)
    rows = docs.select(F.col("doc_id"), F.col("text"), _held_out().alias("held_out"))
    return rows.mapInArrow(partial(_predict, net=net), "doc_id long, held_out boolean, lang_pred string, score double")


def _known(batches: Batches, net: Network | None, least_score: float) -> Batches:
    for batch in batches:
        keep = [name != UNDETERMINED and score >= least_score for name, score in _verdicts(net, batch.column("text"))]
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_known(docs: DataFrame, least_score: float = 0.3, docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """``docs`` without those whose language cannot be told; all columns and repeated rows stay.

    Texts without letters go, and texts whose best language has a mean probability under
    ``least_score``. Nothing is kept when no language could be learned.
    """
    net = _learned(docs, docs_per_language)
    return docs.mapInArrow(partial(_known, net=net, least_score=least_score), docs.schema)
