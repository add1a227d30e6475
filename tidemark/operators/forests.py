"""Importance of a random forest that is grown from counts of rows with equal bins.

Trees see a row only as the bins of its features and its label. Rows that agree in them form a cell, and of a cell of
``n`` rows a bootstrap with Poisson(1) draws for each row takes Poisson(n) rows, so cells stand for their rows without
loss: the table is read once, and every level of the trees reads cells. Where no two rows agree, cells are rows; tasks
still hold a block of cells and one histogram per tree, never the draws.

Definitions are those of Spark ML: bins from a sample of 10,000 rows or more, features drawn for each node, gini or
variance, leaves of one parent with equal predictions merged, importances summed per tree to one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BINS = 32
SAMPLE_ROWS = 10_000  # from which bins are made, at least
SAMPLE_VALUES = 1 << 20  # more rows, as long as they have no more values
WORD_BINS = 12  # bins of five bits in a long
PENDING_ROWS = 1 << 20  # that a task holds before it adds up equal ones
PART_CELLS = 1 << 14  # cells of a part, up to MOST_PARTS parts; then parts grow
MOST_PARTS = 192
LARGEST_PART = 1 << 22
BLOCK_CELLS = 1 << 16
HISTOGRAM_BYTES = 64 << 20  # of the trees that a pass grows
MOST_CLASSES = 100

Batches = Iterator[pa.RecordBatch]


def thresholds(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Upper ends of all bins but the last: between all values if they are few, else of about equally many rows."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2
    if len(middles) < bins:
        return middles
    stride, out = len(values) / bins, []
    ends = np.cumsum(counts)
    target = stride
    for i in range(1, len(found)):
        if abs(ends[i - 1] - target) < abs(ends[i] - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def _added(y: np.ndarray, words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal cells as one."""
    order = np.lexsort((y, *words))
    y, words, n = y[order], words[:, order], n[order]
    first = np.ones(len(y), dtype=bool)
    first[1:] = (y[1:] != y[:-1]) | (words[:, 1:] != words[:, :-1]).any(axis=0)
    at = np.flatnonzero(first)
    return y[at], words[:, at], np.add.reduceat(n, at) if len(at) else n


def cells(df: DataFrame, columns: Sequence[str], label: str, cuts: list[np.ndarray], classes: bool) -> DataFrame:
    """``y, w0, w1, ..., n``: label, bins of the columns in words, and rows of every cell, in parts and an order that depend on the cells alone."""
    count = -(-len(columns) // WORD_BINS)
    words = [f"w{i}" for i in range(count)]

    def binned(batches: Batches) -> Batches:
        held: list[tuple] = []

        def settle() -> tuple:
            parts = [np.concatenate(p, axis=-1) for p in zip(*held, strict=True)]
            held[:] = [_added(*parts)]
            return held[0]

        def given() -> Batches:
            y, w, n = settle()
            held.clear()
            for a in range(0, len(y), BLOCK_CELLS):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + BLOCK_CELLS]) for x in (y, *w, n)], names=["y", *words, "n"])

        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            if not np.isfinite(y).all() or classes and not ((y >= 0) & (y < MOST_CLASSES) & (y == np.floor(y))).all():
                raise ValueError(f"labels must be numbers{f' of classes from 0 to {MOST_CLASSES - 1}' if classes else ''}")
            w = np.zeros((count, len(y)), dtype=np.int64)
            for i, cut in enumerate(cuts):
                x = batch.column(i + 1).to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    raise ValueError(f"infinite values in {columns[i]}")
                w[i // WORD_BINS] |= np.searchsorted(cut, x, side="left") << (5 * (i % WORD_BINS))
            held.append((y, w, np.ones(len(y), dtype=np.int64)))
            if sum(len(h[0]) for h in held) > PENDING_ROWS and len(settle()[0]) > PENDING_ROWS // 2:
                yield from given()
        if held:
            yield from given()

    schema = ", ".join(["y double", *[f"{w} long" for w in words], "n long"])
    found = df.select(F.col(label).cast("double"), *columns).mapInArrow(binned, schema)
    found = cut_lineage(found.groupBy("y", *words).agg(F.sum("n").alias("n")))
    many = found.count()
    parts = max(1, min(-(-many // PART_CELLS), MOST_PARTS), -(-many // LARGEST_PART))
    return cut_lineage(found.repartition(parts, "y", *words).sortWithinPartitions("y", *words))


def _blocks(batches: Batches, columns: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Labels, bins by column, and rows of about ``BLOCK_CELLS`` cells."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_CELLS:
            yield _unpacked(pa.Table.from_batches(held), columns)
            held = []
    if held:
        yield _unpacked(pa.Table.from_batches(held), columns)


def _unpacked(block: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = [block.column(1 + i).to_numpy() for i in range(-(-columns // WORD_BINS))]
    bins = np.stack([(words[i // WORD_BINS] >> (5 * (i % WORD_BINS)) & (BINS - 1)).astype(np.uint8) for i in range(columns)])
    return block.column("y").to_numpy(), bins, block.column("n").to_numpy()


class Forest:
    """Nodes of all trees, numbered as in a heap."""

    def __init__(self, trees: int, depth: int) -> None:
        shape = (trees, (2 << depth) - 1)
        self.feature = np.full(shape, -1, dtype=np.int32)  # -1: no split
        self.cut = np.zeros(shape, dtype=np.int32)  # bins up to it go left
        self.gain = np.zeros(shape)  # times the rows of the node
        self.predicted = np.full(shape, np.nan)

    def importances(self, columns: int) -> np.ndarray:
        total = np.zeros(columns)
        for feature, gain, predicted in zip(self.feature.copy(), self.gain, self.predicted, strict=True):
            for node in reversed(range(len(feature) // 2)):
                left, right = 2 * node + 1, 2 * node + 2
                if feature[node] >= 0 and feature[left] < 0 and feature[right] < 0 and predicted[left] == predicted[right]:
                    feature[node] = -1
            split = feature >= 0
            own = np.bincount(feature[split], weights=gain[split], minlength=columns)
            total += own / own.sum() if own.sum() else 0
        return total / total.sum() if total.sum() else total


def _impurity(stats: np.ndarray, classes: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and impurity of sums along the last axis: rows by class, or rows, labels and squares."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if classes:
            rows = stats.sum(axis=-1)
            return rows, 1 - ((stats / rows[..., None]) ** 2).sum(axis=-1)
        rows, mean = stats[..., 0], stats[..., 1] / stats[..., 0]
        return rows, stats[..., 2] / rows - mean * mean


def _best(stats: np.ndarray, chosen: np.ndarray, ends: np.ndarray, classes: bool) -> list[tuple]:
    """Split of each node, from sums by node, drawn feature and bin: ``node, feature, cut, gain, left, right``."""
    left = stats.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    rows, impurity = _impurity(whole, classes)
    (n_left, i_left), (n_right, i_right) = _impurity(left, classes), _impurity(right, classes)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = impurity - n_left / rows * i_left - n_right / rows * i_right
    valid = (np.arange(BINS) < ends[chosen][..., None]) & (n_left >= 1) & (n_right >= 1)
    gain = np.where(valid, gain, 0.0).reshape(len(stats), -1)
    predict = (lambda s: float(s.argmax())) if classes else (lambda s: float(s[1] / s[0]))
    out = []
    for node, at in enumerate(gain.argmax(axis=1).tolist()):
        if gain[node, at] > 0:
            f, cut = divmod(at, BINS)
            out.append((node, int(chosen[node, f]), cut, float(gain[node, at] * rows[node, f, 0]), predict(left[node, f, cut]), predict(right[node, f, cut])))
    return out


def _grown(table: DataFrame, forest: Forest, trees: range, level: int, chosen: np.ndarray, ends: np.ndarray, classes: int, seed: int) -> None:
    """Split the nodes of a level of some trees; ``chosen`` has the features drawn by tree and node."""
    nodes, drawn, columns = 1 << level, chosen.shape[2], len(ends)
    shape = (nodes, drawn, BINS, classes or 3)
    feature, cut = forest.feature, forest.cut

    def sums(batches: Batches) -> Batches:
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        total = np.zeros((len(trees), *shape))
        for y, x, n in _blocks(batches, columns):
            each = np.arange(len(y))
            for t, tree in enumerate(trees):
                rows = np.random.default_rng([seed, tree, part, start]).poisson(n).astype(float)
                node = np.zeros(len(y), dtype=np.int64)
                for above in range(level):
                    own = feature[tree, node]
                    node = np.where(own >= 0, 2 * node + 1 + (x[own, each] > cut[tree, node]), node)
                at = np.flatnonzero((node >= nodes - 1) & (rows > 0))
                local, rows, label = node[at] - (nodes - 1), rows[at], y[at]
                for f in range(drawn):
                    cell = (local * drawn + f) * BINS + x[chosen[tree, local, f], at]
                    if classes:
                        flat = np.bincount(cell * classes + label.astype(np.int64), weights=rows, minlength=total[t].size)
                        total[t] += flat.reshape(shape)
                    else:
                        for s, weights in enumerate((rows, rows * label, rows * label * label)):
                            total[t, ..., s] += np.bincount(cell, weights=weights, minlength=total[t, ..., s].size).reshape(shape[:-1])
            start += len(y)
        for t, tree in enumerate(trees):
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([part]), pa.array([total[t].tobytes()], pa.binary())], names=["tree", "part", "sums"])

    def splits(batches: Batches) -> Batches:
        def found(tree: int, total: np.ndarray) -> pa.RecordBatch:
            best = _best(total, chosen[tree], ends, classes > 0)
            columns = [pa.array([b[k] for b in best], kind) for k, kind in enumerate([pa.int64()] * 3 + [pa.float64()] * 3)]
            return pa.RecordBatch.from_arrays([pa.array([tree] * len(best), pa.int64()), *columns], names=["tree", "node", "feature", "cut", "gain", "l", "r"])

        tree, total = None, None
        for batch in batches:
            for t, s in zip(batch.column("tree").to_pylist(), batch.column("sums"), strict=True):
                own = np.frombuffer(s.as_buffer()).reshape(shape)
                if t != tree:
                    if tree is not None:
                        yield found(tree, total)
                    tree, total = t, np.zeros(shape)
                total += own
        if tree is not None:
            yield found(tree, total)

    added = table.mapInArrow(sums, "tree long, part long, sums binary").repartition(min(len(trees), 32), "tree").sortWithinPartitions("tree", "part")
    schema = "tree long, node long, feature long, cut long, gain double, l double, r double"
    for r in added.mapInArrow(splits, schema).collect():  # a row per node
        node = nodes - 1 + r.node
        forest.feature[r.tree, node], forest.cut[r.tree, node], forest.gain[r.tree, node] = r.feature, r.cut, r.gain
        forest.predicted[r.tree, 2 * node + 1], forest.predicted[r.tree, 2 * node + 2] = r.l, r.r


def importances(df: DataFrame, columns: Sequence[str], label: str, classes: bool, trees: int, depth: int, rows: int, seed: int) -> np.ndarray:
    """Importance of each column to the label, in a forest over all ``rows`` rows of ``df``; columns are doubles without missing values."""
    k = len(columns)
    wanted = max(SAMPLE_ROWS, min(SAMPLE_VALUES // k, 1 << 17))
    sample = df.select(*columns) if rows <= wanted else df.select(*columns).sample(wanted / rows, seed)
    seen = sample.toArrow()
    cuts = [thresholds(seen.column(i).to_numpy()) for i in range(k)]
    ends = np.array([len(c) for c in cuts])
    table = cells(df, columns, label, cuts, classes)
    many = int(table.agg(F.max("y")).first()[0]) + 1 if classes else 0
    drawn = k if trees == 1 else int(np.ceil(np.sqrt(k))) if classes else -(-k // 3)
    forest = Forest(trees, depth)
    for level in range(depth):
        nodes = 1 << level
        rng = np.random.default_rng([seed, level])
        chosen = rng.random((trees, nodes, k)).argsort(axis=2)[:, :, :drawn]
        together = max(1, HISTOGRAM_BYTES // (nodes * drawn * BINS * (many or 3) * 8))
        for first in range(0, trees, together):
            _grown(table, forest, range(first, min(first + together, trees)), level, chosen, ends, many, seed)
    return forest.importances(k)
