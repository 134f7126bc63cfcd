"""Gradient-boosted trees for a bounded sample on the driver or for a table of any size; scoring runs in tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks add gradients up as whole numbers of this fraction, so that the order of rows does not matter.
UNIT = 1 / (1 << 24)
#: The quantiles of a feature at which it may be cut.
BINS = 32


@dataclass(frozen=True)
class BoostedTrees:
    """Complete binary trees: node k of a level-order array has children 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 for each row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _gains(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """What each cut of each node gains, from sums of gradient and curvature up to each bin."""
    all_g, all_h = g[:, -1:], h[:, -1:]
    return (
        g[:, :-1] ** 2 / (h[:, :-1] + ridge)
        + (all_g - g[:, :-1]) ** 2 / (all_h - h[:, :-1] + ridge)
        - all_g**2 / (all_h + ridge)
    )


def fit_boosted(
    x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = BINS, ridge: float = 1.0
) -> BoostedTrees:
    """Trees for the logistic loss; cuts are taken from `bins` quantiles of each feature.

    With one class missing, or no rows, there are no trees and every row has the log odds of the
    smoothed share of class 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    if not 0 < y.sum() < len(y):
        return BoostedTrees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)), start)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1)
    margin = np.full(len(x), start)
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = y - p, p * (1 - p)
        feature = np.zeros(inner, dtype=np.int64)
        cut = np.full(inner, np.inf)
        node = np.zeros(len(x), dtype=np.int64)
        for level in range(depth):
            first = 2**level - 1
            size = 2**level
            best = np.full(size, 1e-6)
            at = node - first
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                key = at * width + binned[:, f]
                g = np.bincount(key, gradient, size * width).reshape(size, width).cumsum(axis=1)
                h = np.bincount(key, curve, size * width).reshape(size, width).cumsum(axis=1)
                gain = _gains(g, h, ridge)
                top = gain.argmax(axis=1)
                value = gain[np.arange(size), top]
                better = value > best
                best[better] = value[better]
                feature[first : first + size][better] = f
                cut[first : first + size][better] = c[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - inner
        leaf = rate * np.bincount(at, gradient, inner + 1) / (np.bincount(at, curve, inner + 1) + ridge)
        margin += leaf[at]
        trees.append((feature, cut, leaf))
    return BoostedTrees(*[np.array(part) for part in zip(*trees)], start)


def in_bins(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """For each value how many cuts of its feature lie below it."""
    return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T)], axis=1).astype(np.uint8)


def bin_bytes(column: pa.Array) -> np.ndarray:
    """Rows of a binary column as bins, one byte for each feature."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def fit_boosted_table(
    rows: DataFrame, cuts: Sequence[np.ndarray], rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0
) -> BoostedTrees:
    """The trees of `fit_boosted` from all rows of a table: `bins` (see `in_bins`), `right`, `n` (how often).

    Every level of a tree is one pass over the table, from which the driver receives sums for each
    node, feature and bin, a few thousand numbers whatever the number of rows.
    """
    total, ones = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("right").cast("int")), F.lit(0))).first()
    share = (ones + 0.5) / (total + 1)
    start = float(np.log(share / (1 - share)))
    inner = 2**depth - 1
    nothing = (np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not 0 < ones < total:
        return BoostedTrees(*nothing, start)
    # Cuts are held as numbers of bins while the trees grow.
    grown: list[tuple] = []
    for _ in range(rounds):
        trees = BoostedTrees(*([np.array(part) for part in zip(*grown)] if grown else nothing), start)
        feature = np.zeros(inner, dtype=np.int64)
        cut = np.full(inner, np.inf)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            sums = _level_sums(rows, trees, feature, cut, level, len(cuts))
            best = np.full(size, 1e-6)
            left = np.stack([sums[:, :, 0].sum(axis=2), np.zeros((2, size))], axis=2)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                g, h = sums[:, :, f, : len(c) + 1].cumsum(axis=2)
                gain = _gains(g, h, ridge)
                top = gain.argmax(axis=1)
                at = np.arange(size)
                better = gain[at, top] > best
                best[better] = gain[at, top][better]
                feature[first : first + size][better] = f
                cut[first : first + size][better] = top[better]
                below, whole = np.stack([g[at, top], h[at, top]]), np.stack([g[:, -1], h[:, -1]])
                left[:, better] = np.stack([below, whole - below], axis=2)[:, better]
        # What the last cuts leave on either side is what the leaves hold.
        g, h = left.reshape(2, -1)
        grown.append((feature, cut, rate * g / (h + ridge)))
    feature, at, leaf = [np.array(part) for part in zip(*grown)]
    real = [[cuts[f][int(k)] if k < np.inf else np.inf for f, k in zip(*tree)] for tree in zip(feature, at)]
    return BoostedTrees(feature, np.array(real), leaf, start)


def _level_sums(
    rows: DataFrame, trees: BoostedTrees, feature: np.ndarray, cut: np.ndarray, level: int, width: int
) -> np.ndarray:
    """Sums of gradient and curvature by node of a level of the tree that grows, feature and bin."""
    size = 2**level
    shape = (size, width, BINS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size * width * BINS), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = bin_bytes(batch.column("bins"))
            n = batch.column("n").to_numpy()
            p = 1 / (1 + np.exp(-trees.margin(x)))
            at = np.arange(len(x))
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(level):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            right = batch.column("right").to_numpy(zero_copy_only=False).astype(float)
            cells = ((node - (size - 1))[:, None] * width + np.arange(width)) * BINS + x
            for k, value in enumerate((right - p, p * (1 - p))):
                np.add.at(total[k], cells, (np.rint(value / UNIT).astype(np.int64) * n)[:, None])
        cell = np.nonzero(total.any(axis=0))[0]
        yield pa.RecordBatch.from_pydict({"cell": cell, "g": total[0, cell], "h": total[1, cell]})

    found = rows.select("bins", "right", "n").mapInArrow(sums, "cell long, g long, h long")
    table = found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    out = np.zeros((2, size * width * BINS))
    out[:, table["cell"].to_numpy()] = np.stack([table["g"].to_numpy(), table["h"].to_numpy()]) * UNIT
    return out.reshape(2, *shape)
