"""Second-order histogram boosting of a logistic loss: every level of a tree is one grouped sum of gradients and Hessians.

Values are replaced by their bins once, a block of rows a record, a feature's bins beside each other. A level sums both
derivatives by feature, node and bin, first within each task, and what reaches the driver is features x nodes x bins
numbers, whatever the rows. The last level's sums give the leaves, so a tree takes as many passes as it has levels. Rows
are never shuffled. The margin of finished trees is cached with every tree, from that of ``REFRESH`` trees and fewer new
ones; the former comes straight from the bins, so that a lost executor's part is recomputed in three steps.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import cut_points

#: Trees after which the margin is computed from the bins; between, the new trees' is added to it.
REFRESH = 10
#: Rows of a block at most, and the setting that bounds the blocks handed to Python at once.
BLOCK_ROWS, BATCH = 1 << 14, ("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
#: Cells whose sums meet in one task, about.
SUMS = 1 << 12
BLOCKS = "b binary, y binary, m binary"


@dataclass
class Tree:
    """A full tree: of each inner node, level by level, the feature and the last bin that goes left (-1: all go left); the leaves' values."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    leaf: list[float] = field(default_factory=list)

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node at ``depth`` of each row, a column of ``bins``."""
        rows = np.arange(bins.shape[1])
        at = np.zeros(len(rows), np.int64)
        feature, last = np.array(self.feature, np.int64), np.array(self.bin, np.int64)
        for level in range(depth):
            inner = (1 << level) - 1 + at
            f = feature[inner]
            at = 2 * at + ((f >= 0) & (bins[np.maximum(f, 0), rows] > last[inner]))
        return at


def _margin(trees: Sequence[Tree], depth: int, bins: np.ndarray) -> np.ndarray:
    out = np.zeros(bins.shape[1])
    for tree in trees:
        out += np.array(tree.leaf)[tree.nodes(bins, depth)]
    return out


def _binned(columns: Sequence[pa.Array], cuts: Sequence[np.ndarray], kind: type) -> np.ndarray:
    """A row for each feature: how many of its cuts each value reaches, null and NaN being below all."""
    out = np.zeros((len(columns), len(columns[0])), kind)
    for i, (column, edges) in enumerate(zip(columns, cuts, strict=True)):
        v = column.to_numpy(zero_copy_only=False)
        out[i] = np.where(np.isnan(v), 0, np.searchsorted(edges, v, "right"))
    return out


@dataclass
class Boosted:
    features: tuple[str, ...]
    cuts: list[list[float]]
    depth: int
    base: float
    trees: list[Tree]

    def score(self, df: DataFrame, output: str = "risk_score") -> DataFrame:
        """``df`` with the probability of the class 1; only the features go to Python."""
        trees, depth, base = self.trees, self.depth, self.base
        cuts = [np.array(c, np.float64) for c in self.cuts]

        @F.arrow_udf("double")
        def risk(*columns: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-base - _margin(trees, depth, _binned(columns, cuts, np.int64)))))

        kept = [F.col(f"`{c}`") for c in df.columns if c != output]
        return df.select(*kept, risk(*[F.col(f"`{c}`").cast("double") for c in self.features]).alias(output))


def fit(df: DataFrame, features: Sequence[str], target: str, trees: int = 200, depth: int = 6, rate: float = 0.1, l2: float = 1.0, positive_weight: float = 1.0, bins: int = 32, min_child: float = 1.0) -> Boosted:
    """The model of ``trees`` trees, on rows with a target of 0 or 1; other rows are left out.

    A split's gain is GL^2 / (HL + l2) + GR^2 / (HR + l2) - G^2 / (H + l2), of sums G and H of first and second derivatives;
    either side needs an H of ``min_child``; of equal gains the first feature and bin count. A leaf is -rate G / (H + l2). Positive
    rows weigh ``positive_weight``. Features are cut at approximate quantiles into about ``bins`` bins. The first margin is 0.
    """
    n, cells = len(features), bins + 1
    kind = np.uint8 if cells <= 256 else np.int64
    y = F.col(f"`{target}`").cast("double")
    rows = df.filter(y.isin(0.0, 1.0))
    values = [F.col(f"`{c}`").cast("double") for c in features]
    found = cut_points(rows, [F.nanvl(v, F.lit(None).cast("double")) for v in values], bins)
    model = Boosted(tuple(features), found, depth, 0.0, [])
    cuts = [np.array(c, np.float64) for c in found]

    def pack(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                some = batch.slice(at, BLOCK_ROWS)
                block = _binned(some.columns[:n], cuts, kind).tobytes(), some.column(n).to_numpy().astype(np.int8).tobytes(), np.zeros(some.num_rows).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=["b", "y", "m"])

    def blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for b, label, m in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield np.frombuffer(b, kind).reshape(n, -1), np.frombuffer(label, np.int8), np.frombuffer(m)

    def add_margin(some):
        def run(batches):
            for b, label, m in blocks(batches):
                block = b.tobytes(), label.tobytes(), (m + _margin(some, depth, b)).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in block], names=["b", "y", "m"])

        return run

    def sums(tree, level):
        def run(batches):
            size = cells << level
            g, h = np.zeros((n, size)), np.zeros((n, size))
            for b, label, m in blocks(batches):
                p = 1 / (1 + np.exp(-m))
                w = np.where(label == 1, positive_weight, 1.0)
                first, second = w * (p - label), w * p * (1 - p)
                node = tree.nodes(b, level) * cells
                for f in range(n):
                    g[f] += np.bincount(node + b[f], first, size)
                    h[f] += np.bincount(node + b[f], second, size)
            used = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(g.reshape(-1)[used]), pa.array(h.reshape(-1)[used])], names=["cell", "g", "h"])

        return run

    def totals(state, tree, level):
        """Both derivatives' sums by node, feature and bin."""
        size = n * cells << level
        sent = state.mapInArrow(sums(tree, level), "cell long, g double, h double").repartition(1 + size // SUMS, "cell")  # each task sends a cell once
        met = sent.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
        out = np.zeros((2, size))
        out[:, met["cell"].to_numpy()] = met["g"].to_numpy(), met["h"].to_numpy()
        return out.reshape(2, n, 1 << level, cells).transpose(0, 2, 1, 3)

    conf = df.sparkSession.conf
    before = conf.get(BATCH[0])
    conf.set(*BATCH)
    binned = rows.select(*[v.alias(f"f{i}") for i, v in enumerate(values)], y.alias("y")).mapInArrow(pack, BLOCKS).persist()
    older = state = binned
    done = 0
    try:
        for k in range(trees):
            if k:
                if state is not older:
                    state.unpersist()
                if fresh := k % REFRESH == 0:
                    if older is not binned:
                        older.unpersist()
                    older, done = binned, 0
                state = older.mapInArrow(add_margin(model.trees[done:]), BLOCKS).persist()
                if fresh:
                    older, done = state, k
            tree = Tree()
            for level in range(max(depth, 1)):
                g, h = totals(state, tree, level)
                if not depth:
                    tree.leaf = [float(-rate * g[0, 0].sum() / (h[0, 0].sum() + l2))]
                    break
                for node in range(1 << level):
                    f, last = _split(g[node], h[node], l2, min_child)
                    tree.feature.append(f)
                    tree.bin.append(last)
                    if level == depth - 1:
                        cut = last + 1 if f >= 0 else cells
                        for side in (slice(None, cut), slice(cut, None)):
                            tree.leaf.append(float(-rate * g[node, max(f, 0), side].sum() / (h[node, max(f, 0), side].sum() + l2)))
            model.trees.append(tree)
    finally:
        conf.set(BATCH[0], before)
        for table in (state, older, binned):
            table.unpersist()
    return model


def _split(g: np.ndarray, h: np.ndarray, l2: float, min_child: float) -> tuple[int, int]:
    """The feature and last left bin of the greatest gain, (-1, 0) if none is positive; gains within rounding of it are equal."""
    left_g, left_h = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1]
    all_g, all_h = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - all_g**2 / (all_h + l2)
    gain = np.where((left_h >= min_child) & (right_h >= min_child), gain, -np.inf)
    best = gain.max()
    if not best > 1e-9:
        return -1, 0
    at = int((gain >= best * (1 - 1e-9)).argmax())
    return at // gain.shape[1], at % gain.shape[1]
