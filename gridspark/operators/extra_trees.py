"""Extremely randomised trees for classification, grown level by level, all trees at once.

Every tree sees all rows (no bagging).  A node draws a few features and one threshold for each, evenly between the least and the
greatest value that its rows have, and splits by the one that lowers the impurity most.  Rows that agree in all features and the class
are one row with their number, which changes no range and no count.  A level takes two aggregates over the rows: ranges of the drawn features by node, then class counts on either side of the thresholds.  Both are combined in each
task and by Spark, so the driver gets numbers for the open nodes only: at most ``trees * 2 ** max_depth`` of them, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows of a partition at least, where there are so many.
PER_PART = 10_000


def _impurity(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Gini impurity or entropy of class counts along the last axis, times the rows."""
    n = counts.sum(axis=-1, keepdims=True)
    p = counts / np.maximum(n, 1)
    if criterion == "gini":
        return (n * (p * (1 - p))).sum(axis=-1)
    return (n * -(p * np.log2(np.where(p > 0, p, 1)))).sum(axis=-1)


@dataclass
class Trees:
    """Nodes of all trees: the feature to split by (-1 in a leaf), its threshold, the left child (the right one follows) and class counts."""

    roots: int
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def add(self, counts: np.ndarray) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.left.append(-1)
        self.counts.append(counts)
        return len(self.feature) - 1

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature), np.array(self.threshold), np.array(self.left)


def _reached(x: np.ndarray, root: int, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf of each row in the tree of a root."""
    at = np.full(len(x), root)
    rows = np.arange(len(x))
    while True:
        f = feature[at]
        inner = f >= 0
        if not inner.any():
            return at
        at = np.where(inner, left[at] + (x[rows, np.maximum(f, 0)] > threshold[at]), at)


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        if len(batch):
            yield np.stack(batch["x"].to_numpy()).astype(float), batch["y"].to_numpy(), batch["n"].to_numpy()


class ExtraTrees:
    """A fitted forest: class shares are the mean of the leaves', the first of several classes wins."""

    def __init__(self, trees: Trees, n_classes: int, features: str = "features") -> None:
        self.trees, self.n_classes, self.features = trees, n_classes, features

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction``."""
        arrays, roots, features = self.trees.arrays(), self.trees.roots, self.features
        counts = np.stack(self.trees.counts)
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)

        @F.pandas_udf("double")
        def predicted(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()).astype(float) if len(x) else np.zeros((0, 1))
            return pd.Series(sum(shares[_reached(rows, r, *arrays)] for r in range(roots)).argmax(axis=1).astype(float) if len(x) else [], dtype=float)

        return df.withColumn("prediction", predicted(vector_to_array(features)))


def fit_extra_trees(df: DataFrame, label: str, n_classes: int, trees: int = 20, criterion: str = "gini", max_depth: int = 10, min_samples_split: int = 2,
                    min_samples_leaf: int = 1, max_features: int | None = None, seed: int = 42, features: str = "features") -> ExtraTrees:
    """Grow ``trees`` over the vectors ``features`` and the codes ``label`` (0 to ``n_classes`` - 1); rows with a NULL in either are left out.

    ``criterion`` is ``gini`` or ``entropy``; ``max_features`` are drawn at each node, the root of their number if None.  A
    node with fewer than ``min_samples_split`` rows is not split, and no leaf has fewer than ``min_samples_leaf``.
    """
    if criterion not in ("gini", "entropy"):
        raise ValueError(f"unknown criterion: {criterion}")
    rows = df.filter(F.col(features).isNotNull() & F.col(label).isNotNull()).select(vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"))
    grouped = rows.groupBy("x", "y").agg(F.count("*").alias("n")).persist()
    rows = grouped.coalesce(ceil(max(1, grouped.count()) / PER_PART))  # few rows, few tasks
    first = rows.first()
    found, rng = Trees(trees), np.random.default_rng(seed)
    whole = np.zeros(n_classes)
    for y, n in rows.groupBy("y").agg(F.sum("n")).collect():  # a row per class
        whole[y] = n
    open_ = [found.add(whole.copy()) for _ in range(trees)]
    width = len(first["x"]) if first else 0
    drawn = min(width, max_features or ceil(width ** 0.5))
    for depth in range(max_depth if first else 0):
        open_ = [k for k in open_ if found.counts[k].sum() >= max(min_samples_split, 2 * min_samples_leaf) and (found.counts[k] > 0).sum() > 1]
        if not open_:
            break
        chosen = np.stack([rng.permutation(width)[:drawn] for _ in open_])
        low, high = _ranges(rows, found, open_, chosen)
        at = low + (high - low) * rng.uniform(size=low.shape)
        at = np.where(at < high, at, low)  # the greatest value stays on the right
        lefts = _left_counts(rows, found, open_, chosen, at, n_classes)
        nodes, open_ = open_, []
        for i, k in enumerate(nodes):
            right = found.counts[k] - lefts[i]
            gain = _impurity(found.counts[k], criterion) - _impurity(lefts[i], criterion) - _impurity(right, criterion)
            enough = (low[i] < high[i]) & (lefts[i].sum(axis=1) >= min_samples_leaf) & (right.sum(axis=1) >= min_samples_leaf)
            if enough.any():
                best = int(np.where(enough, gain, -np.inf).argmax())
                found.feature[k], found.threshold[k] = int(chosen[i, best]), float(at[i, best])
                found.left[k] = found.add(lefts[i, best])
                open_ += [found.left[k], found.add(right[best])]
    grouped.unpersist()
    return ExtraTrees(found, n_classes, features)


def _slots(found: Trees, nodes: list[int]) -> np.ndarray:
    """Place of each node among the open ones, -1 for others."""
    slot = np.full(len(found.feature), -1)
    slot[nodes] = np.arange(len(nodes))
    return slot


def _ranges(rows: DataFrame, found: Trees, nodes: list[int], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each open node's drawn features."""
    arrays, slot, roots, drawn = found.arrays(), _slots(found, nodes), found.roots, chosen.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = np.full(chosen.shape, np.inf), np.full(chosen.shape, -np.inf)
        for x, _, _ in _batches(batches):
            for root in range(roots):
                at = slot[_reached(x, root, *arrays)]
                order = np.argsort(at, kind="stable")
                order = order[np.searchsorted(at[order], 0):]
                if len(order):
                    begins = np.flatnonzero(np.diff(at[order], prepend=-1))
                    own = at[order][begins]
                    for j in range(drawn):
                        v = x[order, chosen[at[order], j]]
                        low[own, j] = np.minimum(low[own, j], np.minimum.reduceat(v, begins))
                        high[own, j] = np.maximum(high[own, j], np.maximum.reduceat(v, begins))
        i, j = np.nonzero(low <= high)
        yield pd.DataFrame({"i": i, "j": j, "low": low[i, j], "high": high[i, j]})

    low, high = np.zeros(chosen.shape), np.zeros(chosen.shape)
    for r in rows.mapInPandas(run, "i int, j int, low double, high double").groupBy("i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["i"], r["j"]], high[r["i"], r["j"]] = r["low"], r["high"]
    return low, high


def _left_counts(rows: DataFrame, found: Trees, nodes: list[int], chosen: np.ndarray, at: np.ndarray, n_classes: int) -> np.ndarray:
    """Class counts (node, drawn feature, class) of the rows at or below the thresholds."""
    arrays, slot, roots, drawn = found.arrays(), _slots(found, nodes), found.roots, chosen.shape[1]
    shape = (*chosen.shape, n_classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(int(np.prod(shape)))
        for x, y, n in _batches(batches):
            for root in range(roots):
                place = slot[_reached(x, root, *arrays)]
                some = np.flatnonzero(place >= 0)
                for j in range(drawn):
                    own = place[some]
                    below = some[x[some, chosen[own, j]] <= at[own, j]]
                    total += np.bincount((place[below] * drawn + j) * n_classes + y[below], weights=n[below], minlength=len(total))
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": k, "n": total[k].astype(np.int64)})

    out = np.zeros(int(np.prod(shape)))
    for k, n in rows.mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(shape)
