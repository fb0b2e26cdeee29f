"""Semivariances by distance over all pairs of points, by cells of two trees.

Rows at one place are first added up to one with their count and sums.  A quadtree over a bounded sample deals places to tiles, and two
tiles no farther apart than the greatest lag meet in one task.  There each side is a tree of runs of places, with the moments of
each run: two runs whose distances all lie in one class are counted at once, from their moments; others are taken apart, and pairs of
places are formed only where a class begins or ends, or close by.  Work grows with the power 1.5 of the places instead of their square.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .nearest import LEAST, SAMPLE, Tiles, _codes, _drawn, tiles_of

#: Places of a tile: the lower bound, and the upper bound of what grows with the table, which is a share of all places.
TILE, TILE_MOST, TILE_SHARE = 2048, 1 << 20, 32
#: Places that a task packs together before it sends them.
PACKED = 1 << 19
#: Places of a leaf, runs of a run of the level above, pairs of runs looked at together and pairs of places held at once.
LEAF, FAN, CHUNK, HELD = 32, 4, 1 << 14, 1 << 16
#: Two runs are counted at once only if they are this many times farther apart than both are large: a mean distance from third moments is then
#: within 2/7 * NEAR**-4 / (1 - 1/NEAR) of the exact one, 0.0015 at 4. Counts and semivariances do not depend on it.
NEAR = 4.0
#: Bounds of distances are taken to be wider by this share than computed.
SLACK = 1e-9


class Runs(NamedTuple):
    """A level of a tree: boxes, counts, sums and central moments of its runs."""

    x0: np.ndarray
    x1: np.ndarray
    y0: np.ndarray
    y1: np.ndarray
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray
    x: np.ndarray
    y: np.ndarray
    radius: np.ndarray
    moments: np.ndarray  # xx xy yy xxx xxy xyy yyy, one row each


class Tree(NamedTuple):
    """Places (x, y, count, sum, sum of squares) as leaves of ``LEAF``, the last filled up with counts of 0, and levels of runs of them, leaves first."""

    places: np.ndarray
    levels: list[Runs]


def _runs(places: np.ndarray, size: int) -> Runs:
    x, y, n, s, q = places
    at = np.arange(0, len(x), size)
    repeats = np.diff(np.append(at, len(x)))
    add = lambda v: np.add.reduceat(v, at)
    total = add(n)
    mx, my = add(n * x) / total, add(n * y) / total
    dx, dy = x - np.repeat(mx, repeats), y - np.repeat(my, repeats)
    moments = np.stack([add(n * m) / total for m in (dx * dx, dx * dy, dy * dy, dx ** 3, dx * dx * dy, dx * dy * dy, dy ** 3)])
    x0, x1, y0, y1 = (f.reduceat(v, at) for v in (x, y) for f in (np.minimum, np.maximum))
    return Runs(x0, x1, y0, y1, total, add(s), add(q), mx, my, np.hypot(np.maximum(mx - x0, x1 - mx), np.maximum(my - y0, y1 - my)), moments)


def tree_of(places: np.ndarray) -> Tree:
    x, y = places[0], places[1]
    side = max(np.ptp(x), np.ptp(y), 1e-300)
    places = places[:, np.argsort(_codes(x.min(), y.min(), side, x, y), kind="stable")]
    fill = -len(x) % LEAF
    last = places[:, -1:] * np.array([[1], [1], [0], [0], [0]])
    places = np.concatenate([places, np.repeat(last, fill, axis=1)], axis=1)
    levels, size = [_runs(places, LEAF)], LEAF
    while len(levels[-1].n) > 1:
        size *= FAN
        levels.append(_runs(places, size))
    return Tree(places.reshape(5, -1, LEAF), levels)


def _mean_distance(a: Runs, i: np.ndarray, b: Runs, j: np.ndarray) -> np.ndarray:
    """Mean distance of places of far runs, by the expansion about their means to third moments."""
    rx, ry = b.x[j] - a.x[i], b.y[j] - a.y[i]
    d = np.hypot(rx, ry)
    p, q = rx / d, ry / d
    xx, xy, yy = a.moments[:3, i] + b.moments[:3, j]
    xxx, xxy, xyy, yyy = b.moments[3:, j] - a.moments[3:, i]
    across = q * q * xx - 2 * p * q * xy + p * p * yy
    along = p * q * q * xxx + (q ** 3 - 2 * p * p * q) * xxy + (p ** 3 - 2 * p * q * q) * xyy + q * p * p * yyy
    return d + across / (2 * d) - along / (2 * d * d)


def _children(nodes: np.ndarray, places: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the level below, which has so many, of each node, and which of ``nodes`` they belong to."""
    found = nodes[:, None] * FAN + np.arange(FAN)
    inside = found < places
    return found[inside], np.nonzero(inside)[0]


def pair_sums(one: Tree, other: Tree | None, side: float, lags: int) -> np.ndarray:
    """Counts, sums of half squared differences and sums of distances by class, over pairs of places of two trees, or of two places of one."""
    own, other = other is None, one if other is None else other
    width = side / lags
    out, full, upto = np.zeros((3, 3, lags))

    def add(lag: np.ndarray, n: np.ndarray, g: np.ndarray, d: np.ndarray) -> None:
        for row, weights in zip(out, (n, g, d), strict=True):
            row += np.bincount(lag, weights, lags)

    def inside(i: np.ndarray) -> None:
        """Pairs of places of one leaf."""
        (x, y, n, s, q), (x2, y2, n2, s2, q2) = one.places[:, i, :, None], one.places[:, i, None, :]
        d = np.sqrt((x - x2) ** 2 + (y - y2) ** 2)
        met = (d <= side) & (n > 0) & (n2 > 0) & np.triu(np.ones((LEAF, LEAF), bool), 1)
        both = (n * n2)[met]
        add(np.minimum(np.floor(d[met] / width), lags - 1).astype(np.int64), both, (0.5 * (n * q2 + n2 * q) - s * s2)[met], both * d[met])

    def between(i: np.ndarray, j: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        """Pairs of places of two leaves, by sums up to the end of each class that lies between their least and greatest distance."""
        x, y, n, s, q = one.places[:, i]
        x2, y2, n2, s2, q2 = other.places[:, j]
        d = np.sqrt((x[:, :, None] - x2[:, None]) ** 2 + (y[:, :, None] - y2[:, None]) ** 2)
        right = np.stack([n2, s2, q2], axis=2)
        ended = last < lags  # these count in full from their last class on
        totals = n.sum(1) * n2.sum(1), 0.5 * (n.sum(1) * q2.sum(1) + q.sum(1) * n2.sum(1)) - s.sum(1) * s2.sum(1), (n * (d @ n2[:, :, None])[:, :, 0]).sum(1)
        for row, v in zip(full, totals, strict=True):
            row += np.bincount(last[ended], v[ended], lags)
        for k in range(int(first.min()), min(lags, int(last.max()))):
            some = slice(None) if (cut := (first <= k) & (last > k)).all() else cut
            away = d[some]
            m = (away <= side if k == lags - 1 else away / width < k + 1).astype(np.float64)
            met = m @ right[some]
            m *= away
            upto[:, k] += ((n[some] * met[:, :, 0]).sum(), (0.5 * (n[some] * met[:, :, 2] + q[some] * met[:, :, 0]) - s[some] * met[:, :, 1]).sum(),
                           (n[some] * (m @ n2[some][:, :, None])[:, :, 0]).sum())

    todo = [(len(one.levels) - 1, len(other.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while todo:
        la, lb, i, j = todo.pop()
        if len(i) > CHUNK:
            todo += [(la, lb, i[k:k + CHUNK], j[k:k + CHUNK]) for k in range(0, len(i), CHUNK)]
            continue
        a, b = one.levels[la], other.levels[lb]
        near = np.hypot(np.maximum(np.maximum(a.x0[i] - b.x1[j], b.x0[j] - a.x1[i]), 0), np.maximum(np.maximum(a.y0[i] - b.y1[j], b.y0[j] - a.y1[i]), 0)) * (1 - SLACK)
        far = np.hypot(np.maximum(b.x1[j] - a.x0[i], a.x1[i] - b.x0[j]), np.maximum(b.y1[j] - a.y0[i], a.y1[i] - b.y0[j])) * (1 + SLACK)
        first = np.floor(near / width)
        apart = np.hypot(a.x[i] - b.x[j], a.y[i] - b.y[j]) >= NEAR * (a.radius[i] + b.radius[j])
        whole = (far <= side) & (first == np.floor(far / width)) & (first < lags) & apart & (near > 0)
        if whole.any():
            p, q = i[whole], j[whole]
            n = a.n[p] * b.n[q]
            add(first[whole].astype(np.int64), n, 0.5 * (a.n[p] * b.q[q] + b.n[q] * a.q[p]) - a.s[p] * b.s[q], n * _mean_distance(a, p, b, q))
        rest = ~whole & (near <= side)
        i, j = i[rest], j[rest]
        if la == lb == 0:
            first, last = first[rest].astype(np.int64), np.minimum(np.floor(far[rest] / width), lags).astype(np.int64)
            step = max(1, HELD // (LEAF * LEAF))
            same = np.flatnonzero((i == j) & own)
            for k in range(0, len(same), step):
                inside(i[same[k:k + step]])
            two = np.flatnonzero((i != j) | (not own))
            two = two[np.lexsort((last[two], first[two]))]
            for k in range(0, len(two), step):
                some = two[k:k + step]
                between(i[some], j[some], first[some], last[some])
            continue
        down_a, down_b = la >= lb, lb >= la  # the larger runs are taken apart, both if they are alike
        if down_a:
            i, owner = _children(i, len(one.levels[la - 1].n))
            j = j[owner]
        if down_b:
            j, owner = _children(j, len(other.levels[lb - 1].n))
            i = i[owner]
        if own:  # each two runs once; both go down together
            i, j = i[keep := i <= j], j[keep]
        if len(i):
            todo.append((la - down_a, lb - down_b, i, j))
    return out + np.diff(upto + np.cumsum(full, axis=1), axis=1, prepend=0)


def _partners(tiles: Tiles, tile: int, side: float) -> np.ndarray:
    """Tiles no farther than ``side`` from one of them, which is one of these."""
    x, y, w = tiles.left[tile], tiles.low[tile], tiles.width[tile]
    dx = np.maximum(np.maximum(tiles.left - (x + w), x - (tiles.left + tiles.width)), 0)
    dy = np.maximum(np.maximum(tiles.low - (y + w), y - (tiles.low + tiles.width)), 0)
    return np.flatnonzero(np.hypot(dx, dy) <= side * (1 + SLACK))


def _packed(places: np.ndarray) -> bytes:
    """Places in few bytes: by column and by byte of its numbers, and the sum of squares only where it does not follow from the sum."""
    x, y, n, s, q = places
    whole = np.stack([x, y, n, s, np.where(n == 1, 0.0, q)])
    return pa.compress(np.ascontiguousarray(whole.view(np.uint8).reshape(5, -1, 8).transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    each = np.frombuffer(pa.decompress(packed, 40 * n, codec="zstd", asbytes=True), np.uint8).reshape(5, 8, n)
    places = each.transpose(0, 2, 1).copy().view(np.float64).reshape(5, n)
    places[4] = np.where(places[2] == 1, places[3] * places[3], places[4])
    return places


def lag_sums(points: DataFrame, value: str, side: float, lags: int, x: str, y: str) -> DataFrame:
    """``lag, n, g, d``: pairs of rows up to ``side`` apart by class from 1, sums of half their squared differences and of their distances.

    Rows without a finite place or value are left out. The driver gets limits, a bounded sample of places and the tiles made of it.
    """
    spark = points.sparkSession
    rows = points.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v")).filter(
        " and ".join(f"abs({c}) < double('infinity')" for c in "xyv"))
    off = F.col("v") - F.lit(rows.agg(F.avg("v")).first()[0])  # squares of large values would cancel
    places = written(rows.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"), F.sum(off).alias("s"), F.sum(off * off).alias("q")))
    *box, n = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*")).first()
    here = places.filter("n > 1").select(F.lit(1).alias("lag"), (F.col("n") * (F.col("n") - 1) / 2).alias("n"),
                                         (0.5 * (F.col("n") * F.col("q") - F.col("s") * F.col("s"))).alias("g"), F.lit(0.0).alias("d"))
    if not n:
        return here
    px, py = _drawn(places, n)
    most = max(TILE, min(n // TILE_SHARE, TILE_MOST))
    tiles = spark.sparkContext.broadcast(tiles_of(px, py, max(LEAST, most * len(px) // n), tuple(box)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * (4 if n > TILE else 1)  # tile pairs differ much in work

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partners, held, size = {}, [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            values = np.concatenate(held, axis=1)
            tile = tiles.value.of(values[0], values[1])
            order = np.argsort(tile, kind="stable")
            found, begins = np.unique(tile[order], return_index=True)
            for t, some in zip(found.tolist(), np.split(order, begins[1:]), strict=True):
                if t not in partners:
                    partners[t] = _partners(tiles.value, t, side)
                near, packed = partners[t], _packed(values[:, some])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(near, t).astype(np.int32)), pa.array(np.maximum(near, t).astype(np.int32)), pa.array((t > near).astype(np.int32)),
                                                  pa.array(np.full(len(near), len(some), np.int32)), pa.array([packed] * len(near), pa.binary())],
                                                 ["one", "other", "second", "size", "packed"])

        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy() for c in ("x", "y", "n", "s", "q")]))
            size += batch.num_rows
            if size >= PACKED:
                yield from sent()
                held, size = [], 0
        if size:
            yield from sent()

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at, sides = np.zeros((3, lags)), None, ([], [])

        def close() -> None:
            trees = [tree_of(np.concatenate(s, axis=1)) if s else None for s in sides]
            if at[0] == at[1] or all(trees):
                total.__iadd__(pair_sums(trees[0], trees[1], side, lags))

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("one", "other", "second")])
            cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    *pair, second = keys[:, a].tolist()
                    if pair != at:
                        if at:
                            close()
                        at, sides = pair, ([], [])
                    sides[second].extend(_unpacked(batch.column("packed")[i].as_py(), batch.column("size")[i].as_py()) for i in range(a, b))
        if at:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, lags + 1, dtype=np.int32)), *map(pa.array, total)], ["lag", "n", "g", "d"])

    sent = places.mapInArrow(dealt, "one int, other int, second int, size int, packed binary")
    sums = sent.repartition(parts, "one", "other").sortWithinPartitions("one", "other", "second").mapInArrow(met, "lag int, n double, g double, d double")
    return sums.union(here).groupBy("lag").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("d").alias("d")).filter("n > 0")
