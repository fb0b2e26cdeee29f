"""Exact nearest neighbours: adaptive tiles, searched in arrays.

A quadtree over a bounded sample of points and targets cuts the plane into tiles that hold about as many of them each, however they
crowd.  A tile's points meet its targets in one task, as arrays, and only k rows a target leave Python.  A target is done
if the circle through its k-th neighbour stays inside its tile; otherwise it is asked of the other tiles that the circle
reaches, in one further round, and the answers are merged.  Where a tile has too few points, the circle is the one that surely holds k
by the tiles' counts.  The tree decides where work is done and not what comes out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Rows of the sample that the tree is made of, points and targets each, and rows of it in a tile at least before it is cut.
SAMPLE, LEAST = 1 << 17, 8
#: Points or targets of a tile that is not cut further; a tile's targets beyond the second number are dealt over several tasks.
LEAF, TARGETS = 4096, 1 << 16
#: Points and targets that a task sorts, about.
SORTED = 1 << 20
#: Cuts of the plane in half, both ways, at most.
DEPTH = 31
#: Points of a block inside a tile, and distances held at once.
BLOCK, HELD = 64, 1 << 22
#: A circle is taken to be larger by this share than computed.
SLACK = 1e-9


class Tiles(NamedTuple):
    """Squares that cover the plane of a search, in order of their codes (bits of both places interleaved)."""

    x0: float
    y0: float
    side: float
    starts: np.ndarray
    left: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, _codes(self.x0, self.y0, self.side, x, y), side="right") - 1

    def nearest_and_farthest(self, x: np.ndarray, y: np.ndarray, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Square distances of places (rows) to the near and far ends of tiles (columns)."""
        def ends(v: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = begin[some] - v[:, None], v[:, None] - (begin + self.width)[some]
            return np.maximum(np.maximum(a, b), 0), np.maximum(np.abs(a), np.abs(b))

        (nx, fx), (ny, fy) = ends(x, self.left), ends(y, self.low)
        return nx * nx + ny * ny, fx * fx + fy * fy


def _codes(x0: float, y0: float, side: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Codes of places, of ``2 * DEPTH`` bits."""
    out = np.zeros(len(x), np.int64)
    for bit, v in ((0, (x - x0) / side), (1, (y - y0) / side)):
        cell = np.clip(v * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64)
        for k in range(DEPTH):
            out |= (cell >> k & 1) << (2 * k + bit)
    return out


def tiles_of(x: np.ndarray, y: np.ndarray, most: int, box: tuple[float, float, float, float]) -> Tiles:
    """Cut the square around ``box`` until no tile holds over ``most`` of the places, or tiles are as small as they get."""
    x0, y0 = box[0], box[1]
    side = max(box[2] - box[0], box[3] - box[1], abs(x0) * 1e-12, abs(y0) * 1e-12, 1e-300)
    codes, found, todo = np.sort(_codes(x0, y0, side, x, y)), [], [(0, 0)]
    while todo:
        code, depth = todo.pop()
        size = 1 << 2 * (DEPTH - depth)
        inside = np.searchsorted(codes, code + size) - np.searchsorted(codes, code)
        if inside > most and depth < DEPTH:
            todo += [(code + i * size // 4, depth + 1) for i in range(4)]
        else:
            found.append((code, depth))
    found.sort()
    starts, depths = (np.array(a, np.int64) for a in zip(*found, strict=True))
    cells = [sum((starts >> (2 * k + bit) & 1) << k for k in range(DEPTH)) for bit in (0, 1)]
    width = side / (1 << depths).astype(np.float64)
    return Tiles(x0, y0, side, starts, x0 + cells[0] * (side / (1 << DEPTH)), y0 + cells[1] * (side / (1 << DEPTH)), width)


def _packed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An order in which ``BLOCK`` places after each other lie close together: slabs by x, each by y."""
    slabs = max(1, int((len(x) / BLOCK) ** 0.5))
    slab = np.empty(len(x), np.int64)
    slab[np.argsort(x, kind="stable")] = np.arange(len(x)) * slabs // max(1, len(x))
    return np.lexsort((y, slab))


def _boxes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    at = np.arange(0, len(x), BLOCK)
    return tuple(f.reduceat(v, at) for v in (x, y) for f in (np.minimum, np.maximum))


def _least(square: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of the k least of each row, by value and then by the rank of ``ids``, and their values."""
    if square.shape[1] > k:
        some = np.argpartition(square, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(square, some, axis=1).max(axis=1)
        tied = np.flatnonzero((square <= last[:, None]).sum(axis=1) > k)  # more than fit: by the ids
        tied = tied[np.isfinite(last[tied])]
        for r in tied.tolist():
            near = np.flatnonzero(square[r] <= last[r])
            some[r] = near[np.lexsort((ids[near], square[r, near]))[:k]]
    else:
        some = np.broadcast_to(np.arange(square.shape[1]), square.shape)
    values = np.take_along_axis(square, some, axis=1)
    order = np.lexsort((ids[some], values), axis=1)
    return np.take_along_axis(some, order, axis=1), np.take_along_axis(values, order, axis=1)


def nearest(px: np.ndarray, py: np.ndarray, pid: np.ndarray, tx: np.ndarray, ty: np.ndarray, tid: np.ndarray, k: int, own: bool,
            reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``pid`` of the k nearest points of each target, and square distances; missing ones are -1 and infinite.

    Distances beyond the square ``reach`` of a target need not be found.  With ``own`` a point of the target's id does not count.
    """
    order = np.argsort(pid, kind="stable")  # ties go by place from here on
    order = order[_packed(px[order], py[order])]
    x, y, ids = px[order], py[order], pid[order]
    rank = np.empty(len(pid), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    out, far = np.full((len(tx), k), -1, np.int64), np.full((len(tx), k), np.inf)
    if not len(x) or not len(tx):
        return out, far
    low_x, high_x, low_y, high_y = _boxes(x, y)
    targets = _packed(tx, ty)
    for begin in range(0, len(targets), BLOCK):
        mine = targets[begin:begin + BLOCK]
        mx, my = tx[mine], ty[mine]
        dx = np.maximum(np.maximum(low_x - mx.max(), mx.min() - high_x), 0)
        dy = np.maximum(np.maximum(low_y - my.max(), my.min() - high_y), 0)
        bound = dx * dx + dy * dy
        near = np.argsort(bound, kind="stable")

        def found(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).reshape(-1)  # noqa: B023
            at = at[at < len(x)]
            ex, ey = mx[:, None] - x[at], my[:, None] - y[at]  # noqa: B023
            square = ex * ex + ey * ey
            if own:
                square[tid[mine][:, None] == ids[at]] = np.inf  # noqa: B023
            some, values = _least(square, rank[at], k)
            return at[some], values

        least = np.full(len(mine), np.inf) if reach is None else reach[mine] * (1 + SLACK)
        first = near[:-(-2 * (k + 1) // BLOCK) + 1]
        at, values = found(first)
        if values.shape[1] == k:
            least = np.minimum(least, values[:, -1])
        rest = near[len(first):]
        rest = rest[bound[rest] <= least.max() * (1 + SLACK)]
        for a in range(0, len(rest), step := max(1, HELD // (BLOCK * BLOCK))):
            more_at, more = found(rest[a:a + step])
            at, values = np.concatenate([at, more_at], axis=1), np.concatenate([values, more], axis=1)
            some = np.lexsort((rank[at], values), axis=1)[:, :k]
            at, values = np.take_along_axis(at, some, axis=1), np.take_along_axis(values, some, axis=1)
        at = np.where(np.isfinite(values), order[at], -1)
        out[mine, :at.shape[1]], far[mine, :values.shape[1]] = at, values
    return out, far


def _reached(tiles: Tiles, tile: int, x: np.ndarray, y: np.ndarray, square: np.ndarray) -> list[np.ndarray]:
    """For each place, the tiles other than ``tile`` that the circle of a square radius shares a point with."""
    x1, y1, w = tiles.left[tile], tiles.low[tile], tiles.width[tile]
    square = square * (1 + SLACK)
    inner = np.minimum(np.minimum(x - x1, x1 + w - x), np.minimum(y - y1, y1 + w - y)) * (1 - SLACK)
    none = np.zeros(0, np.int32)
    out = [none] * len(x)
    open_ = np.flatnonzero((inner <= 0) | (inner * inner <= square))
    if len(open_):
        box = lambda v, low, high: np.maximum(np.maximum(low - v.max(), v.min() - high), 0)
        dx, dy = box(x[open_], tiles.left, tiles.left + tiles.width), box(y[open_], tiles.low, tiles.low + tiles.width)
        some = np.flatnonzero(dx * dx + dy * dy <= square[open_].max())
        some = some[some != tile]
        for a in range(0, len(open_), step := max(1, HELD // max(1, len(some)))):
            part = open_[a:a + step]
            near, _ = tiles.nearest_and_farthest(x[part], y[part], some)
            hit = near <= square[part, None]
            for i, row in zip(part.tolist(), hit, strict=True):
                out[i] = some[row].astype(np.int32)
    return out


def _surely(tiles: Tiles, counts: np.ndarray, tile: int, n: int) -> float:
    """The square of a radius within which every place of a tile has ``n`` points, by the counts of all tiles; infinite if there are less."""
    x = np.array([tiles.left[tile], tiles.left[tile] + tiles.width[tile]] * 2)
    y = np.array([tiles.low[tile]] * 2 + [tiles.low[tile] + tiles.width[tile]] * 2)
    far = tiles.nearest_and_farthest(x, y)[1].max(axis=0)  # a corner is farthest
    order = np.argsort(far, kind="stable")
    enough = np.searchsorted(np.cumsum(counts[order]), n)
    return float(far[order[enough]]) if enough < len(order) else float("inf")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, pa.RecordBatch]]:
    """Runs of rows of one tile, share and kind."""
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("tile", "share", "asked")])
        cuts = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                tile, share, asked = keys[:, a].tolist()
                yield (tile, share), bool(asked), batch.slice(a, b - a)


def _dealt(rows: DataFrame, tiles, shares, asked: bool, key: str) -> DataFrame:
    """Add each row's tile; targets go to one share of it, points to all."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, parts = tiles.value, shares.value
        for batch in batches:
            tile = found.of(batch.column("x").to_numpy(), batch.column("y").to_numpy())
            n = parts[tile]
            if asked:
                at, share = np.arange(batch.num_rows), np.arange(batch.num_rows) % n
            else:
                at = np.repeat(np.arange(batch.num_rows), n)
                share = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            some = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(tile[at].astype(np.int32)), pa.array(share.astype(np.int32)), pa.array(np.full(len(at), asked)), *some.columns,
                                              pa.nulls(len(at), pa.float64())], ["tile", "share", "asked", key, "x", "y", "reach"])

    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("tile", T.IntegerType()), T.StructField("share", T.IntegerType()), T.StructField("asked", T.BooleanType()), T.StructField(key, kind),
                           T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("reach", T.DoubleType())])
    return rows.mapInArrow(place, schema)


def _round(rows: DataFrame, tiles, surely, k: int, own: bool, key: str, last: bool, shares: int, size: int) -> DataFrame:
    """``key, x, y, found, square, asks, reach`` of each target of ``rows``: its nearest points in this tile and the tiles to ask."""
    # by work, which the size of the rows does not tell; by their number where they are many
    parts = max(1, min(shares, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SORTED))))
    ids = T.ArrayType(rows.schema[key].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, points = None, []
        for group, asked, batch in _groups(batches):
            if group != at:
                at, points = group, []
            if not asked:
                points.append(batch)
                continue
            if len(points) != 1:
                points = [pa.Table.from_batches(points).combine_chunks().to_batches()[0]] if points else [batch.slice(0, 0)]
            px, py, tx, ty = (b.column(c).to_numpy(zero_copy_only=False) for b in (points[0], batch) for c in ("x", "y"))
            pid, tid = (b.column(key).to_numpy(zero_copy_only=False) for b in (points[0], batch))
            reach = batch.column("reach").to_numpy(zero_copy_only=False) if last else None
            some, square = nearest(px, py, pid, tx, ty, tid, k, own, reach)
            radius = np.zeros(len(tx)) if last else np.minimum(square[:, -1], surely.value[group[0]])
            asks = [np.zeros(0, np.int32)] * len(tx) if last else _reached(tiles.value, group[0], tx, ty, radius)
            sizes = (some >= 0).sum(axis=1)
            ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = some[some >= 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), batch.column("x"), batch.column("y"), pa.ListArray.from_arrays(ends, points[0].column(key).take(pa.array(flat))),
                 pa.ListArray.from_arrays(ends, pa.array(square[some >= 0])), pa.array(asks, pa.list_(pa.int32())), pa.array(radius)],
                [key, "x", "y", "found", "square", "asks", "reach"])

    schema = T.StructType([rows.schema[key], rows.schema["x"], rows.schema["y"], T.StructField("found", ids), T.StructField("square", T.ArrayType(T.DoubleType())),
                           T.StructField("asks", T.ArrayType(T.IntegerType())), T.StructField("reach", T.DoubleType())])
    return rows.repartition(parts, "tile", "share").sortWithinPartitions("tile", "share", "asked").mapInArrow(search, schema)


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """``key, neighbour, distance, rank`` of rows whose neighbours are final."""
    each = rows.select(key, F.posexplode(F.arrays_zip("found", "square")).alias("_at", "_n"))
    return each.select(key, F.col("_n.found").alias("neighbour"), F.sqrt("_n.square").alias("distance"), (F.col("_at") + 1).cast("int").alias("rank"))


def _drawn(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of about ``SAMPLE`` rows of ``n``, of all if they are fewer."""
    some = rows if n <= SAMPLE else rows.sample(SAMPLE / n, 7)
    found = some.select("x", "y").toArrow()
    return found["x"].to_numpy(), found["y"].to_numpy()


def knn(points: DataFrame, targets: DataFrame | None, k: int, key: str) -> DataFrame:
    """``key, neighbour, distance, rank`` of the k nearest of ``points(key, x, y)`` to each of ``targets``, of other points if that is None.

    Rows without a finite place are left out.  The tree's tiles, their counts and a bounded sample are all that the driver gets:
    with ``SAMPLE`` rows in tiles of ``LEAST`` at least, some ten thousand tiles, which are broadcast, however many points there are.
    """
    spark, own = points.sparkSession, targets is None
    finite = lambda df: df.select(key, F.col("x").cast("double"), F.col("y").cast("double")).filter("abs(x) < double('infinity') and abs(y) < double('infinity')")
    all_points = finite(points)
    place = F.row_number().over(W.partitionBy("x", "y").orderBy(key))
    pool = written(all_points.withColumn("_k", place).filter(F.col("_k") <= k + 1).drop("_k"))  # of one place only the least ids can be neighbours
    asked = all_points if own else finite(targets)
    limits = (F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count("*"))
    *box, n = pool.agg(*limits).first()
    *other, m = [*box, n] if own else asked.agg(*limits).first()
    if not n or not m:
        return asked.limit(0).select(key, F.col(key).alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    box = [min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])]
    px, py = _drawn(pool, n)
    tx, ty = (px, py) if own else _drawn(asked, m)
    most = max(LEAST, LEAF * SAMPLE // max(n, m, SAMPLE))
    found = tiles_of(np.concatenate([px, tx]) if not own else px, np.concatenate([py, ty]) if not own else py, most if own else 2 * most, tuple(box))
    tiles, one = spark.sparkContext.broadcast(found), spark.sparkContext.broadcast(np.ones(len(found.starts), np.int64))
    each = _dealt(pool, tiles, one, False, key).union(_dealt(asked, tiles, one, True, key)).groupBy("tile", "asked").count().toArrow()  # two rows per tile
    counts = {"points": np.zeros(len(found.starts), np.int64), "targets": np.zeros(len(found.starts), np.int64)}
    for tile, is_target, count in zip(*(each[c].to_pylist() for c in ("tile", "asked", "count")), strict=True):
        counts["targets" if is_target else "points"][tile] = count
    poor = np.flatnonzero((counts["points"] < k + 1) & (counts["targets"] > 0))
    surely = np.full(len(found.starts), np.inf)
    for tile in poor.tolist():
        surely[tile] = _surely(found, counts["points"], tile, k + own)
    shares, surely = spark.sparkContext.broadcast(-(-counts["targets"] // TARGETS) + (counts["targets"] == 0)), spark.sparkContext.broadcast(surely)
    rows = _dealt(pool, tiles, shares, False, key).union(_dealt(asked, tiles, shares, True, key))
    first = written(_round(rows, tiles, surely, k, own, key, False, int(shares.value.sum()), n + m))
    result = _ranked(first.filter(F.size("asks") == 0), key)
    again = first.filter(F.size("asks") > 0)
    per_tile = again.select(F.explode("asks").alias("tile")).groupBy("tile").count().toArrow()  # a row per tile
    if not per_tile.num_rows:
        return result
    halo = np.zeros(len(found.starts), np.int64)
    halo[per_tile["tile"].to_numpy()] = -(-per_tile["count"].to_numpy() // TARGETS)
    halo = spark.sparkContext.broadcast(halo)
    parts = F.pandas_udf(lambda tile: pd.Series(halo.value[tile.to_numpy()]), "long")
    share = F.lit(0) if (halo.value <= 1).all() else F.pmod(F.xxhash64(key, "x", "y"), parts("tile")).cast("int")
    sent = again.select(F.explode("asks").alias("tile"), key, "x", "y", "reach").select("tile", share.alias("share"), F.lit(True).alias("asked"), key, "x", "y", "reach")
    more = _round(_dealt(pool, tiles, halo, False, key).union(sent), tiles, surely, k, own, key, True, int(halo.value.sum()), n + m)
    met = again.select(key, "found", "square").union(more.select(key, "found", "square"))
    near = met.select(key, F.explode(F.arrays_zip("found", "square")).alias("_n")).select(key, F.col("_n.found").alias("neighbour"), F.col("_n.square").alias("_d2"))
    merged = near.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("_d2", "neighbour"))).filter(F.col("rank") <= k)
    return result.union(merged.select(key, "neighbour", F.sqrt("_d2").alias("distance"), F.col("rank").cast("int")))
