"""Regions of equal cells, and their borders as shapes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import signed_area
from ..model import Grid
from ..sources.scratch import written

TILE = 64
#: Joins of tables that grow with the cells: no side goes through the driver, however few bytes its file has.
SHUFFLED = "shuffle_merge"


def _local_labels(tile: pd.DataFrame) -> pd.DataFrame:
    """Least cell number of each 4-connected area of equal value inside one tile."""
    r0, c0 = tile["row"].min(), tile["col"].min()
    shape = (tile["row"].max() - r0 + 1, tile["col"].max() - c0 + 1)
    codes = np.full(shape, -1)
    at = (tile["row"] - r0).to_numpy(), (tile["col"] - c0).to_numpy()
    codes[at] = pd.factorize(tile["value"])[0]
    labels = np.full(shape, np.iinfo(np.int64).max)
    labels[at] = tile["cell"].to_numpy()
    while True:
        before = labels.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            same = (codes[a] == codes[b]) & (codes[a] >= 0)
            low = np.minimum(labels[a], labels[b])
            labels[a] = np.where(same, low, labels[a])
            labels[b] = np.where(same, np.minimum(labels[a], labels[b]), labels[b])
        if np.array_equal(before, labels):
            break
    return tile.assign(label=labels[at])[["row", "col", "value", "label"]]


def label_regions(cells: DataFrame, value: str, width: int, tile: int = TILE) -> DataFrame:
    """``row, col, value, region`` for cells that are not NULL; ``region`` is the least cell number (row * width + col).

    Tiles label themselves first (a tile has a fixed number of cells); then only the labels that meet at tile borders are
    joined, by passing on least labels until nothing changes.
    """
    numbered = cells.filter(F.col(value).isNotNull()).select(
        "row", "col", F.col(value).alias("value"), (F.col("row").cast("long") * width + F.col("col")).alias("cell"),
        F.floor(F.col("row") / tile).alias("_tr"), F.floor(F.col("col") / tile).alias("_tc"))
    kind = dict(cells.dtypes)[value]
    local = written(numbered.groupBy("_tr", "_tc").applyInPandas(_local_labels, f"row int, col int, value {kind}, label long"))

    def border(dr: int, dc: int) -> DataFrame:
        axis = "row" if dr else "col"
        here = local.filter(F.col(axis) % tile == tile - 1).select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), "value", F.col("label").alias("a"))
        there = local.filter(F.col(axis) % tile == 0).select("row", "col", "value", F.col("label").alias("b"))
        return here.join(there.hint(SHUFFLED), ["row", "col", "value"]).select("a", "b")

    links = border(1, 0).union(border(0, 1)).filter("a <> b").distinct()
    links = written(links.union(links.select("b", "a")).distinct())
    roots = written(links.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = links.join(roots.hint(SHUFFLED), links["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("least"))
        passed = roots.join(near.hint(SHUFFLED), roots["node"] == near["a"], "left").select("node", F.least("root", "least").alias("root"), F.col("root").alias("_old"))
        jump = passed.select(F.col("node").alias("_n"), F.col("root").alias("_r"))  # and the root's own root
        new = written(passed.join(jump.hint(SHUFFLED), passed["root"] == jump["_n"], "left").select("node", F.least("root", "_r").alias("root"), "_old"))
        roots, changed = new.select("node", "root"), new.filter("root <> _old").limit(1).count()
        if not changed:
            break
    return local.join(roots.hint(SHUFFLED), local["label"] == roots["node"], "left").select("row", "col", "value", F.coalesce("root", "label").alias("region"))


def polygonize(cells: DataFrame, value: str, width: int, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Regions ``region, value, n, min_row, max_row, min_col, max_col`` and their border as edges of cells.

    An edge is ``region, row, col, side``: the side (N, S, W or E) of a cell where another region, or nothing, begins.
    """
    labelled = label_regions(cells, value, width, tile)
    regions = labelled.groupBy("region", "value").agg(F.count("*").alias("n"), F.min("row").alias("min_row"), F.max("row").alias("max_row"),
                                                      F.min("col").alias("min_col"), F.max("col").alias("max_col"))
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(r).alias("r"), F.lit(c).alias("c")) for s, r, c in (("N", -1, 0), ("S", 1, 0), ("W", 0, -1), ("E", 0, 1)))))
    looked = labelled.select("region", "row", "col", sides.alias("s")).select("region", "row", "col", "s.side", (F.col("row") + F.col("s.r")).alias("_r"), (F.col("col") + F.col("s.c")).alias("_c"))
    other = labelled.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("region").alias("_region"))
    edges = looked.join(other.hint(SHUFFLED), ["_r", "_c"], "left").filter(~F.col("region").eqNullSafe(F.col("_region"))).select("region", "row", "col", "side")
    return regions, edges


#: Directions of a border edge, clockwise around its cell: the cell beyond it, the corner where it begins (rows and columns from the cell's upper left).
_SIDES = (("N", (-1, 0), (0, 0)), ("E", (0, 1), (0, 1)), ("S", (1, 0), (1, 1)), ("W", (0, -1), (1, 0)))


def _following(edges: DataFrame) -> DataFrame:
    """``region, id, next, row, col, side, turns``: each border edge with the one after it, the region on its right.

    Where an edge ends, the region may go on diagonally (turn left), straight on, or not (turn right around the cell).  The first
    that is there is taken, so areas of the region that touch in a corner are one border and what lies between them two.
    """
    at = {s: i for i, (s, _, _) in enumerate(_SIDES)}
    side = F.col("side")
    steps = []
    for i, (s, (out_r, out_c), _) in enumerate(_SIDES):
        ahead_r, ahead_c = _SIDES[(i + 1) % 4][1]  # the direction in which this edge runs
        left, right = _SIDES[(i + 3) % 4][0], _SIDES[(i + 1) % 4][0]
        tried = [(0, ahead_r + out_r, ahead_c + out_c, left), (1, ahead_r, ahead_c, s), (2, 0, 0, right)]
        steps.append(F.when(side == s, F.array(*(F.struct(F.lit(k).alias("k"), (F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"), F.lit(t).alias("side")) for k, r, c, t in tried))))
    number = lambda row, col, s: F.struct(row.cast("long"), col.cast("long"), F.element_at(F.create_map(*(F.lit(x) for p in at.items() for x in p)), s))
    tried = edges.select("region", "row", "col", "side", F.explode(F.coalesce(*steps)).alias("t"))
    there = edges.select(F.col("region").alias("_region"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.col("side").alias("_side"))
    met = tried.join(there.hint(SHUFFLED), (F.col("region") == F.col("_region")) & (F.col("t.row") == F.col("_row")) & (F.col("t.col") == F.col("_col")) & (F.col("t.side") == F.col("_side")))
    first = met.groupBy("region", "row", "col", "side").agg(F.min("t.k").alias("turns"), F.min_by(F.struct("t.row", "t.col", "t.side"), "t.k").alias("n"))
    return first.select("region", number(F.col("row"), F.col("col"), side).alias("id"), number(F.col("n.row"), F.col("n.col"), F.col("n.side")).alias("next"), "row", "col", "side",
                        (F.col("n.side") != side).alias("turns"))


def _doubled(links: DataFrame, least: bool) -> DataFrame:
    """Pointer doubling over ``id, to, best, steps``, a row an edge: until every ``to`` has come to an end, or to where it has been.

    ``best`` becomes the least id ahead and ``steps`` the number of edges up to the end; each round doubles how far an edge sees and is written.
    """
    while True:
        ahead = links.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("best").alias("_best"), F.col("steps").alias("_steps"))
        joined = links.join(ahead.hint(SHUFFLED), F.col("to") == F.col("_id"), "left")
        better = F.least("best", F.coalesce("_best", "best"))
        new = written(joined.select("id", F.col("_to").alias("to"), better.alias("best"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                                    (F.col("to").isNotNull() if not least else better != F.col("best")).alias("_moved")))
        links = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return links


def region_rings(edges: DataFrame) -> DataFrame:
    """``region, ring, corners``: each closed border of a region, of the edges of :func:`polygonize`, as its corners in order.

    List ranking by pointer doubling: the least edge that an edge comes to names its ring; the ring is opened there, and the
    edges left to its end tell the order.  Rounds grow with the logarithm of the longest border.  Corners are ``row, col`` of the grid's lines.
    """
    following = written(_following(edges))
    named = _doubled(following.select("id", F.col("next").alias("to"), F.least("id", "next").alias("best"), F.lit(1).cast("long").alias("steps")), True)
    rings = written(following.join(named.select("id", F.col("best").alias("ring")).hint(SHUFFLED), "id"))
    last = F.col("next") == F.col("ring")
    order = _doubled(rings.select("id", F.when(~last, F.col("next")).alias("to"), F.col("id").alias("best"), F.lit(1).cast("long").alias("steps")), False)
    begins = F.coalesce(*(F.when(F.col("side") == s, F.struct((F.col("row") + r).alias("row"), (F.col("col") + c).alias("col"))) for s, _, (r, c) in
                          ((s, None, _SIDES[(i + 1) % 4][2]) for i, (s, _, _) in enumerate(_SIDES))))  # where the edge ends
    corners = rings.join(order.select("id", "steps").hint(SHUFFLED), "id").filter("turns").select("region", "ring", F.struct((-F.col("steps")).alias("at"), begins.alias("corner")).alias("c"))
    found = corners.groupBy("region", "ring").agg(F.sort_array(F.collect_list("c")).alias("c"))
    ordered = F.transform("c", lambda c: c["corner"])
    return found.select("region", "ring", F.concat(ordered, F.slice(ordered, 1, 1)).alias("corners"))


def region_shapes(cells: DataFrame, value: str, grid: Grid, tile: int = TILE) -> DataFrame:
    """``region, value, n, rings``: the shape of each region with its holes, as the operators for polygons take it.

    The outer border comes first and runs clockwise on the map, holes the other way.
    """
    regions, edges = polygonize(cells, value, grid.width, tile)
    point = lambda c: F.struct((grid.x0 + c["col"] * grid.dx).cast("double").alias("x"), (grid.y0 - c["row"] * grid.dy).cast("double").alias("y"))
    rings = region_rings(edges).select("region", F.transform("corners", point).alias("ring"))
    placed = F.struct(signed_area(F.col("ring")).alias("area"), F.col("ring")).alias("r")
    shapes = rings.select("region", placed).groupBy("region").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["ring"]).alias("rings"))
    return regions.select("region", "value", "n").join(shapes.hint(SHUFFLED), "region")
