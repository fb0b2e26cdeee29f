"""Cells as square array tiles with a halo, for operators that look at a neighbourhood.

A cell goes to its tile, and to the tiles beside it if it lies in their halo: one shuffle of the cells and of their tiles'
borders, not a row for each cell and neighbour.  A tile is an array in one task, of a fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a tile's side, and values gathered at once inside a task.
TILE, GATHERED = 256, 1 << 22


def _halo(index: str, before: int, after: int, tile: int) -> Column:
    """The tiles along an axis that need a cell: those whose span, widened by what is looked at before and after it, holds the cell."""
    i = F.col(index)
    return F.sequence(F.floor((i - after) / tile).cast("int"), F.floor((i + before) / tile).cast("int"))


def _statistics(near: np.ndarray, names: Sequence[str]) -> dict[str, np.ndarray]:
    """Statistics of each row, NaN left out; NaN where nothing is left."""
    n = (~np.isnan(near)).sum(axis=1)
    none = n == 0
    near = np.where(none[:, None], 0.0, near)
    least = {"mean": lambda: np.nansum(near, axis=1) / np.maximum(n, 1), "median": lambda: np.nanmedian(near, axis=1), "min": lambda: np.nanmin(near, axis=1),
             "max": lambda: np.nanmax(near, axis=1)}
    return {s: np.where(none, np.nan, least[s]()) for s in names}


def neighbourhood(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]], statistics: Sequence[str], mirrored: bool, only: Column | None = None,
                  tile: int = TILE) -> DataFrame:
    """``row, col`` and a column for each statistic over the cells at ``offsets`` from each cell (those where ``only`` holds).

    The grid is the cells' bounding box from (0, 0); with ``mirrored`` what lies beyond its border is reflected once, otherwise it is absent.
    Absent and NULL cells do not count, and a cell without any neighbour has NULL.  There is one row a cell.
    """
    rows, cols = (np.array(o) for o in zip(*offsets, strict=True))
    reach = [max(0, -int(rows.min())), max(0, int(rows.max())), max(0, -int(cols.min())), max(0, int(cols.max()))]
    if mirrored:  # a reflected neighbour lies on the other side
        reach = [max(reach[:2])] * 2 + [max(reach[2:])] * 2
    extent = cells.agg((F.max("row") + 1).alias("_h"), (F.max("col") + 1).alias("_w"))
    asked = F.lit(True) if only is None else F.coalesce(only, F.lit(False))
    # a tile looks ``before`` rows back, so a cell is also needed by tiles that begin up to so many rows after it
    spread = (cells.select("row", "col", F.col(value).cast("double").alias("_v"), asked.alias("_asked"))
              .withColumn("_tr", F.explode(_halo("row", reach[0], reach[1], tile))).withColumn("_tc", F.explode(_halo("col", reach[2], reach[3], tile)))
              .crossJoin(F.broadcast(extent)))  # one row

    def look(part: pd.DataFrame) -> pd.DataFrame:
        top, left = int(part["_tr"].iat[0]) * tile - reach[0], int(part["_tc"].iat[0]) * tile - reach[2]
        height, width = int(part["_h"].iat[0]), int(part["_w"].iat[0])
        block = np.full((tile + reach[0] + reach[1], tile + reach[2] + reach[3]), np.nan)
        block[part["row"].to_numpy() - top, part["col"].to_numpy() - left] = part["_v"].to_numpy()
        mine = part[part["_asked"] & (part["row"] // tile == part["_tr"]) & (part["col"] // tile == part["_tc"])]
        row, col = mine["row"].to_numpy(), mine["col"].to_numpy()

        def at(index: np.ndarray, steps: np.ndarray, size: int, first: int, length: int) -> np.ndarray:
            found = index[:, None] + steps
            if mirrored:
                found = np.where(found < 0, -1 - found, np.where(found >= size, 2 * size - 1 - found, found))
            inside = (found >= 0) & (found < size)
            return np.where(inside, np.clip(found - first, 0, length - 1), -1)

        out = {s: [] for s in statistics}
        for a in range(0, len(mine), step := max(1, GATHERED // len(rows))):
            r = at(row[a:a + step], rows, height, top, block.shape[0])
            c = at(col[a:a + step], cols, width, left, block.shape[1])
            near = np.where((r < 0) | (c < 0), np.nan, block[r, c])
            for s, v in _statistics(near, statistics).items():
                out[s].append(v)
        found = {s: np.concatenate(v) if v else np.zeros(0) for s, v in out.items()}
        return pd.DataFrame({"row": row, "col": col, **{s: pd.Series(v, dtype="float64") for s, v in found.items()}})

    kinds = dict(cells.dtypes)
    schema = f"row {kinds['row']}, col {kinds['col']}, " + ", ".join(f"{s} double" for s in statistics)
    found = spread.groupBy("_tr", "_tc").applyInPandas(look, schema)
    return found.select("row", "col", *(F.when(~F.isnan(s), F.col(s)).alias(s) for s in statistics))
