"""The data model: points, long and wide cells, grids and polygons, and the one spelling of missing values.

* points: ``point_id, lon, lat`` or ``x, y`` and numeric labels
* cells, long: ``layer, row, col, value``; wide: ``row, col`` and one column per layer
* grids: ``layer, x0, y0, dx, dy, width, height, epsg, nodata``; ``x0, y0`` is the upper left corner, rows run down
* polygons: ``poly_id``, attributes and ``ring``, an array of ``struct<x, y>`` that ends where it begins
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
CELLS = T.StructType([T.StructField("layer", T.StringType()), T.StructField("row", T.IntegerType()),
                      T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])
GRIDS = T.StructType([T.StructField("layer", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "dx", "dy")),
                      *(T.StructField(c, T.IntegerType()) for c in ("width", "height", "epsg")), T.StructField("nodata", T.DoubleType())])


@dataclass(frozen=True)
class Grid:
    """An axis-parallel grid: upper left corner, cell sizes and dimensions."""

    x0: float
    y0: float
    dx: float
    dy: float
    width: int
    height: int
    epsg: int = 4326

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / self.dy).cast("int")

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / self.dx).cast("int")

    def center_x(self, col: Column) -> Column:
        return F.lit(self.x0) + (col + 0.5) * self.dx

    def center_y(self, row: Column) -> Column:
        return F.lit(self.y0) - (row + 0.5) * self.dy

    def holds(self, row: Column, col: Column) -> Column:
        return row.between(0, self.height - 1) & col.between(0, self.width - 1)


def missing(value: Column, nodata: Column | float | None = None) -> Column:
    """``value`` with NaN and the nodata value as NULL: aggregates skip NULL, but carry NaN on."""
    return F.when(F.isnan(value) | (F.lit(False) if nodata is None else value.eqNullSafe(nodata)), None).otherwise(value)


def finite(value: Column, fill: float | None = 0.0) -> Column:
    """``value``, or ``fill`` where it is NULL, NaN or infinite."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(bad, F.lit(fill)).otherwise(value)
