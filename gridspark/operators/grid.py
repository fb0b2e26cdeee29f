"""Grid geometry: mosaics, target grids, resampling, alignment, coordinates and masks."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, floor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import to_crs
from ..model import Grid
from .scan import cells_in_spans, spans


def mosaic(parts: DataFrame, order: str = "part", key: Sequence[str] = ("row", "col", "band")) -> DataFrame:
    """One value per cell: the first that is not NULL, in order of the part's name."""
    return parts.filter(F.col("value").isNotNull()).groupBy(*key).agg(F.min_by("value", order).alias("value"))


def target_grid(spark: SparkSession, grid: Grid, epsg: int, points_per_edge: int = 21) -> Grid:
    """A grid in another system over the same extent; square cells that keep the number along the diagonal."""
    last = points_per_edge - 1
    t = spark.range(points_per_edge).select((F.col("id") / last).alias("t"))
    w, h = grid.width * grid.dx, grid.height * grid.dy
    side = F.explode(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in (
        (grid.x0 + F.col("t") * w, F.lit(grid.y0)), (grid.x0 + F.col("t") * w, F.lit(grid.y0 - h)),
        (F.lit(grid.x0), grid.y0 - F.col("t") * h), (F.lit(grid.x0 + w), grid.y0 - F.col("t") * h)))))
    edge = t.select(side.alias("p")).select("p.*")
    x, y = to_crs(F.col("x"), F.col("y"), grid.epsg, epsg)
    minx, maxx, miny, maxy = edge.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    size = ((maxx - minx) ** 2 + (maxy - miny) ** 2) ** 0.5 / (grid.width ** 2 + grid.height ** 2) ** 0.5
    return Grid(minx, maxy, size, size, max(1, ceil((maxx - minx) / size - 1e-9)), max(1, ceil((maxy - miny) / size - 1e-9)), epsg)


def grid_cells(spark: SparkSession, grid: Grid) -> DataFrame:
    """``row, col`` of every cell, generated on the executors."""
    n = spark.range(grid.width * grid.height)
    return n.select(F.expr(f"cast(id div {grid.width} as int)").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))


def resample_nearest(cells: DataFrame, source: Grid, target: Grid, layers: Sequence[str], fill: float | None = 0.0, prefix: str = "") -> DataFrame:
    """Long cells on the target grid: the value of the source cell under each target cell's centre, else ``fill``.

    All layers move in one equi-join: the target cells are generated once with the source row and column that they look at.
    """
    spark = cells.sparkSession
    at = grid_cells(spark, target)
    x, y = to_crs(target.center_x(F.col("col")), target.center_y(F.col("row")), target.epsg, source.epsg)
    looked = at.select("row", "col", source.row(y).alias("_row"), source.col(x).alias("_col"),
                       F.explode(F.array(*(F.lit(n) for n in layers))).alias("layer"))
    values = cells.filter(F.col("layer").isin(list(layers))).select("layer", F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(fill))
    return looked.join(values, ["layer", "_row", "_col"], "left").select(F.concat(F.lit(prefix), "layer").alias("layer"), "row", "col", value.alias("value"))


def align_layers(cells: DataFrame, source: Grid, reference: Grid, layers: Sequence[str], fill: float | None = 0.0) -> DataFrame:
    """Every layer on the reference grid, named ``a_<name>``."""
    return resample_nearest(cells, source, reference, layers, fill, "a_")


def clip_window(grid: Grid, bounds: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """First row and column, height and width of the window of (minx, miny, maxx, maxy): offsets rounded up, sizes cut down."""
    minx, miny, maxx, maxy = bounds
    return (max(0, ceil((grid.y0 - maxy) / grid.dy)), max(0, ceil((minx - grid.x0) / grid.dx)),
            floor((maxy - miny) / grid.dy), floor((maxx - minx) / grid.dx))


def clip(cells: DataFrame, window: tuple[int, int, int, int]) -> DataFrame:
    row, col, height, width = window
    inside = F.col("row").between(row, row + height - 1) & F.col("col").between(col, col + width - 1)
    return cells.filter(inside).withColumns({"row": F.col("row") - row, "col": F.col("col") - col})


def lon_lat_layers(cells: DataFrame, grid: Grid) -> DataFrame:
    """Add the layers ``lon`` and ``lat``: the cell centres."""
    return cells.withColumns({"lon": grid.center_x(F.col("col")), "lat": grid.center_y(F.col("row"))})


def check_consistency(grids: DataFrame, properties: Sequence[str] = ("epsg", "px", "width", "height"), name: str = "layer") -> DataFrame:
    """One row per property in which a layer differs from the first by name: ``layer, property, expected, found``."""
    first = grids.agg(*(F.min_by(p, name).cast("string").alias(f"_{p}") for p in properties))
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("property"), F.col(f"_{p}").alias("expected"), F.col(p).cast("string").alias("found")) for p in properties)))
    compared = grids.crossJoin(F.broadcast(first)).select(name, pairs.alias("c")).select(name, "c.*")  # one row
    return compared.filter(~F.col("expected").eqNullSafe(F.col("found")))


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, grid: Grid, all_touched: bool = False, how: str = "inner") -> DataFrame:
    """Cells joined to the polygons that hold their centre, or touch them, by scan conversion: see :mod:`.scan`.

    ``polygons`` have a ``ring``, or ``rings`` with holes and parts, and any other columns, which are joined to the cells.
    """
    return cells_in_spans(cells, spans(polygons, grid, all_touched), how)


def study_area_mask(cells: DataFrame, polygons: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """Cells inside any of the polygons."""
    return cells_in_polygons(cells, polygons.select("rings" if "rings" in polygons.columns else "ring"), grid, all_touched, "left_semi")
