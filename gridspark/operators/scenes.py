"""Scene selection, cloud masks, composites and download tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import touches_box

CLOUD, CIRRUS = 1 << 10, 1 << 11
BANDS, BYTES, OVERHEAD = 12, 4, 1.5


def scene_filter(scenes: DataFrame, start: str, end: str, max_cloud: float = 20, bands: Sequence[str] | None = None,
                 box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Scenes from ``start`` up to, not including, ``end`` with less cloud than ``max_cloud``, of some bands and inside a box (minx, miny, maxx, maxy of ``x, y``)."""
    keep = (F.col("sensed_on") >= F.lit(start).cast("date")) & (F.col("sensed_on") < F.lit(end).cast("date")) & (F.col("cloud_pct") < max_cloud)
    if bands is not None:
        keep &= F.col("band").isin(list(bands))
    if box is not None:
        keep &= F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    return scenes.filter(keep)


def month_ranges(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """The columns of ``ranges`` and ``month_start, month_end`` for each calendar month it touches, clipped to it; both ends count."""
    months = F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("interval 1 month"))
    out = ranges.filter(F.col(start) <= F.col(end)).withColumn("_month", F.explode(months))
    return out.withColumns({"month_start": F.greatest(F.col(start), F.col("_month")), "month_end": F.least(F.col(end), F.last_day("_month"))}).drop("_month")


def is_clear(qa60: Column) -> Column:
    return (qa60.bitwiseAND(CLOUD) == 0) & (qa60.bitwiseAND(CIRRUS) == 0)


def cloud_mask(scenes: DataFrame, scale: float = 10000.0) -> DataFrame:
    """Reflectance where neither the cloud nor the cirrus bit is set, else NULL."""
    return scenes.withColumn("value", F.when(is_clear(F.col("qa60")), F.col("value").cast("double") / scale))


def median_composite(scenes: DataFrame, cell: Sequence[str] = ("row", "col"), by: Sequence[str | Column] = ()) -> DataFrame:
    """Median per cell and band of the values that are not masked; a cell without one is absent."""
    return scenes.filter(F.col("value").isNotNull()).groupBy(*by, *cell, "band").agg(F.median("value").alias("value"))


def monthly_composite(scenes: DataFrame, cell: Sequence[str] = ("row", "col")) -> DataFrame:
    """Median per month, cell and band; months without a clear value are absent."""
    return median_composite(scenes, cell, [F.trunc("sensed_on", "MM").alias("month")])


def scene_count(scenes: DataFrame, by: Sequence[str | Column] = ()) -> DataFrame:
    return scenes.groupBy(*by).agg(F.countDistinct("scene_id").alias("n_scenes"))


def estimate_tile_bytes(area: Column, scale: float) -> Column:
    """Bytes of a download: cells of ``scale`` metres, twelve bands of four bytes and half as much again."""
    return area / (scale * scale) * BANDS * BYTES * OVERHEAD


def _tiles(regions: DataFrame, n: Column) -> DataFrame:
    out = regions.withColumn("_n", n).withColumn("tile_r", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn(
        "tile_c", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    w, h = (F.col("maxx") - F.col("minx")) / F.col("_n"), (F.col("maxy") - F.col("miny")) / F.col("_n")
    return out.withColumns({"tile_minx": F.col("minx") + F.col("tile_c") * w, "tile_miny": F.col("miny") + F.col("tile_r") * h,
                            "tile_maxx": F.col("minx") + (F.col("tile_c") + 1) * w, "tile_maxy": F.col("miny") + (F.col("tile_r") + 1) * h}).drop("_n")


def split_extent(regions: DataFrame, scale: float, max_bytes: float = 40e6) -> DataFrame:
    """Tiles of ``minx, miny, maxx, maxy``: one if the region is small enough, else n by n with n = ceil(sqrt(bytes / max)) + 1."""
    size = estimate_tile_bytes((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")), scale)
    return _tiles(regions, F.when(size <= max_bytes, 1).otherwise(F.ceil(F.sqrt(size / max_bytes)).cast("int") + 1))


def split_extent_within(polygons: DataFrame, scale: float, max_cells: float) -> DataFrame:
    """Tiles of each polygon's box that touch the polygon; n = ceil(sqrt(cells / max))."""
    cells = (F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny")) / (scale * scale)
    tiles = _tiles(polygons, F.greatest(F.lit(1), F.ceil(F.sqrt(cells / max_cells)).cast("int")))
    return tiles.filter(touches_box(F.col("ring"), *(F.col(f"tile_{c}") for c in ("minx", "miny", "maxx", "maxy"))))


def tile_has_data(tiles: DataFrame, key: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Tiles whose sum over some band is neither zero nor NULL, with the sums."""
    sums = tiles.groupBy(*key).agg(*(F.sum(b).alias(b) for b in bands))
    return sums.filter(" or ".join(f"`{b}` <> 0" for b in bands))
