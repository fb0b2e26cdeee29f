"""Joins in space: sampling layers at points, zonal statistics, polygon measures and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry
from ..model import Grid
from . import nearest
from .grid import cells_in_polygons

LARGEST_EXACT = (1 << 53) - 1


def sample_points(points: DataFrame, wide: DataFrame, grid: Grid, layers: Sequence[str], keep_out_of_bounds: bool = False,
                  fill: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """The points' columns and the value of each layer's cell under them.

    A point outside the grid or on a NULL of any layer is dropped, or keeps ``fill`` there.
    """
    placed = points.withColumns({"_row": grid.row(F.col(y)), "_col": grid.col(F.col(x))})
    values = wide.select(F.col("row").alias("_row"), F.col("col").alias("_col"), *layers)
    joined = placed.join(values, ["_row", "_col"], "left" if keep_out_of_bounds else "inner").drop("_row", "_col")
    if keep_out_of_bounds:
        return joined if fill is None else joined.fillna(fill, subset=list(layers))
    return joined.dropna(subset=list(layers))


def large_integers(df: DataFrame) -> DataFrame:
    """One row per integer column: ``column, large``, whether it holds a number beyond 2^53 - 1."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.LongType)]
    found = df.agg(*(F.coalesce(F.max(F.abs(F.col(c).cast("decimal(20,0)"))) > LARGEST_EXACT, F.lit(False)).alias(c) for c in names))
    return found.unpivot([], names, "column", "large")


def large_integers_as_text(df: DataFrame) -> DataFrame:
    large = [r["column"] for r in large_integers(df).filter("large").collect()]
    return df.withColumns({c: F.col(c).cast("string") for c in large}) if large else df


def clean_polygons(polygons: DataFrame) -> DataFrame:
    """Polygons with a valid ring."""
    return polygons.filter(F.col("ring").isNotNull() & geometry.is_valid(F.col("ring")))


def crossed_shapes(polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """``key`` of each polygon of which two edges cross, of one ring or of two.

    A sweep as a join: edges meet by strips across the axis along which they are short, as many strips as keep an edge's copies at
    two on average, so that a boundary of n edges takes about n comparisons and not their square.
    """
    edges = polygons.select(F.col(key).alias("_key"), F.posexplode(geometry.shape_edges(geometry.rings_of(polygons))).alias("_at", "e")).select("_key", "_at", "e.*")
    extent = lambda a, b: F.max(F.greatest(a, b)) - F.min(F.least(a, b))
    sizes = edges.groupBy("_key").agg(
        F.count("*").alias("_n"), F.min(F.least("ax", "bx")).alias("_x0"), F.min(F.least("ay", "by")).alias("_y0"), extent("ax", "bx").alias("_w"), extent("ay", "by").alias("_h"),
        F.sum(F.abs(F.col("bx") - F.col("ax"))).alias("_dx"), F.sum(F.abs(F.col("by") - F.col("ay"))).alias("_dy"))
    across = F.coalesce(F.expr("try_divide(_dx, _w) < try_divide(_dy, _h)"), F.lit(False))
    sizes = sizes.select("_key", across.alias("_across"), F.when(across, F.col("_x0")).otherwise(F.col("_y0")).alias("_low"),
                         F.when(across, F.expr("try_divide(_n * _w, _dx) / _w")).otherwise(F.expr("try_divide(_n, _dy)")).alias("_per"))
    low, high = (F.when(F.col("_across"), f("ax", "bx")).otherwise(f("ay", "by")) for f in (F.least, F.greatest))
    strip = lambda v: F.coalesce(F.floor((v - F.col("_low")) * F.col("_per")), F.lit(0))
    dealt = edges.join(sizes, "_key").withColumn("_strip", F.explode(F.sequence(strip(low), strip(high)))).select("_key", "_strip", "_at", "ax", "ay", "bx", "by")
    other = dealt.select(*(F.col(c).alias(f"o{c}") for c in dealt.columns))
    e, o = ({c: F.col(f"{prefix}{c}") for c in ("ax", "ay", "bx", "by")} for prefix in ("", "o"))
    same = (F.col("_key") == F.col("o_key")) & (F.col("_strip") == F.col("o_strip")) & (F.col("_at") < F.col("o_at"))
    return dealt.join(other, same).filter(geometry.proper_crossing(e, o)).select(F.col("_key").alias(key)).distinct()


def clean_shapes(polygons: DataFrame, key: str = "poly_id") -> DataFrame:
    """Polygons with ``rings`` that are all closed and have an area, and of which no edges cross; ``key`` tells them apart."""
    shaped = lambda r: (F.size(r) >= 4) & (F.element_at(r, 1) == F.element_at(r, -1)) & (geometry.area(r) > 0) & (geometry.area(r) < float("inf"))
    closed = polygons.filter(F.coalesce((F.size("rings") > 0) & F.forall("rings", lambda r: F.coalesce(shaped(r), F.lit(False))), F.lit(False)))
    return closed.join(crossed_shapes(closed, key), key, "left_anti")


def polygon_faults(polygons: DataFrame) -> DataFrame:
    """One row: ``n_null, n_invalid, n_valid``."""
    ok = geometry.is_valid(F.col("ring"))
    null = F.col("ring").isNull()
    return polygons.agg(F.count_if(null).alias("n_null"), F.count_if(~null & ~ok).alias("n_invalid"), F.count_if(~null & ok).alias("n_valid"))


def area_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: total areas ``before, after`` and the change in percent."""
    total = lambda df, name: df.agg(F.coalesce(F.sum(geometry.area(F.col("ring"))), F.lit(0.0)).alias(name))
    both = total(before, "before").crossJoin(total(after, "after"))  # one row each
    return both.withColumn("change_pct", F.try_divide(F.col("after") - F.col("before"), F.col("before")) * 100)


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """Add area, centroid and bounding box; holes of ``rings`` are left out of the first two."""
    if "rings" in polygons.columns:
        rings = F.col("rings")
        area, (cx, cy), box = geometry.shape_area(rings), geometry.shape_centroid(rings), geometry.bounds(F.flatten(rings))
    else:
        ring = F.col("ring")
        area, (cx, cy), box = geometry.area(ring), geometry.centroid(ring), geometry.bounds(ring)
    return polygons.withColumns({"area": area, "Centroid_X": cx, "Centroid_Y": cy,
                                 "XMin": box["minx"], "YMin": box["miny"], "XMax": box["maxx"], "YMax": box["maxy"]})


ZONAL = ("mean", "std", "min", "max", "count", "majority")


def zonal_stats(polygons: DataFrame, cells: DataFrame, grid: Grid, key: str = "poly_id", all_touched: bool = True) -> DataFrame:
    """``key, layer, mean, std, min, max, count, majority`` over the cells that each polygon touches, NULL cells left out.

    The most frequent value wins, the smallest of several.  Polygons without a cell are absent here.
    """
    cells = cells.filter(F.col("value").isNotNull())
    shape = "rings" if "rings" in polygons.columns else "ring"
    inside = cells_in_polygons(cells, polygons.select(key, shape), grid, all_touched)
    values = inside.groupBy(key, "layer", "value").agg(F.count("*").alias("_n"))
    # sums of distances from the layer's mean, so that squares of large values do not cancel; a row per layer
    means = cells.groupBy(F.col("layer").alias("_layer")).agg(F.avg("value").alias("_m"))
    off, n = F.col("value") - F.col("_m"), F.col("_n")
    sums = values.join(F.broadcast(means), F.col("layer") == F.col("_layer")).groupBy(key, "layer").agg(
        F.sum("_n").alias("count"), F.sum(off * n).alias("_s"), F.sum(off * off * n).alias("_q"), F.first("_m").alias("_m"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.min_by("value", F.struct(-n, F.col("value"))).alias("majority"))
    shift = F.col("_s") / F.col("count")
    return sums.select(key, "layer", (F.col("_m") + shift).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("_q") / F.col("count") - shift * shift)).alias("std"),
                       *ZONAL[2:])


def zonal_all(polygons: DataFrame, cells: DataFrame, grid: Grid, layers: Sequence[str], key: str = "poly_id", all_touched: bool = True) -> DataFrame:
    """One row per polygon with ``<layer>_<statistic>`` for every layer; count is 0 where it holds no cell."""
    stats = zonal_stats(polygons, cells.filter(F.col("layer").isin(list(layers))), grid, key, all_touched)
    wide = stats.groupBy(key).pivot("layer", list(layers)).agg(*(F.first(s).alias(s) for s in ZONAL))
    joined = polygons.select(key).join(wide, key, "left").fillna(0, subset=[f"{n}_count" for n in layers])
    return joined.toDF(*(c.replace(" ", "_").replace("-", "_") for c in joined.columns))


def spatial_knn(points: DataFrame, k: int = 8, targets: DataFrame | None = None, key: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """``key, neighbour, distance, rank``: the k nearest points of each row of ``targets`` (other points, if that is None).

    Exact, with ties by id, in arrays over adaptive tiles: see :mod:`.nearest`.  Points of equal ids are one point to themselves; rows
    without a finite place are left out.
    """
    placed = lambda df: df.select(F.col(key), F.col(x).alias("x"), F.col(y).alias("y"))
    return nearest.knn(placed(points), None if targets is None else placed(targets), k, key)


def knn_brute_force(points: DataFrame, k: int = 8, key: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """The same for few points, by comparing all of them; the tests hold :func:`spatial_knn` against it."""
    a = points.select(F.col(key), F.col(x).alias("_tx"), F.col(y).alias("_ty"))
    b = points.select(F.col(key).alias("neighbour"), F.col(x).alias("_nx"), F.col(y).alias("_ny"))
    met = a.join(b, F.col(key) != F.col("neighbour"))
    square = (F.col("_tx") - F.col("_nx")) * (F.col("_tx") - F.col("_nx")) + (F.col("_ty") - F.col("_ny")) * (F.col("_ty") - F.col("_ny"))
    ranked = met.withColumn("_d2", square).withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("_d2", "neighbour")))
    return ranked.filter(F.col("rank") <= k).select(key, "neighbour", F.sqrt("_d2").alias("distance"), F.col("rank").cast("int"))
