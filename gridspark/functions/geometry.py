"""Predicates and measures of polygons as column expressions.

A ring is ``array<struct<x, y>>`` that ends where it begins.  A shape is an array of rings under the even-odd rule: rings
inside others are holes, rings beside others are further parts, whichever way round they run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(ring: Column) -> Column:
    """``array<struct<ax, ay, bx, by>>`` of a ring's edges."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))


def rings_of(polygons: DataFrame) -> Column:
    """The shapes of a polygon table: its column ``rings``, or its ``ring`` as the only one."""
    return F.col("rings") if "rings" in polygons.columns else F.when(F.col("ring").isNotNull(), F.array("ring"))


def shape_edges(rings: Column) -> Column:
    """The edges of all rings."""
    return F.flatten(F.transform(rings, edges))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside, by the number of edges that a ray to the right crosses."""
    return _odd_crossings(edges(ring), x, y)


def shape_contains(rings: Column, x: Column, y: Column) -> Column:
    """The same for a shape with holes and parts."""
    return _odd_crossings(shape_edges(rings), x, y)


def _odd_crossings(all_: Column, x: Column, y: Column) -> Column:
    def crossed(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        return spans & (x < e["ax"] + F.try_divide((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"]))

    return F.size(F.filter(all_, crossed)) % 2 == 1


def side(px: Column, py: Column, e: Column | Mapping[str, Column]) -> Column:
    """Sign of the area that a point spans with an edge."""
    return F.signum((e["bx"] - e["ax"]) * (py - e["ay"]) - (e["by"] - e["ay"]) * (px - e["ax"]))


def edge_meets_box(e: Column | Mapping[str, Column], minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether an edge shares a point with a box."""
    near = ((F.least(e["ax"], e["bx"]) <= maxx) & (F.greatest(e["ax"], e["bx"]) >= minx)
            & (F.least(e["ay"], e["by"]) <= maxy) & (F.greatest(e["ay"], e["by"]) >= miny))
    sides = [side(px, py, e) for px in (minx, maxx) for py in (miny, maxy)]
    return near & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)


def touches_box(ring: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """Whether the polygon shares a point with a box: the box's centre is inside, or an edge meets the box."""
    return (contains(ring, (minx + maxx) / 2, (miny + maxy) / 2)
            | F.exists(edges(ring), lambda e: edge_meets_box(e, minx, miny, maxx, maxy)))


def _sum(ring: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(edges(ring), F.lit(0.0), lambda total, e: total + f(e))


def signed_area(ring: Column) -> Column:
    return _sum(ring, lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of area; NULL for a ring without area."""
    six = 6 * signed_area(ring)
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    return (F.try_divide(_sum(ring, lambda e: (e["ax"] + e["bx"]) * cross(e)), six),
            F.try_divide(_sum(ring, lambda e: (e["ay"] + e["by"]) * cross(e)), six))


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def is_valid(ring: Column) -> Column:
    """Closed, with three corners at least and an area, and no two edges that cross."""
    all_ = edges(ring)

    def crosses(e: Column, i: Column) -> Column:
        later = F.slice(all_, i + 2, F.greatest(F.size(all_) - i - 1, F.lit(0)))
        return F.exists(later, lambda o: proper_crossing(e, o))

    shaped = (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.coalesce(F.when(shaped, (area(ring) > 0) & (F.size(F.filter(all_, crosses)) == 0)).otherwise(False), F.lit(False))


def ring_signs(rings: Column) -> Column:
    """1 for each ring of a shape that encloses area, -1 for each hole: by the number of other rings around a point of its first edge.

    Rings of a shape may touch in points, so the point taken is none that a ring is likely to begin at.
    """
    def sign(ring: Column, i: Column) -> Column:
        a, b = F.get(ring, F.lit(0)), F.get(ring, F.lit(1))
        x, y = a["x"] + (b["x"] - a["x"]) * 0.4142, a["y"] + (b["y"] - a["y"]) * 0.4142
        around = F.filter(rings, lambda other, j: (i != j) & contains(other, x, y))
        return F.when(F.size(around) % 2 == 0, 1.0).otherwise(-1.0)

    return F.transform(rings, sign)


def _weighed(rings: Column, f: Callable[[Column], Column]) -> Column:
    each = F.zip_with(ring_signs(rings), F.transform(rings, lambda r: f(r) * F.signum(signed_area(r))), lambda s, v: s * v)
    return F.aggregate(each, F.lit(0.0), lambda total, v: total + F.coalesce(v, F.lit(0.0)))


def shape_area(rings: Column) -> Column:
    """Area of a shape, holes left out, whichever way its rings run."""
    return _weighed(rings, signed_area)


def shape_centroid(rings: Column) -> tuple[Column, Column]:
    """Centre of area of a shape; NULL for one without area."""
    cross = lambda e: e["ax"] * e["by"] - e["bx"] * e["ay"]
    six = 6 * shape_area(rings)
    return (F.try_divide(_weighed(rings, lambda r: _sum(r, lambda e: (e["ax"] + e["bx"]) * cross(e))), six),
            F.try_divide(_weighed(rings, lambda r: _sum(r, lambda e: (e["ay"] + e["by"]) * cross(e))), six))


def proper_crossing(e: Column | Mapping[str, Column], o: Column | Mapping[str, Column]) -> Column:
    """Whether two edges cross at a point inside both."""
    return (side(o["ax"], o["ay"], e) * side(o["bx"], o["by"], e) < 0) & (side(e["ax"], e["ay"], o) * side(e["bx"], e["by"], o) < 0)
