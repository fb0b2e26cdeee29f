"""Scan conversion against every cell of a grid, for shapes with holes and parts; crossings of edges against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import geometry
from gridspark.model import Grid
from gridspark.operators import grid as G
from gridspark.operators import scan, spatial

GRID = Grid(-3.0, 17.0, 0.7, 1.1, 30, 20)
SCHEMA = "poly_id int, rings array<array<struct<x: double, y: double>>>"


def star(cx, cy, corners, rng, reach=1.0):
    """A ring around a place whose corners lie at random distances, in order of their angle, so that it does not cross itself."""
    import math
    points = [(cx + reach * rng.uniform(0.3, 1) * math.cos(6.283 * i / corners), cy + reach * rng.uniform(0.3, 1) * math.sin(6.283 * i / corners)) for i in range(corners)]
    return [*points, points[0]]


def shapes() -> list[tuple]:
    rng = random.Random(11)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    found = [[star(rng.uniform(0, 15), rng.uniform(0, 14), rng.choice([3, 5, 40]), rng, rng.uniform(0.2, 6))] for _ in range(12)]
    found += [[box(0, 0, 9, 9), box(2, 2, 4, 4), box(3, 3, 1, 1)], [box(2, 2, 4, 4)[::-1], box(0, 0, 9, 9), box(11, 3, 2, 8)],
              [box(-50, -50, 200, 200)], [box(40, 40, 2, 2)], [box(-3.0, -5.0, 0.7 * 5, 1.1 * 5)],  # all, none, along the cells' own lines
              [box(1.0, 1.01, 12, 0.02)], [[(1.0, 1.0), (1.0, 9.0), (1.0, 1.0)]], [[(5.0, 5.0), (5.0, 5.0)]]]
    return [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in enumerate(found)] + [(90, None), (91, []), (92, [[{"x": float("nan"), "y": 0.0}] * 4])]


@pytest.mark.parametrize("all_touched", [False, True])
def test_spans_hold_the_cells_of_the_predicates(spark, all_touched):
    df = spark.createDataFrame(shapes(), SCHEMA)
    cells = G.grid_cells(spark, GRID)
    x, y = GRID.center_x(F.col("col")), GRID.center_y(F.col("row"))
    hit = geometry.shape_contains(F.col("rings"), x, y)
    if all_touched:
        box = (x - GRID.dx / 2, y - GRID.dy / 2, x + GRID.dx / 2, y + GRID.dy / 2)
        hit = hit | F.exists(geometry.shape_edges(F.col("rings")), lambda e: geometry.edge_meets_box(e, *box))
    expected = {tuple(r) for r in cells.crossJoin(df.filter("poly_id < 90")).filter(hit).select("poly_id", "row", "col").collect()}
    found = [tuple(r) for r in G.cells_in_polygons(cells, df, GRID, all_touched).select("poly_id", "row", "col").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    assert G.study_area_mask(cells, df, GRID, all_touched).count() == len({f[1:] for f in found})


def test_a_ring_alone_is_a_shape(spark):
    df = spark.createDataFrame(shapes()[:12], SCHEMA).select("poly_id", F.col("rings")[0].alias("ring"))
    cells = G.grid_cells(spark, GRID)
    x, y = GRID.center_x(F.col("col")), GRID.center_y(F.col("row"))
    expected = {tuple(r) for r in cells.crossJoin(df).filter(geometry.contains(F.col("ring"), x, y)).select("poly_id", "row", "col").collect()}
    assert {tuple(r) for r in G.cells_in_polygons(cells, df, GRID).select("poly_id", "row", "col").collect()} == expected


def test_exact_tests_grow_with_the_boundary(spark):
    """A shape's edges are looked at once per row that they pass, however many cells its area and the grid have."""
    one = lambda n: spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": float(n), "y": 0.0}, {"x": float(n), "y": float(n)}, {"x": 0.0, "y": float(n)}, {"x": 0.0, "y": 0.0}]])], SCHEMA)
    for n in (10, 100, 1000):
        grid = Grid(0.0, float(n), 1.0, 1.0, n, n)
        assert scan.boundary(one(n), grid, True).count() <= 2 * n + 6
        assert scan.spans(one(n), grid, True).count() == n


def test_crossed_shapes_against_all_pairs(spark):
    rng = random.Random(5)
    rows = shapes()[:16]
    rows += [(100 + i, [[{"x": rng.uniform(0, 9), "y": rng.uniform(0, 9) * stretch} for _ in range(n)]]) for i, (n, stretch) in enumerate([(4, 1), (5, 1), (12, 0), (6, 1e-6), (40, 1)])]
    rows += [(200, [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 0.0}], [{"x": 2.0, "y": 1.0}, {"x": 6.0, "y": 1.0}, {"x": 6.0, "y": 2.0}, {"x": 2.0, "y": 1.0}]])]
    cross = lambda p, e: (e[1][0] - e[0][0]) * (p[1] - e[0][1]) - (e[1][1] - e[0][1]) * (p[0] - e[0][0])
    expected = set()
    for i, rings in rows:
        edges = [((a["x"], a["y"]), (b["x"], b["y"])) for r in rings for a, b in zip(r, r[1:], strict=False)]
        if any(cross(o[0], e) * cross(o[1], e) < 0 and cross(e[0], o) * cross(e[1], o) < 0 for k, e in enumerate(edges) for o in edges[:k]):
            expected.add(i)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.poly_id for r in spatial.crossed_shapes(df).collect()} == expected and {102} < expected | {102} and 200 in expected
    valid = {r.poly_id for r in spatial.clean_shapes(spark.createDataFrame(shapes(), SCHEMA)).collect()}
    assert valid >= {12, 13, 14} and not valid & {18, 19, 90, 91, 92}


def test_measures_of_shapes(spark):
    got = {r.poly_id: r for r in spatial.polygon_measures(spark.createDataFrame(shapes(), SCHEMA)).collect()}
    assert got[12].area == pytest.approx(81 - 16 + 1) and got[13].area == pytest.approx(81 - 16 + 16)
    assert got[12].Centroid_X == pytest.approx((81 * 4.5 - 16 * 4 + 3.5) / 66) and got[13].XMax == 13
    assert got[0].area == pytest.approx(abs(sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(shapes()[0][1][0], shapes()[0][1][0][1:], strict=False)) / 2))
