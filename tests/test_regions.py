"""Borders of regions as shapes: closed, with holes, equal to the cells that they were made of."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import geometry
from gridspark.model import Grid
from gridspark.operators import regions, spatial
from gridspark.operators import grid as G

PICTURE = """
aaaaaaa.
abbabba.
abcabba.
abbabbba
aaaaaaab
.b.aabab
b.b.abba
"""


def cells_of(spark, picture):
    lines = picture.split()
    return lines, spark.createDataFrame([(r, c, None if v == "." else v) for r, line in enumerate(lines) for c, v in enumerate(line)], "row int, col int, v string")


def check(spark, lines, cells, tile):
    grid = Grid(100.0, 50.0, 2.0, 3.0, len(lines[0]), len(lines))
    shapes = regions.region_shapes(cells, "v", grid, tile).persist()
    labelled = regions.label_regions(cells, "v", grid.width, tile)
    expected = {(r.region, r.row, r.col) for r in labelled.collect()}
    found = G.cells_in_polygons(G.grid_cells(spark, grid), shapes.select("region", "rings"), grid)
    assert {(r.region, r.row, r.col) for r in found.collect()} == expected  # the shapes hold their cells and no others
    for r in shapes.select("*", geometry.shape_area(F.col("rings")).alias("area")).collect():
        assert r.area == pytest.approx(6 * r.n)
        signs = [sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:], strict=False)) for ring in r.rings]
        assert signs[0] < 0 and all(s > 0 for s in signs[1:]) and all(ring[0] == ring[-1] and len(ring) >= 5 for ring in r.rings)
        for ring in r.rings:  # corners only: directions alternate
            level = [a["y"] == b["y"] for a, b in zip(ring, ring[1:], strict=False)]
            assert all(a != b for a, b in zip(level, level[1:], strict=False)) and level[0] != level[-1]
    assert spatial.clean_shapes(shapes, "region").count() == shapes.count()
    return {r.region: r for r in shapes.collect()}


@pytest.mark.parametrize("tile", [3, 64])
def test_shapes_with_holes_and_corners_that_touch(spark, tile):
    lines, cells = cells_of(spark, PICTURE)
    found = check(spark, lines, cells, tile)
    assert len(found[0].rings) == 2 and found[0].value == "a"  # an area of b inside, which has c inside
    assert sum(len(r.rings) == 2 for r in found.values()) >= 1


def test_random_pictures(spark):
    rng = random.Random(3)
    for kinds in ("ab", "aaab."):
        lines, cells = cells_of(spark, "\n".join("".join(rng.choice(kinds) for _ in range(14)) for _ in range(11)))
        check(spark, lines, cells, 4)


def test_no_cells(spark):
    assert regions.region_shapes(cells_of(spark, "..\n..")[1], "v", Grid(0, 0, 1, 1, 2, 2)).count() == 0


def test_no_table_of_edges_goes_through_the_driver(spark):
    cells = spark.range(400).selectExpr("cast(id div 20 as int) as row", "cast(id % 20 as int) as col", "cast(id * 7 % 3 as int) as v")
    labelled, edges = regions.polygonize(cells, "v", 20, 8)
    for df in (edges, regions._following(edges), regions.region_rings(edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Broadcast" not in plan
