"""Grid, cell and geometry operators on hand-made cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import geometry
from gridspark.functions.crs import to_crs, unproject
from gridspark.functions.indices import condition_mask, indices, safe_divide
from gridspark.model import Grid, missing
from gridspark.operators import cells as V
from gridspark.operators import grid as G
from gridspark.operators import regions, scenes, spatial
from gridspark.plans.queries import QUERIES

FIVE = Grid(0.0, 5.0, 1.0, 1.0, 5, 5)


def five(spark, holes=(), value=lambda r, c: float(10 * r + c)):
    return spark.createDataFrame([(r, c, None if (r, c) in holes else value(r, c)) for r in range(5) for c in range(5)], "row int, col int, v double")


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def shapes(spark, rings):
    return spark.createDataFrame(list(enumerate(rings)), "poly_id long, ring array<struct<x:double,y:double>>")


def test_gaps_take_the_mean_of_the_neighbours(spark):
    got = {(r.row, r.col): r for r in V.fill_nodata(five(spark, [(0, 0), (2, 2)]), "v").collect()}
    assert got[2, 2].filled and got[2, 2].v == pytest.approx(np.mean([10 * r + c for r in range(0, 4) for c in range(0, 4) if (r, c) not in ((0, 0), (2, 2))]))
    assert got[0, 0].v == pytest.approx(np.mean([1, 10, 11])) and not got[4, 4].filled


def test_a_gap_among_gaps_takes_the_layers_mean(spark):
    holes = [(r, c) for r in range(5) for c in range(5) if (r, c) not in ((4, 4), (4, 3))]
    got = {(r.row, r.col): r.v for r in V.fill_nodata(five(spark, holes), "v").collect()}
    assert got[0, 0] == 43.5


def test_focal_mirrors_the_border(spark):
    got = {(r.row, r.col): r.focal for r in V.focal(five(spark), "v").collect()}
    a = np.pad(np.array([[10.0 * r + c for c in range(5)] for r in range(5)]), 1, mode="symmetric")
    for r in range(5):
        for c in range(5):
            assert got[r, c] == pytest.approx(a[r:r + 3, c:c + 3].mean())
    least = {(r.row, r.col): r.focal for r in V.focal(five(spark), "v", "min").collect()}
    assert least[2, 2] == 11 and least[0, 0] == 0


def test_masked_cells_are_replaced(spark):
    got = {(r.row, r.col): r.v for r in V.fill_where(five(spark), "v", F.col("v") > 43, "custom", -1.0).collect()}
    assert got[4, 4] == -1 and got[4, 3] == 43


def test_conditions_and_division(spark):
    df = spark.createDataFrame([(1.0, 0.0), (6.0, 3.0), (None, 1.0), (float("inf"), 1.0), (0.0, 0.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_divide(F.col("a"), F.col("b"), -9.0)).collect()] == [-9, 2, -9, -9, -9]
    assert [r[0] for r in df.select(condition_mask(F.col("a"), [(">", 5), ("==", 0)])).collect()] == [False, True, False, True, True]
    with pytest.raises(ValueError):
        condition_mask(F.col("a"), [("~", 1)])
    with pytest.raises(ValueError):
        indices(df, {"unknown": {"nir": "a"}})
    assert [r[0] for r in df.select(missing(F.when(F.col("b") == 3, float("nan")).otherwise(F.col("a")), 1.0)).collect()] == [None, None, None, float("inf"), 0]


def test_projection(spark):
    at = spark.createDataFrame([(105.0, 0.0), (105.0, 30.0), (106.4, 41.5), (103.6, 22.2)], "lon double, lat double")
    x, y = to_crs(F.col("lon"), F.col("lat"), 4326, 4544)
    placed = at.select("lon", "lat", x.alias("x"), y.alias("y"))
    rows = placed.collect()
    assert rows[0].x == pytest.approx(500000) and rows[0].y == pytest.approx(0, abs=1e-6)
    assert rows[1].y == pytest.approx(3320113.398, abs=1e-2)  # meridian arc to 30 degrees
    lon, lat = unproject(F.col("x"), F.col("y"), 4544)
    for r in placed.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect():
        assert abs(r.lon - r.a) < 1e-8 and abs(r.lat - r.b) < 1e-8
    with pytest.raises(ValueError):
        to_crs(x, y, 4326, 3857)


def test_mosaic_takes_the_first_value_by_name(spark):
    parts = spark.createDataFrame([("b", 0, 0, "x", 1.0), ("a", 0, 0, "x", None), ("c", 0, 0, "x", 3.0), ("a", 0, 1, "x", 2.0)], "part string, row int, col int, band string, value double")
    assert sorted((r.col, r.value) for r in G.mosaic(parts).collect()) == [(0, 1.0), (1, 2.0)]


def test_resampling(spark):
    cells = five(spark).select(F.lit("v").alias("layer"), "row", "col", F.col("v").alias("value"))
    got = {(r.row, r.col): r.value for r in G.resample_nearest(cells, FIVE, Grid(-1.0, 6.0, 2.0, 2.0, 4, 4), ["v"], fill=None).collect()}
    assert got[0, 0] == 0.0 and got[1, 1] == 22.0 and got[3, 3] is None and len(got) == 16
    target = G.target_grid(spark, FIVE, 4326)
    assert (target.width, target.height, round(target.dx, 9)) == (5, 5, 1.0)


def test_tiles(spark):
    box = spark.createDataFrame([(1, 0.0, 0.0, 1000.0, 1000.0)], "id int, minx double, miny double, maxx double, maxy double")
    assert scenes.split_extent(box, 10.0).count() == 1
    assert scenes.split_extent(box, 1.0, 40e6).count() == 9  # 72 MB: ceil(sqrt(1.8)) + 1
    triangle = box.withColumn("ring", F.lit(None).cast("array<struct<x:double,y:double>>")).drop("ring").crossJoin(
        shapes(spark, [ring((0, 0), (900, 0), (0, 900), (0, 0))]).select("ring"))
    assert scenes.split_extent_within(triangle, 10.0, 1200).count() == 6  # of nine, three lie beyond the slope


def test_months(spark):
    days = spark.sql("select date '2024-01-15' as start, date '2024-03-10' as end")
    assert [(str(r.month_start), str(r.month_end)) for r in scenes.month_ranges(days).orderBy("month_start").collect()] == [
        ("2024-01-15", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-10")]


SHAPES = [
    ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)),   # concave
    ring((0.2, 2.45), (4.8, 2.45), (4.8, 2.55), (0.2, 2.55), (0.2, 2.45)),  # thinner than a cell
    ring((0, 0), (2, 2), (2, 0), (0, 2), (0, 0)),           # crossed
    ring((0, 0), (1, 0), (1, 1)),                           # open
    None,
    ring((20, 20), (22, 20), (22, 22), (20, 20)),           # elsewhere
]


def test_polygon_faults_and_measures(spark):
    polygons = shapes(spark, SHAPES)
    assert sorted(r.poly_id for r in spatial.clean_polygons(polygons).collect()) == [0, 1, 5]
    assert tuple(spatial.polygon_faults(polygons).first()) == (1, 2, 3)
    areas = {r.poly_id: r.area for r in spatial.polygon_measures(polygons).collect()}
    assert areas[0] == pytest.approx(10) and areas[5] == pytest.approx(2)


def test_cells_in_polygons(spark):
    polygons = shapes(spark, SHAPES[:2])
    cells = five(spark)
    centre = {(r.poly_id, r.row, r.col) for r in G.cells_in_polygons(cells, polygons, FIVE).collect()}
    assert {(4 - r, c) for p, r, c in centre if p == 0} >= {(0, 0), (0, 3), (1, 0)} and (0, 1, 2) not in centre
    assert {(r, c) for p, r, c in centre if p == 1} == {(2, c) for c in range(5)}
    touched = {(r.poly_id, r.row, r.col) for r in G.cells_in_polygons(cells, polygons, FIVE, all_touched=True).collect()}
    assert centre < touched and {(r, c) for p, r, c in touched if p == 1} == {(2, c) for c in range(5)}
    assert G.study_area_mask(cells, polygons, FIVE).count() == len({x[1:] for x in centre})


def test_zonal_majority_and_empty_zones(spark):
    cells = spark.createDataFrame([("k", r, c, None if r == c else float((r + c) % 2)) for r in range(5) for c in range(5)], "layer string, row int, col int, value double")
    out = {r.poly_id: r for r in spatial.zonal_all(shapes(spark, [ring((0.1, 0.1), (4.9, 0.1), (4.9, 4.9), (0.1, 4.9), (0.1, 0.1)), SHAPES[5]]), cells, FIVE, ["k"]).collect()}
    assert (out[0].k_count, out[0].k_majority, out[1].k_count, out[1].k_mean) == (20, 1.0, 0, None)


def test_large_integers(spark):
    df = spark.createDataFrame([(2 ** 53 - 1, 2 ** 53), (-5, 3)], "a long, b long")
    assert {r["column"]: r.large for r in spatial.large_integers(df).collect()} == {"a": False, "b": True}
    assert dict(spatial.large_integers_as_text(df).dtypes) == {"a": "bigint", "b": "string"}


@pytest.mark.parametrize("kind", ["uniform", "clustered", "same place", "few"])
def test_nearest_neighbours_against_all_pairs(spark, kind):
    random.seed(2)
    spot = {"uniform": lambda i: (random.random(), random.random()), "few": lambda i: (i, 0.0), "same place": lambda i: (float(i % 3), 1.0),
            "clustered": lambda i: ((random.gauss(0, 1e-3), random.gauss(0, 1e-3)) if i % 10 else (random.uniform(-9, 9), random.uniform(-9, 9)))}[kind]
    points = spark.createDataFrame([(i, *map(float, spot(i))) for i in range(5 if kind == "few" else 300)], "point_id long, x double, y double")
    rows = lambda df: sorted((r.point_id, r.rank, r.neighbour, round(r.distance, 9)) for r in df.collect())
    assert rows(spatial.spatial_knn(points, 8)) == rows(spatial.knn_brute_force(points, 8))


@pytest.mark.parametrize("tile", [2, 64])
def test_regions(spark, tile):
    picture = ["aabb", "abba", "aaaa", "bbab", "abba"]
    cells = spark.createDataFrame([(r, c, v) for r, line in enumerate(picture) for c, v in enumerate(line)], "row int, col int, v string")
    seen, sizes = set(), []
    for r0 in range(5):
        for c0 in range(4):
            if (r0, c0) in seen:
                continue
            todo, size = [(r0, c0)], 0
            seen.add((r0, c0))
            while todo:
                r, c = todo.pop()
                size += 1
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if 0 <= n[0] < 5 and 0 <= n[1] < 4 and n not in seen and picture[n[0]][n[1]] == picture[r][c]:
                        seen.add(n)
                        todo.append(n)
            sizes.append((r0 * 4 + c0, size))
    found, edges = regions.polygonize(cells, "v", 4, tile)
    assert sorted((r.region, r.n) for r in found.collect()) == sorted(sizes)
    whole = regions.polygonize(cells.withColumn("v", F.lit("a")), "v", 4, tile)[1]
    assert whole.count() == 2 * (5 + 4) and edges.count() > 18


def test_components_are_centred_and_uncorrelated(spark):
    random.seed(1)
    rows = [(i, 0, random.gauss(5, 1), random.gauss(0, 3), 0.0) for i in range(200)]
    df = spark.createDataFrame([(r, c, a, b, a + b) for r, c, a, b, _ in rows], "row int, col int, a double, b double, s double")
    scores, shares = V.pca(df, ["a", "b", "s"], 2)
    stats = scores.agg(F.avg("pca_1"), F.avg("pca_2"), F.corr("pca_1", "pca_2")).first()
    assert all(abs(v) < 1e-9 for v in stats) and sum(shares) == pytest.approx(1) and shares[0] > shares[1]


def test_centroid_of_a_square(spark):
    x, y = geometry.centroid(F.col("ring"))
    assert tuple(shapes(spark, [ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))]).select(x, y).first()) == (1.0, 1.0)
    assert math.isclose(shapes(spark, [SHAPES[0]]).select(geometry.area(F.col("ring"))).first()[0], 10)


def test_projection_of_a_grid_beyond_the_pole(spark, tmp_path):
    """A tall grid has latitudes beyond the pole; there and back again gives the same place on the ground, at the pole too."""
    path = str(tmp_path)
    spark.createDataFrame([(i, "view", 1.0) for i in range(3000)], "event_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    spark.createDataFrame([(100_000, [0.0] * 13, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    found = QUERIES["g1_to_crs"](spark, path)
    assert found.count() == 3000 and found.filter("lon_error <> 0 or lat_error <> 0").count() == 0
    pole = spark.range(1).select(*(c.alias(n) for n, c in zip("xy", to_crs(F.lit(105.5), F.lit(89.9999), 4326, 4544), strict=True)))
    assert abs(pole.select(unproject(F.col("x"), F.col("y"), 4544)[1]).first()[0] - 89.9999) < 1e-9
