"""Neighbourhoods in array tiles against every cell looked at by itself, over tile borders, gaps and the grid's edge."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from gridspark.operators import cells as V
from gridspark.operators import tiles


@pytest.fixture(scope="module")
def grid(spark):
    rng = random.Random(6)
    values = {(r, c): None if rng.random() < 0.2 else round(rng.uniform(-5, 5), 3) for r in range(23) for c in range(17) if rng.random() > 0.05 or (r, c) == (22, 16)}
    return values, spark.createDataFrame([(r, c, v) for (r, c), v in values.items()], "row int, col int, v double").repartition(4).persist()


PLAIN = {"mean": statistics.fmean, "median": statistics.median, "min": min, "max": max}


@pytest.mark.parametrize("tile", [1, 4, 7, 256])
@pytest.mark.parametrize("window,mirrored", [(3, True), (4, True), (5, False), (1, True), (9, True)])
def test_neighbourhoods(grid, tile, window, mirrored):
    values, df = grid
    half = window // 2
    offsets = [(r, c) for r in range(-half, window - half) for c in range(-half, window - half)]

    def turned(i, n):
        return -1 - i if mirrored and i < 0 else 2 * n - 1 - i if mirrored and i >= n else i

    got = {(r.row, r.col): r for r in tiles.neighbourhood(df, "v", offsets, list(PLAIN), mirrored, F.col("col") % 3 != 1, tile).collect()}
    assert set(got) == {at for at in values if at[1] % 3 != 1}
    for (r, c), found in got.items():
        near = [v for a, b in offsets if (v := values.get((turned(r + a, 23), turned(c + b, 17)))) is not None]
        for name, plain in PLAIN.items():
            assert found[name] == (pytest.approx(plain(near)) if near else None)


def test_cells_are_shuffled_once_with_their_borders(spark):
    """Of 64 x 64 tiles a window of three takes the tile's border from its neighbours, no row for each neighbour."""
    cells = spark.range(128 * 128).selectExpr("cast(id div 128 as int) as row", "cast(id % 128 as int) as col", "cast(id as double) as v")
    sent = cells.select(F.explode(tiles._halo("row", 1, 1, 64)).alias("_tr"), "col").select(F.explode(tiles._halo("col", 1, 1, 64)), "_tr").count()
    assert sent < 1.1 * 128 * 128


def test_unknown_statistic(grid):
    with pytest.raises(ValueError):
        V.focal(grid[1], "v", "mode")
