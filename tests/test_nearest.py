"""The neighbour search against all pairs: evenly spread, clustered, at one place, alone, with ties and with targets of their own."""

import numpy as np
import pandas as pd
import pytest

from gridspark.operators import nearest, quality, spatial


def every_pair(px, py, pid, tx, ty, tid, k, own):
    """Ids and square distances by looking at all points, a few hundred targets at a time."""
    out = {}
    order = np.argsort(pid, kind="stable")
    px, py, pid = px[order], py[order], pid[order]
    for a in range(0, len(tx), 256):
        ex, ey = tx[a:a + 256, None] - px, ty[a:a + 256, None] - py
        square = ex * ex + ey * ey
        if own:
            square[tid[a:a + 256, None] == pid] = np.inf
        for i, row in enumerate(square):
            near = np.argsort(row, kind="stable")[:k]
            out[tid[a + i]] = [(pid[j], row[j]) for j in near if np.isfinite(row[j])]
    return out


def table(spark, x, y, ids=None):
    return spark.createDataFrame(pd.DataFrame({"point_id": np.arange(len(x)) if ids is None else ids, "x": x, "y": y}))


def as_dict(df):
    found = {}
    for r in df.orderBy("point_id", "rank").toPandas().itertuples(index=False):
        found.setdefault(r.point_id, []).append((r.neighbour, r.distance))
        assert r.rank == len(found[r.point_id])
    return found


def same(got, expected):
    expected = {t: n for t, n in expected.items() if n}
    assert set(got) == set(expected)
    for t, n in expected.items():
        assert [i for i, _ in got[t]] == [i for i, _ in n], t
        assert np.allclose([d for _, d in got[t]], [d ** 0.5 for _, d in n])


def clouds(rng, n):
    middle = rng.uniform(0, 1e6, (7, 2))
    return middle[rng.integers(0, 7, n)] + rng.normal(0, 1, (n, 2)) * 10.0 ** rng.integers(-3, 4, (n, 1))


@pytest.mark.parametrize("kind", ["even", "clustered", "lattice", "one place", "a line", "few", "lone"])
def test_own_points(spark, kind):
    rng, n = np.random.default_rng(4), 6000
    xy = {"even": rng.uniform(0, 1, (n, 2)), "clustered": clouds(rng, n), "lattice": rng.integers(0, 60, (n, 2)).astype(float), "one place": np.ones((300, 2)),
          "a line": np.stack([rng.uniform(0, 1e-9, n), np.zeros(n)], axis=1), "few": rng.uniform(0, 1, (5, 2)),
          "lone": np.concatenate([rng.uniform(0, 1, (n, 2)), [[1e7, 1e7], [-1e7, 3.0], [5.0, 5.0]]])}[kind]
    ids = rng.permutation(len(xy))
    same(as_dict(spatial.spatial_knn(table(spark, *xy.T, ids))), every_pair(*xy.T, ids, *xy.T, ids, 8, True))


def test_many_points_in_small_tiles(spark, monkeypatch):
    """100,000 points, dense and thin by turns, in tiles of few: many targets ask neighbouring tiles."""
    monkeypatch.setattr(nearest, "LEAF", 300)
    rng = np.random.default_rng(9)
    xy = np.concatenate([clouds(rng, 60_000), rng.uniform(-1e6, 2e6, (39_990, 2)), np.full((10, 2), 123.0)])
    got = as_dict(spatial.spatial_knn(table(spark, *xy.T)))
    some = rng.choice(len(xy), 3000, replace=False)
    expected = every_pair(*xy.T, np.arange(len(xy)), *xy[some].T, some, 8, True)
    assert len(got) == len(xy)
    same({t: got[t] for t in expected}, expected)


def test_targets_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LEAF", 200)
    monkeypatch.setattr(nearest, "TARGETS", 100)  # tiles with more are shared
    rng = np.random.default_rng(2)
    points, targets = clouds(rng, 3000), np.concatenate([rng.uniform(-5e5, 15e5, (1500, 2)), np.tile(clouds(rng, 1), (700, 1))])
    for k in (1, 8, 40):
        got = as_dict(spatial.spatial_knn(table(spark, *points.T), k, table(spark, *targets.T)))
        same(got, every_pair(*points.T, np.arange(3000), *targets.T, np.arange(len(targets)), k, False))


def test_rows_without_a_place(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, None), (3, float("nan"), 0.0), (4, 3.0, 4.0), (None, 1.0, 0.0)], "point_id long, x double, y double")
    got = {(r.point_id, r.neighbour, r.distance) for r in spatial.spatial_knn(df.filter("point_id is not null")).collect()}
    assert got == {(1, 4, 5.0), (4, 1, 5.0)}
    assert spatial.spatial_knn(df.limit(0)).count() == spatial.spatial_knn(df, 8, df.limit(0)).count() == spatial.spatial_knn(df.limit(0), 8, df).count() == 0


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("b", 0.0, 0.0), ("a", 2.0, 0.0), ("c", 1.0, 0.0)], "point_id string, x double, y double")
    assert sorted((r.point_id, r.neighbour, r.rank) for r in spatial.spatial_knn(df, 1).collect()) == [("a", "c", 1), ("b", "c", 1), ("c", "a", 1)]


def test_tiles_cover_the_square():
    rng = np.random.default_rng(3)
    xy = clouds(rng, 5000)
    tiles = nearest.tiles_of(*xy.T, 50, (*xy.min(axis=0), *xy.max(axis=0)))
    at = tiles.of(*xy.T)
    full = np.bincount(at, minlength=len(tiles.starts)) > 50
    assert (tiles.width[full] == tiles.side / 2 ** nearest.DEPTH).all() and np.isclose((tiles.width ** 2).sum(), tiles.side ** 2)
    slack = 1e-6 * tiles.side
    assert ((xy[:, 0] >= tiles.left[at] - slack) & (xy[:, 0] <= tiles.left[at] + tiles.width[at] + slack)).all()


def test_neighbour_statistics_in_more_partitions(spark, monkeypatch):
    """Many rows are dealt into partitions by their number, and nothing is added up before they are dealt by key; results stay."""
    rows = spark.range(600).selectExpr("id as point_id", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 89 as double) as y", "cast(id % 7 as double) as v")
    want = {r[0]: r[1:] for r in quality.neighbour_stats(rows, ["v"]).collect()}
    monkeypatch.setattr(quality, "NEAR_ROWS", 400)
    found = quality.neighbour_stats(rows, ["v"])
    assert "hashpartitioning(point_id#" in (plan := found._jdf.queryExecution().toString()) and ", 12)" in plan
    got = {r[0]: r[1:] for r in found.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
