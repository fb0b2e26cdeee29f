"""Semivariances over all pairs, held against forming them."""

import numpy as np
import pytest

from gridspark.operators import krige, lags

FIELDS = "x double, y double, v double"


def plain(rows, side, classes):
    """Count, mean half squared difference and mean distance by class, over all pairs."""
    x, y, v = (np.array(c) for c in zip(*rows, strict=True))
    i, j = np.triu_indices(len(x), 1)
    d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
    i, j, d = i[d <= side], j[d <= side], d[d <= side]
    lag = np.minimum(np.floor(d / (side / classes)), classes - 1).astype(int)
    n, g, s = (np.bincount(lag, w, classes) for w in (np.ones(len(d)), 0.5 * (v[i] - v[j]) ** 2, d))
    return {k + 1: (n[k], g[k] / n[k], s[k] / n[k]) for k in range(classes) if n[k]}


def spread(kind, n=1500):
    rng = np.random.default_rng(5)
    x, y = rng.uniform(0, 100, (2, n))
    if kind == "clusters":  # whole numbers, so that distances fall on the ends of classes
        x, y = np.round(rng.normal(0, 2, (2, n))) + rng.choice([0, 30, 90], n)
    elif kind == "one place":
        x[: n // 3], y[: n // 3] = 50.0, 50.0
    elif kind == "line":
        y[:] = 7.0
    return list(zip(x.tolist(), y.tolist(), (1e6 + rng.normal(0, 1, n)).tolist(), strict=True))


@pytest.mark.parametrize("kind", ["uniform", "clusters", "one place", "line"])
@pytest.mark.parametrize("side", [6.0, 40.0])
def test_lags_are_those_of_all_pairs(spark, monkeypatch, kind, side):
    monkeypatch.setattr(lags, "TILE", 100)
    rows = spread(kind)
    want = plain(rows, side, 6)
    got = {r.lag: r for r in krige.lag_table(spark.createDataFrame(rows, FIELDS), "v", side).collect()}
    assert set(got) == set(want)
    for lag, (n, g, d) in want.items():
        assert got[lag].n == n and got[lag].gamma == pytest.approx(g, rel=1e-6) and got[lag].distance == pytest.approx(d, rel=1e-6)


def test_far_runs_are_counted_at_once(monkeypatch):
    """Exact counts and sums, distances within the stated share, and a third of the pairs at least never formed."""
    monkeypatch.setattr(lags, "LEAF", 4)
    rng = np.random.default_rng(2)
    x, y = rng.uniform(0, 100, (2, 2000))
    v = rng.normal(0, 1, 2000)
    at_once, mean = [], lags._mean_distance
    monkeypatch.setattr(lags, "_mean_distance", lambda a, i, b, j: at_once.append((a.n[i] * b.n[j]).sum()) or mean(a, i, b, j))
    n, g, d = lags.pair_sums(lags.tree_of(np.stack([x, y, np.ones(2000), v, v * v])), None, 90.0, 3)
    for lag, (count, gamma, distance) in plain(list(zip(x, y, v, strict=True)), 90.0, 3).items():
        assert n[lag - 1] == count and g[lag - 1] / count == pytest.approx(gamma, rel=1e-9) and d[lag - 1] / count == pytest.approx(distance, rel=1.5e-3)
    assert sum(at_once) > n.sum() / 3


def test_lags_of_odd_rows(spark):
    odd = [(0.0, 0.0, 1.0), (0.0, 3.0, 3.0), (None, 1.0, 5.0), (1.0, float("nan"), 5.0), (1.0, 1.0, None), (1.0, 1.0, float("inf")), (1.0, 1.0, float("nan"))]
    found = krige.lag_table(spark.createDataFrame(odd, FIELDS), "v", 6.0).collect()
    assert [tuple(r) for r in found] == [(4, 3.0, 2.0, 1)]
    assert krige.lag_table(spark.createDataFrame(odd[:1], FIELDS), "v", 6.0).count() == 0
    assert krige.lag_table(spark.createDataFrame([], FIELDS), "v", 6.0).count() == 0


def test_places_are_sent_in_few_copies_and_bytes():
    """What a place costs on the way to its partners does not grow with their number."""
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 1009, 30000).astype(float), rng.integers(0, 40000, 30000).astype(float)
    s, n = rng.normal(0, 1, 30000), 1.0 + (rng.uniform(size=30000) < 0.1)
    places = np.stack([x, y, n, s, np.where(n == 1, s * s, s * s + 1)])
    packed = lags._packed(places)
    assert np.array_equal(lags._unpacked(packed, 30000), places) and len(packed) < 20 * 30000
    side = float(np.hypot(1009, 40000)) / 8
    tiles = lags.tiles_of(x, y, len(x) // lags.TILE_SHARE, (0.0, 0.0, 1009.0, 40000.0))
    copies = np.mean([len(lags._partners(tiles, t, side)) for t in tiles.of(x, y)[:500].tolist()])
    assert copies < 50  # a quarter of the tiles lies within reach
