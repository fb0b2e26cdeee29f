"""Registered queries against their DuckDB SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from gridspark.plans import queries as plans

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for file in Path(SMALL).glob("*.parquet"):
        con.sql(f"create view {file.stem} as from '{file}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return round(float(value), 9) + 0.0
    return value.isoformat()[:10] if hasattr(value, "isoformat") else str(value)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    names = sorted(df.columns)
    found = duck.sql(plans.ORACLES[name])
    assert sorted(found.columns) == names
    quoted = ", ".join(f'"{n}"' for n in names)
    key = lambda r: tuple(str(v) for v in r)
    mine = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{n}`" for n in names)).collect()), key=key)
    theirs = sorted((tuple(map(plain, r)) for r in duck.sql(f"select {quoted} from ({plans.ORACLES[name]})").fetchall()), key=key)
    assert mine == theirs
    spark.catalog.clearCache()


def collected(spark, name) -> list:
    found = plans.QUERIES[name](spark, SMALL).collect()
    spark.catalog.clearCache()
    assert found
    return found


#: What holds for the rows of each query without SQL.
PROPERTIES = {
    "g3_target_grid": lambda r: all(x.inside for x in r) and len({(x.target_row, x.target_col) for x in r}) > len(r) / 2,
    "v16_pca": lambda r: all(1 >= x.share_1 >= x.share_2 >= x.share_3 >= 0 for x in r) and abs(sum(x.pca_1 for x in r)) < 1e-3 * len(r),
    "s9_save_and_load_model": lambda r: all(x.n_features == 6 and x.prediction == x.prediction for x in r),
    "c7_ks_normal": lambda r: len(r) == 1 and 0 < r[0].statistic < 1 and 0 <= r[0].p_value <= 1 and not r[0].is_normal,
    "m1_rf_regressor": lambda r: len(r) == 1 and r[0].R2 <= 1 and abs(r[0].RMSE ** 2 - r[0].MSE) < 1e-2 and r[0].MAE <= r[0].RMSE,
    "m2_rf_classifier": lambda r: len(r) == 1 and 0.15 < r[0].accuracy <= 1 and abs(r[0].accuracy - r[0].recall) < 1e-6,
    "m3_rfecv": lambda r: sorted(x.n_features for x in r) == list(range(1, 13)) and sum(x.chosen for x in r) == 1 and max(r, key=lambda x: x.score).score == next(x.score for x in r if x.chosen) and all(x.score < 0 for x in r),
    "m4_random_search": lambda r: {x.parameter: x.value in plans.SPACE[x.parameter] for x in r} == dict.fromkeys(plans.SPACE, True) and len({x.score for x in r}) == 1,
    "m5_refine_grid": lambda r: all(x.n_grid == 54 for x in r) and {x.parameter: x.value for x in r}["max_depth"] in (1, 6, 11),
    "m10_feature_importance": lambda r: sorted(x.feature for x in r) == ["b1", "b2", "b3", "x", "y"] and abs(sum(x.l1 for x in r) - 1) < 1e-4 and abs(sum(x.l2 for x in r) - 1) < 1e-4
    and all((x.l1 == 0) == (x.feature in ("b3", "y")) or x.feature == "b2" for x in r),
    "m13_hyperparameter_table": lambda r: sorted((x.label, x.parameter) for x in r) == [("l2", p) for p in sorted(plans.SPACE)] and all(x.value in plans.SPACE[x.parameter] for x in r),
    "m17_regression_kriging": lambda r: all(x.kriging_variance is None or x.kriging_variance >= 0 for x in r) and all(x.rfrk is not None for x in r),
    "m18_choose_model": lambda r: len(r) == 1 and r[0].model in ("RF", "RFRK") and r[0].R2 <= 1,
    "m19_leaderboard": lambda r: len(r) == 7 and all(0 < x.score_test <= 1 and 0 < x.score_train <= 1 for x in r) and [x.score_test for x in r] == sorted((x.score_test for x in r), reverse=True),
    "m20_permutation_importance": lambda r: [x.feature for x in r] == ["b1", "b2", "x"],
    "m21_explain_tree": lambda r: r[0].rule == "all" and r[0].depth == 0 and sum(x.n for x in r if x.depth == 1) == r[0].n,
    "u1_predict_cells": lambda r: any(x.prediction is None for x in r) and any(x.prediction is not None for x in r),
    "u2_tree_uncertainty": lambda r: all(x.prediction is not None and x.uncertainty >= 0 for x in r),
    "u3_kriging_uncertainty": lambda r: all(x.final_uncertainty >= 0 for x in r) and any(x.final_uncertainty != x.uncertainty for x in r),
    "u7_available_features": lambda r: {x.features for x in r} == {"b3,b1"} and all(x.prediction is not None for x in r),
    "u8_predict_all": lambda r: {x.label for x in r} == {"l1", "l2"} and {x.left_out for x in r} == {"l3"} and {x["class"] for x in r} <= {None, 0, 1, 2, 3, 4},
    "u8_statistics": lambda r: sorted((x.label, x.layer) for x in r) == [(a, b) for a in ("l1", "l2") for b in ("prediction", "uncertainty")]
    and all(x.min <= x.d1 <= x.q25 <= x.median <= x.q75 <= x.d9 <= x.max and x.min <= x.mean <= x.max and x.std >= 0 for x in r),
    "u8_legend": lambda r: sorted((x.label, x["class"]) for x in r) == [(a, k) for a in ("l1", "l2") for k in range(5)] and all(x.lower <= x.upper for x in r),
    "u9_predict_type": lambda r: {x.prediction for x in r} <= {None, *map(float, range(10))} and any(x.prediction is not None for x in r),
}


@pytest.mark.parametrize("name", sorted(plans.QUERIES.keys() - plans.ORACLES.keys()))
def test_properties_without_sql(spark, name):
    assert PROPERTIES[name](collected(spark, name))


def test_every_cell_polygon_and_point_of_the_adapters_counts(spark):
    """Grids and extents follow the tables: points lie over all rows of cells, polygons over all and beyond."""
    from gridspark.sources import adapters

    grid, cells = adapters.grid(spark, SMALL), adapters.cells(spark, SMALL)
    assert cells.filter(grid.holds(cells.row, cells.col)).count() == cells.count() == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    points = adapters.points(spark, SMALL)
    assert points.count() == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert points.select(grid.row(points.y)).distinct().count() == grid.height + 1
    assert adapters.polygons(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/supplier.parquet").count()


def test_types_are_predicted_where_a_polygon_touches(spark):
    """Code of every cell by the forest alone, and none beyond the polygons by DuckDB's own mask."""
    from gridspark.operators import learn
    from gridspark.sources import adapters

    cells = adapters.cells(spark, SMALL)
    model = learn.fit(plans._coded(plans.training(spark, SMALL)), "code", plans.FEATURES, "classification", n_estimators=5, max_depth=8)
    codes = {(r.row, r.col): r.prediction for r in model.transform(cells.dropna(subset=plans.FEATURES)).select("row", "col", "prediction").collect()}
    duck = duckdb.connect()
    for file in Path(SMALL).glob("*.parquet"):
        duck.sql(f"create view {file.stem} as from '{file}'")
    inside = {tuple(r) for r in duck.sql(f"""select "row", col from ({plans.ORACLES['g10_mask_all_touched']})""").fetchall()}
    got = {(r.row, r.col): r.prediction for r in collected(spark, "u9_predict_type")}
    assert set(got) == {(r.row, r.col) for r in cells.select("row", "col").collect()}
    assert got == {at: codes.get(at) if at in inside else None for at in got}
