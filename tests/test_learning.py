"""Preparation, models, kriging, prediction, stored models and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import crs, quantiles
from gridspark.functions.indices import INDICES
from gridspark.model import Grid
from gridspark.operators import krige, learn, predict, prep, quality, spatial
from gridspark.plans import queries as plans
from gridspark.sources import adapters, tables
from gridspark.streaming import rowwise

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def train(spark):
    random.seed(3)
    rows = [(i, random.uniform(0, 10), random.uniform(0, 10), random.uniform(0, 1)) for i in range(240)]
    return spark.createDataFrame([(i, x, y, b, 3 * x + b, float(x > 5), int(x), int(y)) for i, x, y, b in rows],
                                 "point_id long, x double, y double, b double, v double, k double, row int, col int").persist()


def test_trees_average_to_the_forests_prediction(spark, train):
    model = learn.fit(train, "v", ["x", "b"], n_estimators=7, max_depth=5)
    plain = {r.point_id: r.prediction for r in model.transform(train).collect()}
    for r in learn.tree_uncertainty(model, train).collect():
        assert r.prediction == pytest.approx(plain[r.point_id]) and r.uncertainty >= 0


def test_stored_models(spark, train, tmp_path):
    model = learn.fit(train, "k", ["x", "b"], "classification", n_estimators=3, max_depth=3)
    tables.save_model(model, ["x", "b"], str(tmp_path / "m"), label="k")
    again, meta = tables.load_model(spark, str(tmp_path / "m"))
    assert meta["feature_names"] == ["x", "b"] and meta["label"] == "k"
    assert [r.prediction for r in again.transform(train).orderBy("point_id").collect()] == [r.prediction for r in model.transform(train).orderBy("point_id").collect()]
    with pytest.raises(ValueError):
        predict.available_features(train.drop("b"), meta["feature_names"])


def test_kriging_without_a_nugget_returns_the_points(train):
    out = krige.ordinary_kriging(train, train.select("point_id", "x", "y"), "v", (0.0, 5.0, 4.0), k=6).join(train, "point_id").collect()
    assert all(r.kriged == pytest.approx(r.v, abs=1e-6) and r.variance < 1e-6 for r in out)


def test_kriging_with_points_at_one_place(spark):
    points = spark.createDataFrame([(i, float(i // 2), 0.0, float(i)) for i in range(8)], "point_id long, x double, y double, v double")
    out = krige.ordinary_kriging(points, points.filter("point_id = 0"), "v", (0.0, 1.0, 2.0), k=3).first()
    assert out.kriged == pytest.approx(0.5)


def test_variogram_fit_finds_the_curve():
    d = np.linspace(1, 12, 6)
    nugget, sill, reach = krige.fit_variogram([(x, float(krige.gamma(np.array([x]), "spherical", 0.5, 2.0, 9.0)[0]), 10) for x in d])
    assert abs(nugget - 0.5) < 0.15 and abs(sill - 2) < 0.2 and abs(reach - 9) < 1


def test_elimination_and_search(train):
    chosen, history = learn.rfecv(train, "v", ["b", "y", "x"], folds=3, n_estimators=3, max_depth=4)
    assert "x" in chosen and [n for n, _ in history] == [3, 2, 1]
    best, _ = learn.random_search(train, "v", ["x"], "regression", {"n_estimators": [2], "max_depth": [1, 6], "min_samples_split": [2], "min_samples_leaf": [1]}, 2)
    assert best["max_depth"] == 6
    grid = learn.refine_grid({"n_estimators": 20, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1})
    assert {g["n_estimators"] for g in grid} == {10, 20, 70} and {g["max_depth"] for g in grid} == {None, 10, 20} and len(grid) == 3 * 3 * 2 * 2


def test_no_fold_sees_its_test_rows(train):
    """Elimination fold by fold by hand: rank and fit on the training rows only, mean negative RMSE chooses."""
    import math

    from pyspark.ml.feature import VectorAssembler
    from gridspark.operators.prep import bucket

    names, by_number = ["b", "y"], {2: [], 1: []}
    for fold in range(3):
        rows = train.withColumn("_f", bucket(F.col("point_id"), 7, 3))
        inside, outside = learn.ordered(rows.filter(F.col("_f") != fold), "point_id"), rows.filter(F.col("_f") == fold)
        left = list(names)
        while left:
            assembler = VectorAssembler(inputCols=[*left, "x"], outputCol="features")
            model = learn.forest("regression", "v", n_estimators=3, max_depth=4).fit(assembler.transform(inside))
            errors = [(r.v - r.prediction) ** 2 for r in model.transform(assembler.transform(outside)).collect()]
            by_number[len(left)].append(-math.sqrt(sum(errors) / len(errors)))
            importance = dict(zip(left, model.featureImportances.toArray()[:len(left)], strict=True))
            left.remove(min(left, key=lambda n: (importance[n], n)))
    expected = {n: sum(s) / 3 for n, s in by_number.items()}
    chosen, history = learn.rfecv(train, "v", names, always=["x"], folds=3, n_estimators=3, max_depth=4)
    assert dict(history) == pytest.approx(expected) and len(chosen) == max(expected, key=lambda n: (expected[n], -n))


def test_tables_are_made_when_asked_for(spark, train, monkeypatch):
    """A legend takes no statistics, and statistics no class limits."""
    wide, model = train.selectExpr("cast(point_id as int) as row", "0 as col", "x"), learn.fit(train, "v", ["x"], n_estimators=2, max_depth=3)
    asked, search = [], predict.quantiles
    monkeypatch.setattr(predict, "quantiles", lambda df, shares: asked.append(sorted(shares)) or search(df, shares))
    found = predict.predict_all({"one": model}, wide)
    assert not asked and found.legend.count() == 5 and asked == [["uncertainty_0"]]
    assert found.statistics.count() == 2 and asked[1:] == [["prediction_0", "uncertainty_0"]]
    assert found.cells.count() == wide.count() and len(asked) == 2
    none = predict.predict_all({}, wide)
    assert none.cells is none.statistics is none.legend is None


def test_statistics_and_legend_of_every_label(spark, train):
    models = {k: learn.fit(train, "v", f, n_estimators=3, max_depth=4) for k, f in (("one", ["x", "b"]), ("two", ["x"]))}
    wide = train.selectExpr("cast(point_id as int) as row", "0 as col", "x", "case when point_id % 5 = 0 then null else b end as b")
    found = predict.predict_all(models, wide)
    cells = found.cells.toPandas()
    for label, part in cells.groupby("label"):
        assert len(part) == wide.count() and part["prediction"].isna().sum() == (wide.filter("b is null").count() if label == "one" else 0)
        lines = {r["layer"]: r for r in found.statistics.filter(F.col("label") == label).toPandas().to_dict("records")}
        for layer in ("prediction", "uncertainty"):
            values = part[layer].dropna()
            assert lines[layer]["median"] == pytest.approx(values.median()) and lines[layer]["d3"] == pytest.approx(values.quantile(0.3))
            assert lines[layer]["std"] == pytest.approx(values.std(ddof=0)) and lines[layer]["max"] == values.max()
        legend = found.legend.filter(F.col("label") == label).orderBy("class").collect()
        assert [r.upper for r in legend] == pytest.approx(part["uncertainty"].quantile([0.2, 0.4, 0.6, 0.8, 1.0]).tolist())
        expected = part["uncertainty"].map(lambda u: None if u != u else sum(u >= r.upper for r in legend[:-1]))
        assert part["class"].dropna().tolist() == expected.dropna().tolist()


def test_leaderboard_and_importance(train):
    board = learn.leaderboard(train.filter("point_id % 4 > 0"), train.filter("point_id % 4 = 0"), "k", ["x", "b"], 2)
    assert len(board) == 7 and board[0][1] > 0.9
    assert {n for n, test, _ in board if test > 0.85} >= {"ExtraTreesGini", "ExtraTreesEntr"}
    model = learn.fit(train, "v", ["x", "b"], n_estimators=3, max_depth=5)
    lost = dict(learn.permutation_importance(model, train, "v", ["x", "b"]))
    assert lost["x"] > 0.5 > lost["b"]
    nodes = learn.explain_tree(train, "v", ["x", "b"])
    assert nodes[0][2:4] == ("all", 240) and "x <=" in nodes[1][2]


def test_choice_prefers_the_forest_in_a_tie(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1.5), (2.0, 1.5, 1.5)], "y double, prediction double, rfrk double")
    assert learn.choose_model(df, df, "y").first().model == "RF"
    assert learn.choose_model(df, df.withColumn("rfrk", F.col("y")), "y").first().model == "RFRK"


def test_prediction_is_null_where_a_feature_is_missing_or_outside(spark, train):
    model = learn.fit(train, "v", ["x", "b"], n_estimators=2, max_depth=3)
    wide = spark.createDataFrame([(0, 0, 1.0, 1.0), (0, 1, None, 1.0), (1, 1, 2.0, 0.0)], "row int, col int, x double, b double")
    square = spark.sql("select array(struct(0d as x, 1d as y), struct(2d as x, 1d as y), struct(2d as x, 2d as y), struct(0d as x, 2d as y), struct(0d as x, 1d as y)) as ring")
    got = {(r.row, r.col): r.prediction for r in predict.predict_cells(model, wide, square, Grid(0.0, 2.0, 1.0, 1.0, 2, 2)).collect()}
    assert got[0, 0] is not None and got[0, 1] is None and got[1, 1] is None
    found = predict.predict_all({"good": model, "bad": learn.fit(train, "v", ["y"], n_estimators=2)}, wide)
    out, failed = found.cells, found.failed
    assert out.select("label").distinct().collect()[0][0] == "good" and "bad" in failed


def test_splits_cover_every_class(spark):
    df = spark.createDataFrame([(i, "rare" if i == 0 else "often" if i % 3 else "some") for i in range(90)], "id long, k string")
    out = prep.stratified_split(df, "k", "id")
    assert out.count() == 90
    assert {r.k: r.n for r in out.filter("is_test").groupBy("k").agg(F.count("*").alias("n")).collect()} == {"rare": 1, "often": 12, "some": 6}


def test_odd_values_are_dropped(spark):
    df = spark.createDataFrame([(1.0, "3", 1), (float("nan"), "x", 2), (float("inf"), "4", 3), (None, None, 4)], "a double, t string, id int")
    assert [r.id for r in prep.select_and_drop(prep.to_numeric(df, ["t"]), "a", ["t"], ["id"]).collect()] == [1]


def test_outlier_flags_without_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, "t"), (2, 1.0, 0.0, None, "t")], "point_id long, x double, y double, v double, s string")
    assert [r.v_Sta for r in quality.flag_outliers(df, ["v", "s"]).orderBy("point_id").collect()] == ["Normal", "Missing"]


def test_streams_give_the_batch_result(spark, tmp_path):
    cells = adapters.cells(spark, SMALL)
    scenes = adapters.scenes(spark, SMALL).limit(500)
    cells.write.parquet(f"{tmp_path}/cells")
    scenes.write.parquet(f"{tmp_path}/scenes")
    config = {"ndvi": {"nir": "b8", "red": "b4"}}

    def streamed(path, schema, f, name):
        q = f(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = streamed(f"{tmp_path}/cells", cells.schema, lambda df: rowwise.streamed_indices(df, config), "streamed_indices")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rowwise.streamed_indices(cells, config).collect()))
    got = streamed(f"{tmp_path}/scenes", scenes.schema, rowwise.clear_reflectance, "streamed_scenes")
    assert got.count() == rowwise.clear_reflectance(spark.read.parquet(f"{tmp_path}/scenes")).count()
    stats = quality.global_stats(cells, ["b1"])
    got = streamed(f"{tmp_path}/cells", cells.schema, lambda df: rowwise.flag_against(df, stats, "b1", 1.0), "streamed_flags")
    assert got.filter("b1_global").count() == quality.global_outlier(cells, "b1", 1.0).filter("b1_global").count()
    assert set(INDICES) >= {"ndvi", "evi"}


def test_training_takes_every_event_over_a_cell(spark):
    events, grid = spark.read.parquet(f"{SMALL}/events.parquet"), adapters.grid(spark, SMALL)
    x, y = (events.event_id * 7919) % 1009, 1013 - (events.event_id * 104729) % (grid.height * 50 + 13)
    cells = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    row, col = F.floor((1000 - y) / 50), F.floor(x / 50)
    placed = events.filter((row >= 0) & (row * 25 + col < cells)).count()
    assert plans.training(spark, SMALL).count() == placed
    assert plans.flagship(spark, SMALL).first()["Total"] == events.count()


def test_kriging_that_fails_falls_back_on_the_forest(spark, train):
    fitted = train.withColumn("prediction", F.col("v") + F.when(F.col("x") > 5, 0.1).otherwise(-0.1))
    out, error = krige.kriging_or_forest(fitted, fitted, "v", k=4)
    assert error is None and out.filter("kriging_variance is not null").count() == 240
    # fails in the job, not in the plan
    broken = fitted.withColumn("x", F.when(F.raise_error(F.lit("no place")).isNull(), F.col("x")))
    out, error = krige.kriging_or_forest(broken, fitted, "v", k=4)
    assert "no place" in error and out.filter("rfrk = prediction and kriging_variance is null").count() == 240


def test_a_label_that_fails_in_its_job_leaves_the_others(spark, train):
    model, other = (learn.fit(train, "v", f, n_estimators=2, max_depth=3) for f in (["x"], ["b"]))
    wide = train.select("row", "col", "x", F.when(F.raise_error(F.lit("unreadable")).isNull(), F.col("b")).alias("b"))
    found = predict.predict_all({"good": model, "bad": other}, wide)
    out, failed = found.cells, found.failed
    assert out.select("label").distinct().collect()[0][0] == "good" and "unreadable" in failed["bad"]


def test_stacked_kriging_systems_are_those_of_single_points(spark):
    random.seed(6)
    points = spark.createDataFrame([(i, random.uniform(0, 9), random.uniform(0, 9), random.uniform(0, 5)) for i in range(60)], "point_id long, x double, y double, v double")
    nugget, sill, reach = 0.3, 2.0, 5.0
    got = {r.point_id: r for r in krige.ordinary_kriging(points, points, "v", (nugget, sill, reach), k=5).collect()}
    rows = points.collect()
    for t in rows[:20]:
        near = sorted(rows, key=lambda r: ((r.x - t.x) ** 2 + (r.y - t.y) ** 2, r.point_id))[:5]
        p = np.array([(r.x, r.y) for r in near])
        a = np.ones((6, 6))
        a[:5, :5] = krige.gamma(np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)), "spherical", nugget, sill, reach)
        a[5, 5] = 0
        b = np.append(krige.gamma(np.hypot(*(p - [t.x, t.y]).T), "spherical", nugget, sill, reach), 1.0)
        w = np.linalg.solve(a, b)
        assert got[t.point_id].kriged == pytest.approx(w[:5] @ [r.v for r in near]) and got[t.point_id].variance == pytest.approx(w @ b, abs=1e-9)


@pytest.mark.parametrize("limit", [1, 7, 10_000])
def test_quantiles_against_numpy(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    random.seed(limit)
    rows = [(random.choice([0.0, -1.5, 1e9, 3.25]) if i % 3 else random.gauss(0, 5), None if i % 7 == 0 else i % 11, float("nan") if i % 2 else 2.0, None) for i in range(501)]
    df = spark.createDataFrame(rows, "a double, b int, c double, d double")
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = quantiles.quantiles(df, dict.fromkeys("abcd", shares))
    for i, c in enumerate("abc"):
        values = [r[i] for r in rows if r[i] is not None and r[i] == r[i]]
        assert got[c] == pytest.approx(np.quantile(values, shares).tolist())
    assert got["d"] == [None] * len(shares) and quantiles.medians(df.limit(0), ["a"]) == {"a": None}


def test_quantiles_with_infinite_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "LIMIT", 2)
    df = spark.createDataFrame([(float("-inf"),), (float("inf"),), (float("inf"),), (1.0,), (2.0,), (5.0,), (3.0,)], "a double")
    assert quantiles.quantiles(df, {"a": [0.0, 1 / 6, 0.5, 1.0]})["a"] == [float("-inf"), 1.0, 3.0, float("inf")]


def test_lone_points_find_their_neighbours(spark):
    """Points far from a crowd are asked of all at once."""
    random.seed(9)
    rows = [(i, random.uniform(0, 1), random.uniform(0, 1)) for i in range(150)] + [(900, 1e6, 0.0), (901, -4e5, 7e5), (902, 1e6, 1e6)]
    points = spark.createDataFrame(rows, "point_id long, x double, y double")
    key = lambda df: sorted((r.point_id, r.rank, r.neighbour) for r in df.collect())
    assert key(spatial.spatial_knn(points, 3)) == key(spatial.knn_brute_force(points, 3))


def test_codes_are_alphabetical(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "abc", "ab", "", "zeta", "a", None, "é"]], "k string")
    assert {r.k: r.code for r in prep.label_codes(df, "k").collect()} == {k: i for i, k in enumerate(sorted({"b", "a", "abc", "ab", "", "zeta", "é"}))}


def test_projection_of_known_places():
    """The meridian's quarter of the ellipsoid, and the false easting on the central meridian."""
    from pyspark.sql import SparkSession

    east, north = crs.to_crs(F.col("lon"), F.col("lat"), 4326, 4544)
    rows = SparkSession.getActiveSession().createDataFrame([(105.0, 89.9999999999), (105.0, 0.0)], "lon double, lat double").select(east, north).collect()
    assert rows[0][1] == pytest.approx(10001965.7293, abs=0.01) and rows[1][0] == pytest.approx(500000) and abs(rows[1][1]) < 1e-6


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_extra_trees_split_between_the_values(spark, criterion):
    """Every node's counts are those of the rows that reach it, thresholds lie between their values, leaves keep their least size."""
    from pyspark.ml.feature import VectorAssembler

    from gridspark.operators import extra_trees

    random.seed(5)
    rows = [(random.gauss(0, 1), random.randint(0, 3), 1.0, 0.0) for _ in range(400)]
    rows = [(a, float(b), c, float(int(a > 0.3) + int(b > 1))) for a, b, c, _ in rows]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, c double, k double").repartition(3))
    model = extra_trees.fit_extra_trees(df, "k", 3, trees=6, criterion=criterion, max_depth=8, min_samples_split=20, min_samples_leaf=4)
    x, y = np.array([r[:3] for r in rows]), np.array([int(r[3]) for r in rows])
    t = model.trees

    def walk(k, inside):
        assert (np.bincount(y[inside], minlength=3) == t.counts[k]).all() and len(inside) >= 4
        if t.feature[k] < 0:
            return
        v = x[inside, t.feature[k]]
        assert len(inside) >= 20 and v.min() <= t.threshold[k] < v.max() and t.feature[k] != 2  # a constant cannot be split
        walk(t.left[k], inside[v <= t.threshold[k]])
        walk(t.left[k] + 1, inside[v > t.threshold[k]])

    for root in range(6):
        walk(root, np.arange(len(rows)))
    assert len({t.threshold[r] for r in range(6)}) == 6  # trees differ
    predicted = model.transform(df).select("k", "prediction").collect()
    assert sum(r.k == r.prediction for r in predicted) > 0.93 * len(rows)
    one = extra_trees.fit_extra_trees(df.filter("k = 1"), "k", 3, trees=2)
    assert {r.prediction for r in one.transform(df).collect()} == {1.0}
    assert extra_trees.fit_extra_trees(df.limit(0), "k", 3, trees=2).transform(df.limit(0)).count() == 0


def test_permutation_importance_is_the_loss_of_score(spark, train):
    """The feature that the label is made of loses most; one that the model does not use loses nothing."""
    model = learn.fit(train, "v", ["x", "b"], n_estimators=3, max_depth=5)
    lost = dict(learn.permutation_importance(model, train.withColumn("unused", F.col("x") * 0), "v", ["x", "b", "unused"]))
    base = learn.score(model.transform(train), "v", "regression")
    constant = learn.score(model.transform(train.withColumn("x", F.lit(train.agg(F.avg("x")).first()[0]))), "v", "regression")
    assert lost["x"] > max(lost["b"], 0.5 * (base - constant)) and lost["unused"] == pytest.approx(0, abs=1e-12)


def test_codes_are_alphabetical_over_all_ranges(spark):
    """Values with a common beginning, in many partitions."""
    values = [f"https://host/{i * 7919 % 5000:05d}" for i in range(5000)] + ["", "a", "é", None]
    df = spark.createDataFrame([(v,) for v in values * 2], "v string").repartition(7)
    got = {r.v: r.code for r in prep.label_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=str.encode))}
    assert prep.label_codes(df.limit(0), "v").count() == 0


def test_tables_of_a_block_are_dropped_with_it(spark):
    """What a thread writes inside goes at the end of its own block; other threads' tables and later ones stay."""
    from concurrent.futures import ThreadPoolExecutor

    from gridspark.sources.scratch import dropping_tables, written

    df, there = spark.range(3), lambda t: bool(t.inputFiles()) and t.count() == 3
    before = written(df)
    with dropping_tables(spark):
        inside = written(df)
        with ThreadPoolExecutor(1) as pool:
            other = pool.submit(written, df).result()
        assert there(inside)
    assert there(before) and there(other) and there(written(df))
    with pytest.raises(Exception):
        inside.count()


def test_fits_side_by_side_take_few_partitions(spark, monkeypatch):
    """Each partition sends statistics of all open nodes: a search of many fits has a partition for 250,000 rows, not for 10,000."""
    rows = spark.range(30000).selectExpr("id as point_id", "cast(id % 97 as double) as a", "cast(id % 13 as double) as y")
    seen, real = [], learn.prepared_folds
    monkeypatch.setattr(learn, "prepared_folds", lambda *a, **k: [seen.append(f[0].rdd.getNumPartitions()) or f for f in real(*a, **k)])
    learn.search(rows, "y", ["a"], "regression", [{"n_estimators": 1, "max_depth": 1, "min_samples_split": 2, "min_samples_leaf": 1}])
    assert seen == [1, 1, 1] and learn.parts(4_000_000, learn.PER_PART_OF_MANY) == 16


def test_extra_trees_read_equal_rows_once(spark, monkeypatch):
    """Rows that agree in features and class are one row with their number; the trees are those of all rows."""
    from pyspark.ml.feature import VectorAssembler

    from gridspark.operators import extra_trees

    read, ranges = [], extra_trees._ranges
    monkeypatch.setattr(extra_trees, "_ranges", lambda rows, *a: (read.append(rows.count()), ranges(rows, *a))[1])
    few = spark.range(60).selectExpr("double(id % 7) as a", "double(id % 4) as b", "double(id % 3) as y")
    many = few.crossJoin(spark.range(20).select("id")).repartition(5)
    fitted = [extra_trees.fit_extra_trees(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(d), "y", 3, trees=2, max_depth=3).trees for d in (few, many)]
    assert max(read) <= 60
    assert fitted[0].feature == fitted[1].feature and fitted[0].threshold == fitted[1].threshold
    assert all((20 * a == b).all() for a, b in zip(fitted[0].counts, fitted[1].counts, strict=True))


def test_folds_share_one_table(spark):
    """The rows of the folds are made once, whatever plan they come from."""
    few = spark.range(50).selectExpr("id as point_id", "double(id % 7) as a", "double(id) as y")
    folds = learn.prepared_folds(few.join(spark.range(50).selectExpr("id as point_id", "double(id) as b"), "point_id"), "y", ["a", "b"], 3)
    assert not any("Join" in df._jdf.queryExecution().logical().toString() for fold in folds for df in fold)
    assert [sorted(r.point_id for df in fold for r in df.collect()) for fold in folds] == [list(range(50))] * 3
    learn.released(folds)


def test_kriging_that_fails_says_so_in_its_rows(spark, train):
    fitted = train.withColumn("prediction", F.col("v") + F.when(F.col("x") > 5, 0.1).otherwise(-0.1))
    out, _ = krige.kriging_or_forest(fitted, fitted, "v", k=4)
    assert out.filter("kriging_error is null").count() == 240
    broken = fitted.withColumn("x", F.when(F.raise_error(F.lit("no place")).isNull(), F.col("x")))
    out, error = krige.kriging_or_forest(broken, fitted, "v", k=4)
    assert out.filter(F.col("kriging_error") == error).count() == 240


@pytest.mark.parametrize("name", ["m17_regression_kriging", "m18_choose_model", "u3_kriging_uncertainty"])
def test_queries_fail_where_kriging_fails(spark, monkeypatch, name):
    """A failure in the plan or in a job is no result."""
    def broken(points, *_, **__):
        return points.select(F.raise_error(F.lit("no variogram")).cast("double").alias("distance"), F.lit(0.0).alias("gamma"), F.lit(1).alias("n"))

    monkeypatch.setattr(krige, "lag_table", broken)
    with pytest.raises(Exception, match="no variogram"):
        plans.QUERIES[name](spark, SMALL).collect()
