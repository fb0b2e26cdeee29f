"""Forests and other models, their selection, scores and reports."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product
from math import ceil

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import counted
from .extra_trees import fit_extra_trees
from .prep import bucket

DEEPEST = 30


def forest_parameters(n_estimators: int = 20, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1) -> dict[str, int]:
    """Spark's parameters; ``min_samples_split`` has none of its own and raises the least rows of a leaf to half of it."""
    return {"numTrees": n_estimators, "maxDepth": min(max_depth or DEEPEST, DEEPEST), "minInstancesPerNode": max(min_samples_leaf, ceil(min_samples_split / 2))}


def forest(task: str, label: str, **params: int | None) -> Estimator:
    """A forest for ``regression`` or ``classification`` (labels are codes from 0)."""
    kind = {"regression": RandomForestRegressor, "classification": RandomForestClassifier}[task]
    return kind(featuresCol="features", labelCol=label, seed=42, **forest_parameters(**params))


def counted_forest(n_estimators: int = 20, max_depth: int | None = None, min_samples_split: int = 2, min_samples_leaf: int = 1) -> counted.Forest:
    """A forest over counted rows."""
    return counted.Forest(n_estimators, max_depth, min_samples_split, min_samples_leaf)


#: Training rows of a partition, and of one where many fits run side by side: every partition sends its own statistics of each open node, which
#: for deep trees are far more than the rows, so fits that fill the cluster together take few partitions each.
PER_PART, PER_PART_OF_MANY = 10_000, 250_000


def parts(rows: int, per: int = PER_PART) -> int:
    """Partitions of training rows, by their number alone: ``per`` in each up to 64 of them, a million from there on."""
    return max(1, min(ceil(rows / per), max(64, ceil(rows / 1_000_000))))


def ordered(df: DataFrame, key: str, per: int = PER_PART) -> DataFrame:
    """Rows dealt and ordered by key into :func:`parts` partitions, so that a fit can be repeated on any cluster."""
    return df.repartition(parts(df.count(), per), key).sortWithinPartitions(key)


def fit(train: DataFrame, label: str, features: Sequence[str], task: str = "regression", key: str = "point_id", **params: int | None) -> PipelineModel:
    """Assembler and forest over :func:`ordered` rows."""
    rows = ordered(train, key)
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features"), forest(task, label, **params)]).fit(rows)


def fit_rf_regressor(train: DataFrame, label: str, features: Sequence[str], **params) -> PipelineModel:
    return fit(train, label, features, "regression", **params)


def fit_rf_classifier(train: DataFrame, label: str, features: Sequence[str], **params) -> PipelineModel:
    return fit(train, label, features, "classification", **params)


def score(predicted: DataFrame, label: str, task: str) -> float:
    """R2 or accuracy."""
    if task == "regression":
        return float(regression_metrics(predicted, label, "prediction").first()["R2"] or 0.0)
    return float(predicted.agg(F.avg((F.col(label) == F.col("prediction")).cast("double"))).first()[0] or 0.0)


Fold = tuple[DataFrame, DataFrame]


def prepared_folds(train: DataFrame, label: str, features: Sequence[str], folds: int, key: str = "point_id", per: int = PER_PART) -> list[Fold]:
    """Training and test rows of each fold by a hash of the key, assembled and written once, ordered and cached: every fit over them shares the work."""
    assembled = written(VectorAssembler(inputCols=list(features), outputCol="features").transform(train).select(key, label, "features"))
    folded = assembled.withColumn("_fold", bucket(F.col(key), 7, folds))
    return [(ordered(folded.filter(F.col("_fold") != i), key, per).persist(), folded.filter(F.col("_fold") == i).persist()) for i in range(folds)]


def released(folds: list[Fold]) -> None:
    for fold in folds:
        for df in fold:
            df.unpersist()


def fold_scores(folds: list[Fold], label: str, task: str, **params) -> float:
    """Mean score over the folds, which run side by side."""
    def one(fold: Fold) -> float:
        return score(forest(task, label, **params).fit(fold[0]).transform(fold[1]), label, task)

    with ThreadPoolExecutor(max_workers=min(len(folds), 4)) as pool:
        return sum(pool.map(one, folds)) / len(folds)


def cross_validate(train: DataFrame, label: str, features: Sequence[str], task: str, folds: int = 5, key: str = "point_id", **params) -> float:
    """Mean score over folds by a hash of the key."""
    prepared = prepared_folds(train, label, features, folds, key)
    found = fold_scores(prepared, label, task, **params)
    released(prepared)
    return found


#: Fits that are submitted side by side; Spark's scheduler deals their tasks to whatever cores there are.
SIDE_BY_SIDE = 16


def selection_score(predicted: DataFrame, label: str, task: str) -> float:
    """What elimination chooses by: the negative root of the mean squared error, or accuracy."""
    if task == "regression":
        return -float(regression_metrics(predicted, label, "prediction").first()["RMSE"] or 0.0)
    return score(predicted, label, task)


def eliminated(train: DataFrame, label: str, names: Sequence[str], always: int, task: str, test: DataFrame | None = None, stop: int = 1, **params) -> tuple[list[str], dict[int, float]]:
    """The ``stop`` features left when the least important goes each time, and the score on ``test`` by number of features.

    ``train`` and ``test`` have ``features`` assembled of ``names`` and ``always`` more, which take part in every fit and are never
    eliminated.  Importance is that of a fit over ``train`` alone, the first by name goes of several.
    """
    left, scores = list(range(len(names))), {}
    while True:
        chosen = [*left, *range(len(names), len(names) + always)]
        slicer = VectorSlicer(inputCol="features", outputCol="_chosen", indices=chosen)
        model = forest(task, label, **params).setFeaturesCol("_chosen").fit(slicer.transform(train))
        if test is not None:
            scores[len(left)] = selection_score(model.transform(slicer.transform(test)), label, task)
        if len(left) <= stop:
            return [names[i] for i in left], scores
        importance = model.featureImportances.toArray()
        left.remove(min(left, key=lambda i: (importance[left.index(i)], names[i])))  # noqa: B023


def rfecv(train: DataFrame, label: str, features: Sequence[str], task: str = "regression", always: Sequence[str] = (), folds: int = 5, **params) -> tuple[list[str], list[tuple[int, float]]]:
    """Features by recursive elimination with cross-validation, and the mean score of each number of features.

    Each fold eliminates on its own training rows, so no test row has a say in the features that it judges; folds run
    side by side over rows assembled once.  The number with the best mean score wins, the least of several, and an
    elimination over all rows says which features these are.  Scores are negative RMSE or accuracy.  ``always`` (coordinates)
    takes part in every fit and is never eliminated.

    For regression over more than ``PER_PART`` rows the forests grow over counted rows (:mod:`.counted`), all eliminations side by side; else, and for
    rows that make more groups than a task may hold, Spark's own forests are fitted over the rows.
    """
    names = list(features)
    best = lambda history: min(history, key=lambda h: (-h[1], h[0]))[0]
    if task == "regression" and train.count() > PER_PART:
        rows = counted.binned(train, label, [*names, *always], folds)
        if rows.groups <= counted.GROUPS_MOST:
            order, found = counted.eliminations(rows, names, counted_forest(**params))
            history = [(n, sum(f[n] for f in found) / folds) for n in range(len(names), 0, -1)]
            return [name for name in names if name in order[-best(history):]], history
    prepared = prepared_folds(train, label, [*names, *always], folds)
    with ThreadPoolExecutor(max_workers=min(folds, SIDE_BY_SIDE)) as pool:
        found = [f.result()[1] for f in [pool.submit(eliminated, a, label, names, len(always), task, b, **params) for a, b in prepared]]
    released(prepared)
    history = [(n, sum(f[n] for f in found) / folds) for n in range(len(names), 0, -1)]
    n = best(history)
    whole = ordered(VectorAssembler(inputCols=[*names, *always], outputCol="features").transform(train).select("point_id", label, "features"), "point_id").persist()
    chosen, _ = eliminated(whole, label, names, len(always), task, stop=n, **params)
    whole.unpersist()
    return chosen, history


def search(train: DataFrame, label: str, features: Sequence[str], task: str, grid: Sequence[Mapping[str, int | None]], folds: int = 3) -> tuple[dict, float]:
    """The combination with the best mean score, the first of several.

    Combinations that cannot be told apart run once.  A search for regression grows all its forests over counted rows (:mod:`.counted`).
    Spark's own forests are fitted over the rows, ``SIDE_BY_SIDE`` at a time, the largest first, for classes, for rows that make more groups
    than a task may hold, and where they are so few that one round of fits over one partition does it.
    """
    known = [tuple(sorted(forest_parameters(**params).items())) for params in grid]
    if task == "regression" and (len(set(known)) * folds > SIDE_BY_SIDE or train.count() > PER_PART_OF_MANY):
        rows = counted.binned(train, label, features, folds)
        if rows.groups <= counted.GROUPS_MOST:
            forests = [counted_forest(**p) for p in grid]
            different = list(dict.fromkeys(forests))
            tried = dict(zip(different, counted.scores(rows, different), strict=True))
            best = max(range(len(grid)), key=lambda i: (tried[forests[i]], -i))
            return dict(grid[best]), tried[forests[best]]
    prepared = prepared_folds(train, label, features, folds, per=PER_PART_OF_MANY)
    first = {k: params for k, params in reversed(list(zip(known, grid, strict=True)))}
    largest = sorted(first, key=lambda k: (-dict(k)["numTrees"], -dict(k)["maxDepth"]))

    def one(params: Mapping[str, int | None], fold: Fold) -> float:
        return score(forest(task, label, **params).fit(fold[0]).transform(fold[1]), label, task)

    with ThreadPoolExecutor(max_workers=SIDE_BY_SIDE) as pool:
        running = {k: [pool.submit(one, first[k], fold) for fold in prepared] for k in largest}
        tried = {k: sum(f.result() for f in fits) / folds for k, fits in running.items()}
    released(prepared)
    best = max(range(len(grid)), key=lambda i: (tried[known[i]], -i))
    return dict(grid[best]), tried[known[best]]


def random_search(train: DataFrame, label: str, features: Sequence[str], task: str, space: Mapping[str, Sequence], n: int = 50, folds: int = 3, seed: int = 42) -> tuple[dict, float]:
    """Search over ``n`` combinations drawn from the space."""
    every = [dict(zip(space, values, strict=True)) for values in product(*space.values())]
    return search(train, label, features, task, random.Random(seed).sample(every, min(n, len(every))), folds)


def refine_grid(best: Mapping[str, int | None]) -> list[dict[str, int | None]]:
    """Three values of each parameter around the best."""
    trees, split, leaf, depth = best["n_estimators"], best["min_samples_split"], best["min_samples_leaf"], best["max_depth"]
    axes = {
        "n_estimators": sorted({min(1000, max(10, trees + d)) for d in (-50, 0, 50)}),
        "min_samples_split": sorted({max(2, split + d) for d in (-2, 0, 2)}),
        "min_samples_leaf": sorted({max(1, leaf + d) for d in (-1, 0, 1)}),
        "max_depth": [None, 10, 20] if depth is None else sorted({max(1, depth + d) for d in (-5, 0, 5)}),
    }
    return [dict(zip(axes, values, strict=True)) for values in product(*axes.values())]


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """``R2, MAE, MSE, RMSE`` in one aggregate."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    rows = df.filter(y.isNotNull() & p.isNotNull())
    out = rows.groupBy(*by).agg(F.avg(e * e).alias("MSE"), F.avg(F.abs(e)).alias("MAE"), F.var_pop(y).alias("_v"))
    return out.select(*by, (1 - F.try_divide("MSE", "_v")).alias("R2"), "MAE", "MSE", F.sqrt("MSE").alias("RMSE"))


def validation_r2(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Squared correlation of actual and predicted, and the range of both: ``r2, low, high``."""
    return df.agg(F.pow(F.corr(label, prediction), F.lit(2.0)).alias("r2"), F.least(F.min(label), F.min(prediction)).alias("low"),
                  F.greatest(F.max(label), F.max(prediction)).alias("high"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``accuracy`` and support-weighted ``precision, recall, f1``; a class that is never predicted has precision 0."""
    counts = confusion(df, label, prediction)
    hits = counts.filter("y = p").select(F.col("y").alias("c"), F.col("n").alias("hit"))
    support = counts.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    guessed = counts.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("guessed"))
    each = support.join(hits, "c", "left").join(guessed, "c", "left").fillna(0, subset=["hit", "guessed"])
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("guessed")), F.lit(0.0))
    recall = F.col("hit") / F.col("support")
    each = each.withColumns({"pr": precision, "re": recall})
    each = each.withColumn("f", F.coalesce(F.try_divide(2 * F.col("pr") * F.col("re"), F.col("pr") + F.col("re")), F.lit(0.0)))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return each.agg((F.sum("hit") / F.sum("support")).alias("accuracy"), weighted("pr").alias("precision"), weighted("re").alias("recall"), weighted("f").alias("f1"))


def confusion_matrix(df: DataFrame, label: str, prediction: str, classes: Sequence) -> DataFrame:
    """One row per true class, one column ``p_<class>`` per predicted class, 0 where none."""
    wide = confusion(df, label, prediction).groupBy("y").pivot("p", list(classes)).agg(F.first("n")).fillna(0)
    return wide.select(F.col("y").alias(label), *(F.col(f"`{c}`").alias(f"p_{c}") for c in classes))


def feature_importance(models: Mapping[str, PipelineModel]) -> list[tuple[str, str, float]]:
    """(feature, label, importance) rows of the stored forests; names from each model's own assembler."""
    return [(name, label, float(v)) for label, m in models.items()
            for name, v in zip(m.stages[0].getInputCols(), m.stages[-1].featureImportances.toArray(), strict=True)]


def feature_matrix(rows: DataFrame, labels: Sequence[str], value: str = "importance") -> DataFrame:
    """Feature by label, 0 where a feature is not of a model."""
    return rows.groupBy("feature").pivot("label", list(labels)).agg(F.first(value)).fillna(0).orderBy("feature")


def selected_feature_matrix(selected: DataFrame, labels: Sequence[str]) -> DataFrame:
    """0/1 matrix of ``selected(label, feature)``."""
    return selected.groupBy("feature").pivot("label", list(labels)).agg(F.lit(1)).fillna(0)


def performance_table(metrics: DataFrame, models: Sequence[str] = ("RF", "RFRK"), names: Sequence[str] = ("R2", "MAE", "MSE", "RMSE")) -> DataFrame:
    """One row per label with ``<model>_<metric>`` from ``metrics(label, model, metric, value)``."""
    columns = [f"{m}_{n}" for m in models for n in names]
    return metrics.withColumn("_c", F.concat_ws("_", "model", "metric")).groupBy("label").pivot("_c", columns).agg(F.first("value"))


def hyperparameter_table(params: Mapping[str, Mapping[str, int | None]]) -> list[tuple[str, str, int | None]]:
    """(label, parameter, value) rows of the chosen parameters."""
    return [(label, name, value) for label, chosen in sorted(params.items()) for name, value in sorted(chosen.items())]


def performance_long(metrics: DataFrame, models: Sequence[str] = ("RF", "RFRK")) -> DataFrame:
    """``label, metric`` and one column per model."""
    return metrics.groupBy("label", "metric").pivot("model", list(models)).agg(F.first("value"))


def performance_report(table: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The performance table turned over: metrics as rows, labels as columns, rounded to two digits."""
    names = [c for c in table.columns if c != "label"]
    return table.unpivot(["label"], names, "metric", "value").groupBy("metric").pivot("label", list(labels)).agg(F.round(F.first("value"), 2))


def choose_model(rf: DataFrame, rfrk: DataFrame, label: str, rf_prediction: str = "prediction", rfrk_prediction: str = "rfrk") -> DataFrame:
    """``model, R2`` of the better one on the hold-out rows; the forest wins ties."""
    both = regression_metrics(rf, label, rf_prediction).select(F.lit("RF").alias("model"), "R2").union(
        regression_metrics(rfrk, label, rfrk_prediction).select(F.lit("RFRK").alias("model"), "R2"))
    return both.agg(F.max_by("model", F.struct(F.coalesce("R2", F.lit(float("-inf"))), (F.col("model") == "RF"))).alias("model"), F.max("R2").alias("R2"))


def leaderboard(train: DataFrame, test: DataFrame, label: str, features: Sequence[str], n_classes: int, key: str = "point_id") -> list[tuple[str, float, float]]:
    """(model, test score, train score) by weighted F1, best first."""
    kinds = {
        "RandomForestGini": RandomForestClassifier(labelCol=label, impurity="gini", numTrees=20, seed=42),
        "RandomForestEntr": RandomForestClassifier(labelCol=label, impurity="entropy", numTrees=20, seed=42),
        "DecisionTree": DecisionTreeClassifier(labelCol=label, seed=42),
        "LogisticRegression": LogisticRegression(labelCol=label, maxIter=30),
        "NeuralNet": MultilayerPerceptronClassifier(labelCol=label, layers=[len(features), 16, n_classes], maxIter=60, seed=42),
    }
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    a, b = (assembler.transform(ordered(df, key)).persist() for df in (train, test))
    f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="f1", weightCol="_n")
    # rows that agree in features and class are judged once, with their number
    judged = [assembler.transform(df.groupBy(*features, label).agg(F.count("*").cast("double").alias("_n"))).persist() for df in (a, b)]
    rows = []
    models = {name: kind.fit(a) for name, kind in kinds.items()}
    models |= {f"ExtraTrees{n}": fit_extra_trees(a, label, n_classes, criterion=c) for n, c in (("Gini", "gini"), ("Entr", "entropy"))}
    for name, model in models.items():
        rows.append((name, *(float(f1.evaluate(model.transform(df))) for df in reversed(judged))))
    for df in (a, b, *judged):
        df.unpersist()
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def permutation_importance(model: PipelineModel, test: DataFrame, label: str, features: Sequence[str], task: str = "regression", key: str = "point_id") -> list[tuple[str, float]]:
    """(feature, score lost when the feature's values change places), the values dealt by a hash of the key."""
    rows = test.persist()
    base = score(model.transform(rows), label, task)
    # a permutation without a global sort: in each of many hash buckets the values move to the row of the next hash
    n = max(1, rows.count() // 4096)
    out = []
    for i, f in enumerate(features):
        place = rows.withColumn("_b", bucket(F.col(key), 100 + i, n))
        by_hash = F.row_number().over(W.partitionBy("_b").orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{i}"))), key))
        by_key = F.row_number().over(W.partitionBy("_b").orderBy(key))
        moved = place.select("_b", by_hash.alias("_p"), F.col(f).alias("_moved"))
        shuffled = place.withColumn("_p", by_key).join(moved, ["_b", "_p"]).drop(f, "_b", "_p").withColumnRenamed("_moved", f)
        out.append((f, base - score(model.transform(shuffled), label, task)))
    rows.unpersist()
    return out


def explain_tree(df: DataFrame, label: str, features: Sequence[str], task: str = "regression", max_depth: int = 3, min_leaf: int = 5) -> list[tuple[int, int, str, int, float]]:
    """(node, depth, rule, rows, prediction) of a shallow tree, node by node."""
    kind = {"regression": DecisionTreeRegressor, "classification": DecisionTreeClassifier}[task]
    rows = VectorAssembler(inputCols=list(features), outputCol="features").transform(df)
    model = kind(labelCol=label, maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=42).fit(rows)
    out: list[tuple[int, int, str, int, float]] = []

    def walk(node, depth: int, rule: str) -> None:
        out.append((len(out), depth, rule, int(node.impurityStats().count()), float(node.prediction())))
        if node.subtreeDepth():
            name, bound = features[node.split().featureIndex()], node.split().threshold()
            walk(node.leftChild(), depth + 1, f"{name} <= {bound:.6g}")
            walk(node.rightChild(), depth + 1, f"{name} > {bound:.6g}")

    walk(model._java_obj.rootNode(), 0, "all")
    return out


def tree_uncertainty(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and ``uncertainty``: mean and population deviation of the predictions of a forest regressor's trees."""
    assembler, trees = model.stages[0], model.stages[-1].trees
    placed = assembler.transform(df)
    for i, tree in enumerate(trees):
        tree.setFeaturesCol(assembler.getOutputCol()).setPredictionCol(f"_tree_{i}")
        placed = tree.transform(placed)
    each = F.array(*(F.col(f"_tree_{i}") for i in range(len(trees))))
    with_trees = placed.withColumn("_each", each)
    mean = F.aggregate("_each", F.lit(0.0), lambda s, v: s + v) / len(trees)
    with_mean = with_trees.withColumn("prediction", mean)
    square = F.aggregate("_each", F.lit(0.0), lambda s, v: s + (v - F.col("prediction")) * (v - F.col("prediction"))) / len(trees)
    return with_mean.withColumn("uncertainty", F.sqrt(square)).select(*df.columns, "prediction", "uncertainty")
