"""Prediction of cells, statistics of layers, classes by quantile and decoding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import cached_property, reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..model import Grid
from ..sources.scratch import written
from .grid import study_area_mask
from .learn import tree_uncertainty

SHARES = (0.2, 0.4, 0.6, 0.8)


def available_features(wide: DataFrame, wanted: Sequence[str], allow_missing: bool = False) -> list[str]:
    """The features that the table has, in the model's order; raises if some are absent, unless allowed."""
    absent = [f for f in wanted if f not in wide.columns]
    if absent and not allow_missing:
        raise ValueError(f"missing features: {', '.join(absent)}")
    return [f for f in wanted if f not in absent]


def predict_cells(model: PipelineModel, wide: DataFrame, mask: DataFrame | None = None, grid: Grid | None = None, all_touched: bool = False,
                  name: str = "prediction") -> DataFrame:
    """``row, col`` of every cell and its prediction; NULL outside the mask's polygons and where a feature is missing."""
    features = available_features(wide, model.stages[0].getInputCols())
    inside = wide.select("row", "col", *features)
    if mask is not None:
        inside = study_area_mask(inside, mask, grid, all_touched)
    predicted = model.transform(inside.dropna(subset=features)).select("row", "col", F.col("prediction").alias(name))
    return wide.select("row", "col").join(predicted, ["row", "col"], "left")


def predict_with_uncertainty(model: PipelineModel, wide: DataFrame, mask: DataFrame | None = None, grid: Grid | None = None) -> DataFrame:
    """``row, col, prediction, uncertainty`` of every cell, from the trees of the forest."""
    features = available_features(wide, model.stages[0].getInputCols())
    inside = wide.select("row", "col", *features).dropna(subset=features)
    if mask is not None:
        inside = study_area_mask(inside, mask, grid)
    found = tree_uncertainty(model, inside).select("row", "col", "prediction", "uncertainty")
    return wide.select("row", "col").join(found, ["row", "col"], "left")


def kriging_uncertainty(df: DataFrame, variance: str = "kriging_variance", trees: str = "uncertainty") -> DataFrame:
    """Add ``final_uncertainty``: the kriging deviation where there is one, else that of the trees."""
    return df.withColumn("final_uncertainty", F.coalesce(F.sqrt(variance), F.col(trees)))


#: Shares of the statistics of a layer by name.
STATISTICS = {"median": 0.5, "q25": 0.25, "q75": 0.75} | {f"d{i}": i / 10 for i in range(1, 10)}


def layers_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per column, ``layer``: min, max, mean, median, population deviation, quartiles and deciles of the valid cells, of all columns at once."""
    found = quantiles(df, {c: list(STATISTICS.values()) for c in columns})
    moments = df.agg(*(f(f"`{c}`").alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_pop))))
    rows = []
    for i, c in enumerate(columns):
        exact = {n: F.lit(q).cast("double").alias(n) for n, q in zip(STATISTICS, found[c], strict=True)}
        basic = {n: F.col(f"{n}_{i}").cast("double").alias(n) for n in ("min", "max", "mean", "std")}
        rows.append(F.struct(F.lit(c).alias("layer"), basic["min"], basic["max"], basic["mean"], exact["median"], basic["std"], *(exact[n] for n in exact if n != "median")))
    return moments.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def layer_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: the statistics of one layer, see :func:`layers_statistics`."""
    return layers_statistics(df, [column]).drop("layer")


def quantile_classes(df: DataFrame, column: str, shares: Sequence[float] = SHARES) -> DataFrame:
    """Add ``class``: how many of the cut points are not above the value, from 0; NULL stays NULL."""
    cuts = quantiles(df, {column: shares})[column]
    level = sum(((F.col(column) >= F.lit(q)).cast("int") for q in cuts if q is not None), F.lit(0))
    return df.withColumn("class", F.when(F.col(column).isNotNull(), level))


def quantile_legend(df: DataFrame, column: str, shares: Sequence[float] = SHARES, names: Sequence[str] = ("very low", "low", "medium", "high", "very high")) -> DataFrame:
    """``class, label, lower, upper``."""
    edges = quantiles(df, {column: [0.0, *shares, 1.0]})[column]
    rows = [(i, name, low, high) for i, (name, low, high) in enumerate(zip(names, edges, edges[1:], strict=False))]
    return df.sparkSession.createDataFrame(rows, "class int, label string, lower double, upper double")


class Predicted:
    """What :func:`predict_all` gives, each table made when it is asked for; without any label that works they are None."""

    def __init__(self, tables: Sequence[tuple[list[str], DataFrame]], shares: Sequence[float], names: Sequence[str], failed: dict[str, str]) -> None:
        self._tables, self._shares, self._names, self.failed = tables, shares, names, failed

    @cached_property
    def _edges(self) -> list[dict[str, list[float | None]]]:
        return [quantiles(table, {f"uncertainty_{i}": [0.0, *self._shares, 1.0] for i in range(len(labels))}) for labels, table in self._tables]

    @cached_property
    def cells(self) -> DataFrame | None:
        return self._all(_cells(labels, table, edges) for (labels, table), edges in zip(self._tables, self._edges, strict=True))

    @cached_property
    def statistics(self) -> DataFrame | None:
        return self._all(_statistics(labels, table) for labels, table in self._tables)

    @cached_property
    def legend(self) -> DataFrame | None:
        return self._all(_legend(labels, table, edges, self._names) for (labels, table), edges in zip(self._tables, self._edges, strict=True))

    @staticmethod
    def _all(parts: Iterable[DataFrame]) -> DataFrame | None:
        return reduce(lambda a, b: a.union(b) if a is not None else b, parts, None)


def _together(models: Mapping[str, PipelineModel], inside: DataFrame) -> DataFrame:
    """``row, col, prediction_<i>, uncertainty_<i>`` of several models in one pass over the cells; NULL where a model lacks a feature."""
    out = inside
    for i, model in enumerate(models.values()):
        features = model.stages[0].getInputCols()
        keeping = PipelineModel([model.stages[0].copy({model.stages[0].handleInvalid: "keep"}), *model.stages[1:]])
        there = reduce(lambda a, b: a & b, (F.col(f"`{f}`").isNotNull() for f in features), F.lit(True))
        found = tree_uncertainty(keeping, out)
        out = found.select(*out.columns, *(F.when(there, F.col(c)).alias(f"{c}_{i}") for c in ("prediction", "uncertainty")))
    return out.select("row", "col", *(f"{c}_{i}" for i in range(len(models)) for c in ("prediction", "uncertainty")))


def predict_all(models: Mapping[str, PipelineModel], wide: DataFrame, mask: DataFrame | None = None, grid: Grid | None = None,
                shares: Sequence[float] = SHARES, names: Sequence[str] = ("very low", "low", "medium", "high", "very high")) -> Predicted:
    """Every model over the same cells, which are masked and read once for all of them.

    ``cells``: ``label, row, col, prediction, uncertainty, class``; ``uncertainty`` is that of the forest's trees and ``class`` its
    quantile class.  ``statistics``: a row per ``label`` and ``layer`` (prediction and uncertainty).  ``legend``: ``label, class, name, lower,
    upper``.  ``failed`` tells what went wrong with the labels that are left out: those that lack a feature before anything
    is computed; where the pass over all fails at run time, each label is computed for itself and the ones that fail are named.
    """
    failed: dict[str, str] = {}

    def attempt(some: Mapping[str, PipelineModel]) -> DataFrame:
        needed = sorted({f for m in some.values() for f in m.stages[0].getInputCols()})
        inside = wide.select("row", "col", *(f"`{f}`" for f in needed))
        if mask is not None:
            inside = study_area_mask(inside, mask, grid)
        return written(wide.select("row", "col").join(_together(some, inside), ["row", "col"], "left"))

    able = {}
    for label, model in models.items():
        try:
            available_features(wide, model.stages[0].getInputCols())
            able[label] = model
        except ValueError as error:
            failed[label] = f"{type(error).__name__}: {error}"
    errors = (ValueError, PySparkException, Py4JJavaError)
    tables: list[tuple[list[str], DataFrame]] = []
    try:
        tables = [(list(able), attempt(able))] if able else []
    except errors:
        for label, model in able.items():
            try:
                tables.append(([label], attempt({label: model})))
            except errors as error:
                failed[label] = f"{type(error).__name__}: {error}"
    return Predicted(tables, shares, names, failed)


def _cells(labels: Sequence[str], table: DataFrame, edges: Mapping[str, Sequence[float | None]]) -> DataFrame:
    """The cells of the labels of one table with their classes."""
    rows = []
    for i, label in enumerate(labels):
        u = F.col(f"uncertainty_{i}")
        level = sum(((u >= F.lit(q)).cast("int") for q in edges[f"uncertainty_{i}"][1:-1] if q is not None), F.lit(0))
        rows.append(F.struct(F.lit(label).alias("label"), F.col(f"prediction_{i}").alias("prediction"), u.alias("uncertainty"), F.when(u.isNotNull(), level).alias("class")))
    return table.select("row", "col", F.explode(F.array(*rows)).alias("r")).select("r.label", "row", "col", "r.prediction", "r.uncertainty", "r.class")


def _statistics(labels: Sequence[str], table: DataFrame) -> DataFrame:
    """Statistics of the labels of one table; the quantiles of all of them are searched together."""
    layers = layers_statistics(table, [f"{c}_{i}" for i in range(len(labels)) for c in ("prediction", "uncertainty")])
    label = F.element_at(F.array(*(F.lit(x) for x in labels)), F.substring_index("layer", "_", -1).cast("int") + 1)
    return layers.select(label.alias("label"), F.substring_index("layer", "_", 1).alias("layer"), *(c for c in layers.columns if c != "layer"))


def _legend(labels: Sequence[str], table: DataFrame, edges: Mapping[str, Sequence[float | None]], names: Sequence[str]) -> DataFrame:
    """What the classes of the labels of one table mean."""
    rows = [(label, k, name, low, high) for i, label in enumerate(labels)
            for k, (name, low, high) in enumerate(zip(names, edges[f"uncertainty_{i}"], edges[f"uncertainty_{i}"][1:], strict=False))]
    return table.sparkSession.createDataFrame(rows, "label string, class int, name string, lower double, upper double")


def decode_label(df: DataFrame, codes: DataFrame, column: str = "prediction", label: str = "label") -> DataFrame:
    """Add ``class_name`` for a rounded code; NULL and unknown codes are ``Unknown``. ``codes(label, code)`` has one row per class."""
    names = codes.select(F.col("code").alias("_code"), F.col(label).alias("_name"))
    joined = df.join(names, F.round(F.col(column)).cast("int") == F.col("_code"), "left")  # Spark broadcasts few classes, and not many
    return joined.withColumn("class_name", F.coalesce("_name", F.lit("Unknown"))).drop("_code", "_name")
