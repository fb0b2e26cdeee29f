"""Sources and sinks: point tables, cell layers, stored models."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import missing


def read_points(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A point table from CSV with a header, under an explicit schema; NaN becomes NULL."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    numbers = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(missing(F.col(c)).alias(c) if c in numbers else F.col(c) for c in df.columns))


def read_layers(spark: SparkSession, path: str, names: Iterable[str] | None = None) -> DataFrame:
    """Long cells from a folder of layers. Only the partitions of the layers named are read."""
    df = spark.read.parquet(path)
    df = df.select(F.col("layer").cast("string").alias("layer"), "row", "col", missing(F.col("value")).alias("value"))
    return df if names is None else df.filter(F.col("layer").isin(list(names)))


def write_cells(cells: DataFrame, path: str, name: str | None = None) -> None:
    """Write long cells by layer, overwriting the layers that occur. An array of values becomes ``name_1``, ``name_2``, ..."""
    if isinstance(cells.schema["value"].dataType, T.ArrayType):
        base = F.col("layer") if name is None else F.lit(name)
        cells = cells.select(base.alias("_base"), "row", "col", F.posexplode("value").alias("_i", "value")).select(
            F.concat("_base", F.lit("_"), F.col("_i") + 1).alias("layer"), "row", "col", "value")
    elif name is not None:
        cells = cells.withColumn("layer", F.lit(name))
    (cells.write.partitionBy("layer").mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("compression", "zstd").parquet(path))


def layers_wide(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """``row, col`` and one column per layer, in the order given."""
    return cells.filter(F.col("layer").isin(list(names))).groupBy("row", "col").pivot("layer", list(names)).agg(F.first("value", ignorenulls=True))


def require_layers(cells: DataFrame, names: Sequence[str]) -> None:
    """Raise if a layer that is asked for does not occur at all."""
    there = {r[0] for r in cells.select("layer").filter(F.col("layer").isin(list(names))).distinct().collect()}
    if absent := [n for n in names if n not in there]:
        raise ValueError(f"missing layers: {', '.join(absent)}")


def layers_long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """``layer, row, col, value`` from wide cells."""
    doubles = wide.select("row", "col", *(F.col(n).cast("double").alias(n) for n in names))
    return doubles.unpivot(["row", "col"], list(names), "layer", "value").select("layer", "row", "col", "value")


def shortest(value: Column) -> Column:
    """A number with ten significant digits and no trailing zeros; NULL stays NULL."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.10g", value), r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")


def csv_columns(df: DataFrame) -> DataFrame:
    """All columns as text for a CSV sink: floating numbers shortened, large integers whole, NULL kept."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(F.col(c).isNotNull(), shortest(F.col(c).cast("double"))).alias(c) if c in floats else F.col(c).cast("string").alias(c)
                       for c in df.columns))


def write_points_csv(df: DataFrame, path: str) -> None:
    csv_columns(df).write.mode("overwrite").option("header", True).csv(path)


def stringify(df: DataFrame, keep: Sequence[str] = ("ring",)) -> DataFrame:
    """Every column but the geometry as text."""
    return df.select(*(F.col(c) if c in keep else F.col(c).cast("string").alias(c) for c in df.columns))


def points_from_xy(df: DataFrame, lon: str, lat: str) -> DataFrame:
    """Add the geometry ``x, y`` from two columns and keep the attributes; rows without either are dropped."""
    number = {c: F.expr(f"try_cast(`{c}` as double)") for c in (lon, lat)}
    return df.withColumns({"x": number[lon], "y": number[lat]}).filter("x is not null and y is not null")


def save_model(model: PipelineModel, features: Sequence[str], path: str, **notes: object) -> None:
    """The fitted pipeline and a row of metadata: feature names in the model's order, and whatever else is given."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{path}/model")
    meta = json.dumps({"feature_names": list(features), "n_features": len(features), **notes})
    spark.createDataFrame([(meta,)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The pipeline and its metadata; raises if a key is missing or the names do not fit the assembler's."""
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if missing_keys := {"feature_names", "n_features"} - meta.keys():
        raise ValueError(f"model file without {', '.join(sorted(missing_keys))}")
    inputs = next((list(s.getInputCols()) for s in model.stages if hasattr(s, "getInputCols") and s.__class__.__name__ == "VectorAssembler"), None)
    meta["feature_names"] = inputs or meta["feature_names"][:meta["n_features"]]
    return model, meta


def pending_tiles(tiles: DataFrame, done: DataFrame, key: str = "tile_id") -> DataFrame:
    """Tiles without a result yet."""
    return tiles.join(done.select(key).distinct(), key, "left_anti")
