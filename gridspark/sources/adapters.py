"""Points, cells, scenes, polygons and grids in the shape of the operators' inputs, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Grid

BANDS = [f"b{i}" for i in range(1, 13)]
#: Columns and cell size of the grid of the cells adapter; its rows follow from the number of embeddings.
WIDTH, CELL = 25, 50.0
#: Polygons stand in fields of this side, five in a row.
FIELD = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_heights: dict[tuple[str, str], int] = {}


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid of :func:`cells`, looked up once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _heights:
        _heights[key] = (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) // WIDTH + 1
    return _heights[key]


def grid(spark: SparkSession, sf_dir: str) -> Grid:
    """The grid of :func:`cells`: its upper left corner is (0, 1000)."""
    return Grid(0.0, 1000.0, CELL, CELL, WIDTH, height(spark, sf_dir), 4544)


def finer_grid(spark: SparkSession, sf_dir: str) -> Grid:
    """Cells of 30 that cover the columns of :func:`grid` and begin a row lower, down to its last row."""
    return Grid(-40.0, 950.0, 30.0, 30.0, 45, int(height(spark, sf_dir) * CELL // 30) + 7, 4544)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a reading over the whole grid: ``point_id, x, y, kind, l1, l2, l3``; some lie just outside."""
    reach = height(spark, sf_dir) * int(CELL) + 13
    return table(spark, sf_dir, "events").selectExpr(
        "event_id as point_id", "cast((event_id * 7919) % 1009 as double) as x", f"cast(1013 - (event_id * 104729) % {reach} as double) as y",
        "event_type as kind", "value as l1", "value * (event_id % 7 + 1) as l2",
        "case when event_id % 50 = 0 then null else value + event_id % 11 end as l3")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide cells ``row, col, b1..b12, gap, cls``, 25 columns wide."""
    bands = [f"cast(embedding[{i}] as double) * 1000 as {b}" for i, b in enumerate(BANDS)]
    return table(spark, sf_dir, "embeddings").selectExpr(
        "cast(vec_id div 25 as int) as row", "cast(vec_id % 25 as int) as col", *bands,
        "case when vec_id % 17 = 0 then null else cast(embedding[12] as double) end as gap", "label as cls")


def long_cells(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    from .tables import layers_long

    return layers_long(cells(spark, sf_dir), names or BANDS)


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scene_id, sensed_on, cloud_pct, row, col, band, value, qa60``."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as scene_id", "cast(l_shipdate as date) as sensed_on", "l_suppkey % 40 as cloud_pct", "l_partkey % 400 as cell_id",
        "concat('B', cast(l_linenumber as varchar(9))) as band", "l_extendedprice as value",
        "case l_returnflag when 'R' then 1024 when 'A' then 2048 else 0 end as qa60")


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle for each supplier, ``poly_id, name, minx, maxx, miny, maxy, ring``, in fields over the grid and one row of fields below it."""
    rows = height(spark, sf_dir) * int(CELL) // FIELD + 1
    left, top = f"(s_suppkey % 5) * {FIELD}", f"1000 - (s_suppkey div 5) % {rows} * {FIELD}"
    boxes = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey as poly_id", "s_name as name", f"cast({left} + 13 as double) as minx", f"cast({left} + 183 - s_suppkey % 3 as double) as maxx",
        f"cast({top} - 193 as double) as miny", f"cast({top} - 33 - s_suppkey % 3 as double) as maxy")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return boxes.withColumn("ring", F.array(corner("minx", "miny"), corner("maxx", "miny"), corner("maxx", "maxy"),
                                            corner("minx", "maxy"), corner("minx", "miny")))


def holed_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The polygons without their middle third, and with a second part below for even suppliers: ``rings`` in place of ``ring``."""
    boxes = polygons(spark, sf_dir).drop("ring").withColumns({"wide": F.expr("(maxx - minx) / 3"), "high": F.expr("(maxy - miny) / 3")})

    def box(minx: str, maxx: str, miny: str, maxy: str) -> Column:
        corner = lambda x, y: F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))
        return F.array(corner(minx, miny), corner(maxx, miny), corner(maxx, maxy), corner(minx, maxy), corner(minx, miny))

    outer, hole = box("minx", "maxx", "miny", "maxy"), box("minx + wide", "maxx - wide", "miny + high", "maxy - high")
    part = box("minx", "maxx", "miny - 400", "miny - 300")
    return boxes.withColumn("rings", F.when(F.col("poly_id") % 2 == 0, F.array(part, hole, outer)).otherwise(F.array(outer, hole))).drop("wide", "high")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layer's grid for each supplier, some with another cell size or projection."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_name as layer", "25 as width", "20 as height", "case when s_nationkey % 5 = 3 then 30 else 50 end as px",
        "case when s_suppkey % 9 = 4 then 4545 else 4544 end as epsg")


#: The same as DuckDB common table expressions, by name.
SQL = {
    "points": """height as (select max(vec_id) // 25 + 1 as h from embeddings),
points as (select event_id as point_id, cast((event_id * 7919) % 1009 as double) as x,
 cast(1013 - (event_id * 104729) % (h * 50 + 13) as double) as y, event_type as kind, value as l1, value * (event_id % 7 + 1) as l2,
 case when event_id % 50 = 0 then null else value + event_id % 11 end as l3 from events, height)""",
    "cells": f"""cells as (select cast(vec_id // 25 as int) as "row", cast(vec_id % 25 as int) as col,
 {', '.join(f'cast(embedding[{i + 1}] as double) * 1000 as {b}' for i, b in enumerate(BANDS))},
 case when vec_id % 17 = 0 then null else cast(embedding[13] as double) end as gap, label as cls from embeddings)""",
    "scenes": """scenes as (select l_suppkey as scene_id, cast(l_shipdate as date) as sensed_on, l_suppkey % 40 as cloud_pct,
 l_partkey % 400 as cell_id, concat('B', cast(l_linenumber as varchar(9))) as band, l_extendedprice as value,
 case l_returnflag when 'R' then 1024 when 'A' then 2048 else 0 end as qa60 from lineitem)""",
    "polygons": """fields as (select (max(vec_id) // 25 + 1) * 50 // 200 + 1 as n from embeddings),
polygons as (select s_suppkey as poly_id, s_name as name, cast((s_suppkey % 5) * 200 + 13 as double) as minx,
 cast((s_suppkey % 5) * 200 + 183 - s_suppkey % 3 as double) as maxx, cast(1000 - (s_suppkey // 5) % n * 200 - 193 as double) as miny,
 cast(1000 - (s_suppkey // 5) % n * 200 - 33 - s_suppkey % 3 as double) as maxy from supplier, fields)""",
    "grids": """grids as (select s_name as layer, 25 as width, 20 as height, case when s_nationkey % 5 = 3 then 30 else 50 end as px,
 case when s_suppkey % 9 = 4 then 4545 else 4544 end as epsg from supplier)""",
}


def with_tables(names: str, sql: str) -> str:
    """DuckDB SQL with the adapters named in front."""
    return "with " + ",\n".join(SQL[n] for n in names.split()) + (",\n" if sql.lstrip().startswith("--,") else "\n") + sql.replace("--,", "", 1)
