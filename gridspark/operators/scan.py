"""Scan conversion of polygons: each becomes spans of cells per grid row, which meet cells by row and block of columns.

Edges are dealt out by the rows that they pass.  In a row, the crossings of the line through the cell centres, in order, are the
ends of the spans whose centres are inside (even-odd, so a ring inside another is a hole and several parts are just more
edges); for polygons that touch cells, the run of cells that each edge passes through in the row is added.  The predicates are
those of :mod:`..functions.geometry` and are evaluated where a span ends only, so the work grows with the boundary's cells and
not with the area, the box or the number of cells near a polygon.  A long boundary is spread over tasks by its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import edge_meets_box, rings_of, shape_edges
from ..model import Grid

#: Columns of cells by which spans and cells of a row meet: a span has a row for each block, and only its ends' blocks hold other cells.
BLOCK = 16


def _clipped(value: Column, low: int, high: int) -> Column:
    """A whole-numbered double as an int within bounds; what is far outside is cut before the cast."""
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value)).cast("int")


def _first_centre(grid: Grid, x: Column) -> Column:
    """The first column whose centre is at ``x`` or to the right of it; the estimate is corrected by the centres themselves."""
    near = _clipped(F.ceil((x - grid.x0) / grid.dx - 0.5).cast("double"), -1, grid.width + 1)
    return F.when(grid.center_x(near - 1) >= x, near - 1).when(grid.center_x(near) < x, near + 1).otherwise(near)


def boundary(polygons: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """``_shape, _of, row, cross, run`` for each edge and grid row that it passes: where it crosses the centres' line, and the cells it passes through.

    ``_of`` holds the polygon's columns, ``_shape`` tells polygons apart.  Polygons that are NULL or have a corner that is no finite number have none.
    """
    rings = rings_of(polygons)
    kept = [c for c in polygons.columns if c not in ("ring", "rings")]
    attributes = F.struct(*(F.col(f"`{c}`") for c in kept)) if kept else F.struct(F.lit(True).alias("_any"))
    finite = F.forall(F.flatten(rings), lambda p: (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    shapes = polygons.filter(F.coalesce(finite, F.lit(False))).select(F.monotonically_increasing_id().alias("_shape"), attributes.alias("_of"), shape_edges(rings).alias("_edges"))
    edges = shapes.select("_shape", "_of", F.explode("_edges").alias("e")).select("_shape", "_of", "e.*")
    rows = edges.withColumns({
        "_first": _clipped(F.floor((grid.y0 - F.greatest("ay", "by")) / grid.dy - 0.5).cast("double") - 1, 0, grid.height),
        "_last": _clipped(F.ceil((grid.y0 - F.least("ay", "by")) / grid.dy - 0.5).cast("double") + 1, -1, grid.height - 1)}).filter("_first <= _last")
    passed = rows.withColumn("row", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last").withColumn("_y", grid.center_y(F.col("row")))
    crossing = F.when((F.col("ay") > F.col("_y")) != (F.col("by") > F.col("_y")), F.expr("ax + (_y - ay) * (bx - ax) / (by - ay)"))
    passed = passed.withColumn("cross", crossing)
    if all_touched:
        passed = _with_runs(passed, grid)
    else:
        passed = passed.withColumn("run", F.lit(None).cast("struct<a: int, b: int>"))
    return passed.select("_shape", "_of", "row", "cross", "run").filter("cross is not null or run is not null")


def _with_runs(passed: DataFrame, grid: Grid) -> DataFrame:
    """Add ``run``, the cells ``a`` to ``b`` of a row that an edge shares a point with: the ends are tested, what lies between is passed."""
    passed = passed.withColumns({"_low": F.col("_y") - grid.dy / 2, "_high": F.col("_y") + grid.dy / 2})
    near = (F.least("ay", "by") <= F.col("_high")) & (F.greatest("ay", "by") >= F.col("_low"))
    share = lambda line: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(line) - F.col("ay")) / (F.col("by") - F.col("ay"))))
    at = lambda line, end: F.when(F.col("ay") == F.col("by"), F.col(end)).otherwise(F.col("ax") + share(line) * (F.col("bx") - F.col("ax")))
    passed = passed.withColumns({"_one": F.when(near, at("_low", "ax")), "_two": F.when(near, at("_high", "bx"))})
    column = lambda x: _clipped(F.floor((x - grid.x0) / grid.dx).cast("double"), -2, grid.width + 1)
    tried = lambda begin: F.transform(F.array(*(F.lit(d) for d in (-1, 0, 1))), lambda d: begin + d)
    passed = passed.withColumns({"_first": tried(column(F.least("_one", "_two"))), "_last": tried(column(F.greatest("_one", "_two")))})
    edge = {c: F.col(c) for c in ("ax", "ay", "bx", "by")}

    def meets(col: Column) -> Column:
        x = grid.center_x(col)
        return edge_meets_box(edge, x - grid.dx / 2, F.col("_low"), x + grid.dx / 2, F.col("_high"))

    passed = passed.withColumns({"_a": F.array_min(F.filter("_first", meets)), "_b": F.array_max(F.filter("_last", meets))})
    return passed.withColumn("run", F.when(near & (F.col("_a") <= F.col("_b")), F.struct(F.col("_a").alias("a"), F.col("_b").alias("b"))))


def spans(polygons: DataFrame, grid: Grid, all_touched: bool = False) -> DataFrame:
    """The polygons' columns with ``row, col_from, col_to`` for every run of cells in a row, both ends included; runs of a polygon are disjoint.

    A run holds the cells whose centre is inside, with ``all_touched`` also those that share a point with an edge.
    """
    rows = boundary(polygons, grid, all_touched).groupBy("_shape", "row").agg(
        F.first("_of").alias("_of"), F.sort_array(F.collect_list("cross")).alias("cross"), F.collect_list("run").alias("run"))
    inside = F.transform(F.when(F.size("cross") > 0, F.sequence(F.lit(0), F.expr("size(cross) div 2") - 1)).otherwise(F.expr("array()").cast("array<int>")), lambda i: F.struct(
        _first_centre(grid, F.get("cross", 2 * i)).alias("a"), (_first_centre(grid, F.get("cross", 2 * i + 1)) - 1).alias("b")))
    found = rows.select("_shape", "_of", "row", F.explode(F.concat(inside, "run")).alias("s"))
    found = found.select("_shape", "_of", "row", F.greatest(F.lit(0), "s.a").alias("a"), F.least(F.lit(grid.width - 1), "s.b").alias("b")).filter("a <= b")
    if all_touched:  # runs of edges overlap each other and the inside: join what meets, within the same shuffle
        before = W.partitionBy("_shape", "row").orderBy("a", "b")
        reach = F.max("b").over(before.rowsBetween(W.unboundedPreceding, -1))
        begins = F.when(reach.isNull() | (F.col("a") > reach + 1), 1).otherwise(0)
        numbered = found.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(before.rowsBetween(W.unboundedPreceding, 0)))
        found = numbered.groupBy("_shape", "row", "_run").agg(F.first("_of").alias("_of"), F.min("a").alias("a"), F.max("b").alias("b"))
    kept = [c for c in polygons.columns if c not in ("ring", "rings")]
    return found.select(*(F.col(f"_of.`{c}`").alias(c) for c in kept), "row", F.col("a").alias("col_from"), F.col("b").alias("col_to"))


def cells_in_spans(cells: DataFrame, found: DataFrame, how: str = "inner") -> DataFrame:
    """Cells joined to the spans that hold them: an equi-join on row and block of columns, then a comparison of columns."""
    renamed = found.withColumnsRenamed({"row": "_row", "col_from": "_from", "col_to": "_to"})
    blocks = renamed.withColumn("_block", F.explode(F.sequence(F.expr(f"_from div {BLOCK}"), F.expr(f"_to div {BLOCK}"))))
    same = (F.col("row") == F.col("_row")) & (F.expr(f"col div {BLOCK}") == F.col("_block")) & F.col("col").between(F.col("_from"), F.col("_to"))
    joined = cells.join(blocks, same, how)
    return joined if how == "left_semi" else joined.drop("_row", "_from", "_to", "_block")
