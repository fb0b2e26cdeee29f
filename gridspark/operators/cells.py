"""Cell values: gaps, neighbourhoods, replacement and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import neighbourhood

#: Neighbours that a gap is filled from, in rows and columns from it.
GAP_OFFSETS = tuple((r, c) for r in range(-2, 2) for c in range(-2, 2) if (r, c) != (0, 0))
STATISTICS = ("mean", "median", "min", "max")


def fill_nodata(cells: DataFrame, value: str, offsets: Sequence[tuple[int, int]] = GAP_OFFSETS) -> DataFrame:
    """``row, col, value, filled``: NULL becomes the mean of the valid neighbours, or the layer's mean without one.

    Neighbours are looked up for gaps only, in array tiles.
    """
    means = neighbourhood(cells, value, offsets, ["mean"], False, F.col(value).isNull()).select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("mean").alias("_near"))
    base = cells.select("row", "col", F.col(value).alias("_v"))
    whole = base.agg(F.avg("_v").alias("_all"))
    return (base.join(means, (F.col("row") == F.col("_r")) & (F.col("col") == F.col("_c")), "left").crossJoin(F.broadcast(whole))  # one row
            .select("row", "col", F.coalesce("_v", "_near", "_all").alias(value), F.col("_v").isNull().alias("filled")))


def focal_statistics(cells: DataFrame, value: str, statistics: Sequence[str] = STATISTICS, window: int = 3, only: Column | None = None) -> DataFrame:
    """``row, col`` and each statistic over the window around each cell (those where ``only`` holds), mirrored at the edges, in one pass.

    The grid is the cells' bounding box from (0, 0); absent and NULL cells do not count.
    """
    if unknown := [s for s in statistics if s not in STATISTICS]:
        raise ValueError(f"unknown statistic: {unknown[0]}")
    half = window // 2
    pairs = [(r, c) for r in range(-half, window - half) for c in range(-half, window - half)]
    return neighbourhood(cells, value, pairs, statistics, True, only)


def focal(cells: DataFrame, value: str, statistic: str = "mean", window: int = 3, only: Column | None = None) -> DataFrame:
    """``row, col, focal``: one statistic of :func:`focal_statistics`."""
    return focal_statistics(cells, value, [statistic], window, only).withColumnRenamed(statistic, "focal")


def fill_where(cells: DataFrame, value: str, mask: Column, method: str = "mean", custom: float | None = None, window: int = 3) -> DataFrame:
    """``row, col, value``: masked cells get a constant (``method="custom"``) or the focal statistic, masked neighbours included."""
    if method == "custom":
        return cells.select("row", "col", F.when(mask, F.lit(custom)).otherwise(F.col(value)).alias(value))
    near = focal(cells, value, method, window, mask)
    return cells.select("row", "col", F.col(value), mask.alias("_m")).join(near, ["row", "col"], "left").select(
        "row", "col", F.when(F.col("_m"), F.col("focal")).otherwise(F.col(value)).alias(value))


def pca(bands: DataFrame, names: Sequence[str], k: int, keep: Sequence[str] = ("row", "col")) -> tuple[DataFrame, list[float]]:
    """Centred scores ``pca_1 .. pca_k`` and the share of variance of each; the largest loading of each is positive."""
    full = bands.dropna(subset=list(names))
    assembled = VectorAssembler(inputCols=list(names), outputCol="_raw").transform(full)
    centred = StandardScaler(inputCol="_raw", outputCol="_c", withMean=True, withStd=False).fit(assembled).transform(assembled)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    scores = model.transform(centred).withColumn("_a", vector_to_array("_p"))
    return (scores.select(*keep, *((F.col("_a")[i] * float(s if s else 1.0)).alias(f"pca_{i + 1}") for i, s in enumerate(signs))),
            [float(v) for v in model.explainedVariance.toArray()])
