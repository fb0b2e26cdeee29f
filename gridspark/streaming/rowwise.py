"""Operators without state on streams: the same expressions as in batch, over a streaming DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.indices import indices
from ..operators.quality import is_outlier
from ..operators.scenes import cloud_mask


def clear_reflectance(scenes: DataFrame) -> DataFrame:
    """Scene values as they arrive, clouds taken out."""
    return cloud_mask(scenes).filter(F.col("value").isNotNull())


def streamed_indices(bands: DataFrame, config: Mapping[str, Mapping[str, str]], keep: Sequence[str] = ("row", "col")) -> DataFrame:
    """Indices of cells as they arrive. Extremes are not capped: that needs the median of all cells."""
    return indices(bands, config, keep, limit=None)


def flag_against(points: DataFrame, stats: DataFrame, column: str, width: float = 5.0) -> DataFrame:
    """Add ``<column>_global`` by the mean and deviation of stored statistics (one row, as ``quality.global_stats`` gives)."""
    joined = points.crossJoin(F.broadcast(stats.select(f"{column}_mean", f"{column}_std")))  # one row
    return joined.withColumn(f"{column}_global", is_outlier(F.col(column), F.col(f"{column}_mean"), F.col(f"{column}_std"), width)).drop(f"{column}_mean", f"{column}_std")
