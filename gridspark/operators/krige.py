"""Variograms and ordinary kriging of residuals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from .lags import lag_sums
from .spatial import spatial_knn


def lag_table(points: DataFrame, value: str, max_lag: float, lags: int = 6, x: str = "x", y: str = "y") -> DataFrame:
    """``lag, distance, gamma, n`` over all pairs of rows up to ``max_lag`` apart, in equal classes.

    Counts and semivariances are those of all pairs, distances within a share of 0.0015 of them, without forming the
    pairs: see :mod:`.lags`.  Rows without a finite place or value are left out; an empty table gives no rows.
    """
    each = lag_sums(points, value, float(max_lag), lags, x, y)
    return each.select(F.col("lag").cast("int").alias("lag"), (F.col("d") / F.col("n")).alias("distance"), (F.col("g") / F.col("n")).alias("gamma"), F.col("n").cast("long").alias("n"))


def gamma(h: np.ndarray, kind: str, nugget: float, sill: float, reach: float) -> np.ndarray:
    """Semivariance at distance ``h``, 0 at 0; ``sill`` is what comes on top of the nugget."""
    r = h / reach if reach > 0 else np.ones_like(h)
    grown = 1.5 * np.minimum(r, 1) - 0.5 * np.minimum(r, 1) ** 3 if kind == "spherical" else r
    return np.where(h > 0, nugget + sill * grown, 0.0)


def fit_variogram(lags: Sequence[tuple[float, float, int]], kind: str = "spherical") -> tuple[float, float, float]:
    """Nugget, sill and range that fit (distance, gamma, n) rows best, by least squares weighted by n.

    For each range of a fine scale the other two follow from a linear fit, kept at zero or above.
    """
    d, g, n = (np.array(c, float) for c in zip(*lags, strict=True))
    best = (np.inf, (0.0, 0.0, float(d.max())))
    for reach in (d.max() * np.linspace(0.2, 2, 91) if kind == "spherical" else [d.max()]):
        shape = gamma(d, kind, 0.0, 1.0, reach)
        w = n / n.sum()
        mean_s, mean_g = (w * shape).sum(), (w * g).sum()
        spread = (w * (shape - mean_s) ** 2).sum()
        sill = max(0.0, (w * (shape - mean_s) * (g - mean_g)).sum() / spread) if spread > 0 else 0.0
        nugget = mean_g - sill * mean_s
        if nugget < 0:
            nugget, sill = 0.0, max(0.0, (w * shape * g).sum() / max((w * shape * shape).sum(), 1e-300))
        if (error := (w * (nugget + sill * shape - g) ** 2).sum()) < best[0]:
            best = (error, (float(nugget), float(sill), float(reach)))
    return best[1]


def _solved(kind: str, nugget: float, sill: float, reach: float):
    """Estimates and variances of frames of targets; those with as many neighbours are solved as one stack."""

    def solve(near: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = near.shape[:2]
        place, value = near[:, :, :2], near[:, :, 2]
        a = np.ones((n, k + 1, k + 1))
        a[:, k, k] = 0
        apart = place[:, :, None] - place[:, None]
        a[:, :k, :k] = gamma(np.hypot(apart[..., 0], apart[..., 1]), kind, nugget, sill, reach)
        b = np.ones((n, k + 1))
        b[:, :k] = gamma(np.hypot(*np.moveaxis(place - at[:, None], 2, 0)), kind, nugget, sill, reach)
        try:
            w = np.linalg.solve(a, b[..., None])[..., 0]
        except np.linalg.LinAlgError:  # some system of the stack is singular
            w = np.stack([np.linalg.lstsq(x, y, rcond=None)[0] for x, y in zip(a, b, strict=True)])
        return (w[:, :k] * value).sum(axis=1), np.maximum(0.0, (w * b).sum(axis=1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            estimates, variances = np.zeros(len(batch)), np.zeros(len(batch))
            sizes, at = batch["nx"].map(len).to_numpy(), batch[["tx", "ty"]].to_numpy(float)
            for k in np.unique(sizes):
                rows = np.flatnonzero(sizes == k)
                near = np.stack([np.stack(batch[c].to_numpy()[rows]) for c in ("nx", "ny", "nv")], axis=2).astype(float)
                estimates[rows], variances[rows] = solve(near, at[rows])
            yield pd.DataFrame({"target": batch["target"], "kriged": estimates, "variance": variances})

    return run


def ordinary_kriging(points: DataFrame, targets: DataFrame, value: str, variogram: tuple[float, float, float], kind: str = "spherical", k: int = 8,
                     key: str = "point_id", target_key: str = "point_id", x: str = "x", y: str = "y") -> DataFrame:
    """``target_key, kriged, variance`` from the k nearest points of each target; points at one place count as one, with their mean."""
    places = points.filter(F.col(value).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.min(key).alias("place"), F.avg(value).alias("v"))
    asked = targets.select(F.col(target_key).alias("place"), F.col(x).alias("x"), F.col(y).alias("y"))
    near = spatial_knn(places, k, asked, key="place").withColumnRenamed("place", "target")
    with_values = near.join(places.select(F.col("place").alias("neighbour"), "x", "y", "v"), "neighbour")
    gathered = with_values.groupBy("target").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y", "v"))).alias("near"))  # k of them
    ready = gathered.join(asked.select(F.col("place").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty")), "target").select(
        "target", "tx", "ty", *(F.col(f"near.{c}").alias(f"n{c}") for c in "xyv"))
    kind_of = dict(targets.dtypes)[target_key]
    return ready.mapInPandas(_solved(kind, *variogram), f"target {kind_of}, kriged double, variance double").withColumnRenamed("target", target_key)


def usual_lag(points: DataFrame, x: str = "x", y: str = "y") -> float:
    """An eighth of the diagonal of the points' box."""
    w, h = points.agg(F.max(x) - F.min(x), F.max(y) - F.min(y)).first()
    return max(math.hypot(w or 0.0, h or 0.0) / 8, 1e-9)


def regression_kriging(train: DataFrame, targets: DataFrame, label: str, variogram_kind: str = "spherical", max_lag: float | None = None, k: int = 8,
                       key: str = "point_id") -> DataFrame:
    """``targets`` (with the forest's ``prediction``) and ``rfrk, kriging_variance``: prediction plus kriged training residuals.

    ``train`` has the label and the forest's prediction too.  Pairs up to ``max_lag`` make the variogram, :func:`usual_lag` if
    that is None.
    """
    residuals = train.withColumn("_residual", F.col(label) - F.col("prediction"))
    if max_lag is None:
        max_lag = usual_lag(residuals)
    lags = [(r["distance"], r["gamma"], r["n"]) for r in lag_table(residuals, "_residual", max_lag).collect()]  # six rows
    variogram = fit_variogram(lags, variogram_kind) if lags else (0.0, 1.0, max_lag)
    kriged = ordinary_kriging(residuals, targets, "_residual", variogram, variogram_kind, k, key, key)
    return targets.join(kriged, key, "left").withColumn("rfrk", F.col("prediction") + F.coalesce("kriged", F.lit(0.0))).withColumnRenamed("variance", "kriging_variance").drop("kriged")


def kriging_or_forest(train: DataFrame, targets: DataFrame, label: str, **settings) -> tuple[DataFrame, str | None]:
    """:func:`regression_kriging`, written; where it fails, at run time too, the forest's prediction as ``rfrk`` without a variance, and why.

    Every row says so too: ``kriging_error`` is why there is no kriging, and NULL where there was no failure. No registered query calls this;
    theirs fail with the kriging.
    """
    reason = lambda why: F.lit(why).cast("string")
    try:
        return written(regression_kriging(train, targets, label, **settings)).withColumn("kriging_error", reason(None)), None
    except (ValueError, np.linalg.LinAlgError, PySparkException, Py4JJavaError) as error:
        nothing, why = F.lit(None).cast("double"), f"{type(error).__name__}: {error}"
        return targets.withColumns({"rfrk": F.col("prediction"), "kriging_variance": nothing, "kriging_error": reason(why)}), why
