"""Outlier flags, distributions and correlations of readings and layers."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.ml.stat import KolmogorovSmirnovTest
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import medians, quantiles
from .spatial import spatial_knn

#: Rows of points and neighbours that one task joins or adds up, about.
NEAR_ROWS = 1_000_000
#: Bins of the kernel density along one bandwidth.
BINS_PER_BANDWIDTH = 16

NORMAL, MISSING, GLOBAL, SPATIAL, BOTH = "Normal", "Missing", "Global Outlier", "Spatial Outlier", "Global and Spatial Outlier"


def is_outlier(value: Column, mean: Column, std: Column, width: float) -> Column:
    """Beyond ``width`` standard deviations; not where either is unknown."""
    return F.coalesce((value < mean - width * std) | (value > mean + width * std), F.lit(False))


def global_stats(points: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``<column>_mean`` and ``<column>_std`` (of the population)."""
    return points.agg(*(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def global_outlier(points: DataFrame, column: str, width: float = 5.0) -> DataFrame:
    """Add ``<column>_global``."""
    stats = global_stats(points, [column])
    flagged = points.crossJoin(F.broadcast(stats))  # one row
    return flagged.withColumn(f"{column}_global", is_outlier(F.col(column), F.col(f"{column}_mean"), F.col(f"{column}_std"), width)).drop(f"{column}_mean", f"{column}_std")


def neighbour_stats(points: DataFrame, columns: Sequence[str], k: int = 8, key: str = "point_id") -> DataFrame:
    """``key`` and mean and standard deviation of each column over the k nearest other points, whose NULLs do not count.

    Beyond ``NEAR_ROWS`` a shuffle partition, rows are dealt into as many partitions as their number asks for, and by key before they are added up:
    behind the join nearly every row of a task is of another key, so sums made there would be as many as the rows, and larger.
    """
    values = points.select(F.col(key).alias("neighbour"), *columns)
    near = spatial_knn(points, k, key=key).select(key, "neighbour")
    parts = -(-points.count() * k // NEAR_ROWS)
    if parts > int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        met = near.repartition(parts, "neighbour").join(values.repartition(parts, "neighbour"), "neighbour").repartition(parts, key)
    else:
        met = near.join(values, "neighbour")
    return met.groupBy(key).agg(
        *(f(c).alias(f"{c}_{n}") for c in columns for n, f in (("near", F.avg), ("near_std", F.stddev_pop))))


def spatial_outlier(points: DataFrame, column: str, width: float = 3.0, k: int = 8, key: str = "point_id") -> DataFrame:
    """Add ``<column>_spatial``."""
    near = neighbour_stats(points, [column], k, key)
    return points.join(near, key, "left").withColumn(f"{column}_spatial", is_outlier(F.col(column), F.col(f"{column}_near"), F.col(f"{column}_near_std"), width)).drop(
        f"{column}_near", f"{column}_near_std")


def flag_outliers(points: DataFrame, columns: Sequence[str], global_width: float = 5.0, spatial_width: float = 3.0, k: int = 8, key: str = "point_id") -> DataFrame:
    """Add the status ``<column>_Sta`` of every numeric column; the neighbours are searched once for all of them."""
    numeric = [c for c in columns if isinstance(points.schema[c].dataType, T.NumericType)]
    if not numeric:
        return points
    joined = points.join(neighbour_stats(points, numeric, k, key), key, "left").crossJoin(F.broadcast(global_stats(points, numeric)))  # one row

    def status(c: str) -> Column:
        far = is_outlier(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std"), global_width)
        odd = is_outlier(F.col(c), F.col(f"{c}_near"), F.col(f"{c}_near_std"), spatial_width)
        return F.when(F.col(c).isNull(), MISSING).when(far & odd, BOTH).when(far, GLOBAL).when(odd, SPATIAL).otherwise(NORMAL)

    return joined.select(*points.columns, *(status(c).alias(f"{c}_Sta") for c in numeric))


def cleaning_report(flagged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: counts and percentages by status; missing readings are in the total only."""
    long = flagged.select(*(F.col(f"{c}_Sta").alias(c) for c in columns)).unpivot([], list(columns), "Column", "status")
    names = ((NORMAL, "Normal"), (GLOBAL, "Global Outliers"), (SPATIAL, "Spatial Outliers"), (BOTH, "Global and Spatial Outliers"))
    counts = long.groupBy("Column").agg(F.count("*").alias("Total"), *(F.count_if(F.col("status") == s).alias(n) for s, n in names))
    return counts.select("Column", "Total", *(x for _, n in names for x in (F.col(n), F.round(F.col(n) / F.col("Total") * 100, 2).alias(f"{n} (%)"))))


def keep_normal(flagged: DataFrame, label: str) -> DataFrame:
    return flagged.filter(F.col(f"{label}_Sta") == NORMAL)


def distribution_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: n, mean, median, sample deviation, CV in percent, skewness and excess kurtosis (population)."""
    long = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], list(columns), "column", "v").filter("v is not null")
    out = long.groupBy("column").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                     F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"))
    middle = F.create_map(*(F.lit(x) for c, m in medians(df, columns).items() if m is not None for x in (c, m)), F.lit(""), F.lit(None).cast("double"))
    return out.withColumns({"median": middle[F.col("column")], "cv_pct": F.try_divide(F.col("std"), F.col("mean")) * 100})


def ks_normal(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """Kolmogorov-Smirnov test against the normal distribution with the sample's mean and deviation: ``statistic, p_value, is_normal``."""
    values = df.select(F.col(column).cast("double").alias(column)).dropna()
    mean, std = values.agg(F.avg(column), F.stddev_samp(column)).first()
    result = KolmogorovSmirnovTest.test(values, column, "norm", mean, std)
    return result.select(F.col("statistic"), F.col("pValue").alias("p_value"), (F.col("pValue") > alpha).alias("is_normal"))


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """``x, density`` of a Gaussian kernel estimate (Scott's bandwidth) at equal steps from least to greatest.

    Values are counted into bins of a sixteenth of the bandwidth, each with the first four moments around its centre; a kernel is
    expanded to the fourth order there (Hermite polynomials).  What is left out is at most 2e-9 of a kernel's height, so the density is within 2e-9 of the
    greatest possible one of the exact sum, whatever the values.  The work is points times bins with a value in them.
    """
    v = F.col(column).cast("double")
    values = df.select(F.nanvl(v, F.lit(None).cast("double")).alias("v")).filter("v is not null")
    whole = values.agg(F.count("*").alias("n"), (F.pow(F.count("*"), F.lit(-0.2)) * F.stddev_samp("v")).alias("h"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    placed = values.crossJoin(F.broadcast(whole.filter("h > 0"))).withColumn("b", F.floor((F.col("v") - F.col("lo")) * BINS_PER_BANDWIDTH / F.col("h")))  # one row
    centred = placed.withColumn("c", F.col("lo") + (F.col("b") + 0.5) * F.col("h") / BINS_PER_BANDWIDTH).withColumn("u", (F.col("v") - F.col("c")) / F.col("h"))
    bins = centred.groupBy("b", "c").agg(F.count("*").alias("m0"), *(F.sum(F.pow("u", F.lit(float(k)))).alias(f"m{k}") for k in range(1, 5)))
    steps = whole.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = steps.select("n", "h", (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (points - 1)).alias("x"), "i")
    met = bins.crossJoin(F.broadcast(at)).withColumn("z", (F.col("x") - F.col("c")) / F.col("h"))  # ``points`` rows
    kernel = F.expr("exp(-0.5 * z * z) * (m0 + z * m1 + (z * z - 1) * m2 / 2 + (z * z * z - 3 * z) * m3 / 6 + (z * z * z * z - 6 * z * z + 3) * m4 / 24)")
    return met.groupBy("i", "x").agg((F.sum(kernel) / F.first(F.col("n") * F.col("h") * F.sqrt(2 * F.pi()))).alias("density")).select("x", "density")


def _pairs(df: DataFrame, pairs: list[tuple[str, str]], value) -> DataFrame:
    wide = df.agg(*(F.corr(value(a), value(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_{i}").alias("r")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(rows).alias("p")).select("p.*")


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r``: Pearson over the rows where both are there, lower triangle with the diagonal, in one aggregate."""
    return _pairs(df, [(b, a) for a, b in combinations_with_replacement(columns, 2)], F.col)


def correlation_edges(flagged: DataFrame, columns: Sequence[str], least: float = 0.1) -> DataFrame:
    """``a, b, r, width`` for pairs with |r| above ``least``, each column masked to its own normal readings."""
    normal = lambda c: F.when(F.col(f"{c}_Sta") == NORMAL, F.col(c))
    return _pairs(flagged, list(combinations(columns, 2)), normal).filter(F.abs("r") > least).withColumn("width", 2 * F.abs("r"))


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``bin, center, width, n, density`` of equal bins from least to greatest, the last one closed; empty bins included."""
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    stats = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("total"))
    placed = values.crossJoin(F.broadcast(stats.select("lo", "hi")))  # one row
    spread = F.col("hi") > F.col("lo")
    index = F.when(spread, F.least(F.floor((F.col("v") - F.col("lo")) / F.when(spread, (F.col("hi") - F.col("lo")) / bins)) + 1, F.lit(bins))).otherwise(1)
    counts = placed.groupBy(index.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = stats.filter("total > 0").withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    width = (F.col("hi") - F.col("lo")) / bins
    return all_bins.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + (F.col("bin") - 0.5) * width).alias("center"), width.alias("width"), F.coalesce("n", F.lit(0)).alias("n"),
        F.try_divide(F.coalesce("n", F.lit(0)).cast("double"), F.col("total") * width).alias("density"))


def trim_upper(df: DataFrame, columns: Sequence[str], share: float = 0.99) -> DataFrame:
    """For each column in turn, the rows below that quantile of what is left."""
    for c in columns:
        df = df.filter(F.col(c) < F.lit(quantiles(df, {c: [share]})[c][0]))
    return df


def trimmed_correlation(df: DataFrame, columns: Sequence[str], share: float = 0.99) -> DataFrame:
    return correlation_matrix(trim_upper(df.select(*columns), columns, share), columns)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """``value, least, greatest``: the values that occur, with their range on every row."""
    stats = df.agg(F.min(column).alias("least"), F.max(column).alias("greatest"))
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct().crossJoin(F.broadcast(stats))  # one row
