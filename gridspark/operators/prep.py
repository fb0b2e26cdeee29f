"""Preparing training data: imputation, encoding and splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import medians
from ..model import finite
from ..sources.scratch import written


def numeric_columns(df: DataFrame, besides: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in besides]


def _impute(df: DataFrame, columns: Sequence[str], statistic, fit_on: DataFrame | None) -> DataFrame:
    if not columns:
        return df
    stats = (df if fit_on is None else fit_on).agg(*(statistic(c).alias(f"_{c}") for c in columns))
    filled = df.crossJoin(F.broadcast(stats))  # one row
    return filled.select(*(F.coalesce(F.col(c).cast("double"), F.col(f"_{c}").cast("double")).alias(c) if c in columns else F.col(c) for c in df.columns))


def impute_mean(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL becomes the column's mean, over ``fit_on`` if given."""
    return _impute(df, columns, F.avg, fit_on)


def impute_median(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """NULL becomes the column's exact median, over ``fit_on`` if given. Not lazy: the medians are counted first."""
    middle = medians(df if fit_on is None else fit_on, columns) if columns else {}
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")).alias(c) if c in middle else F.col(c) for c in df.columns))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL becomes the most frequent value, the smallest of several."""
    for c in columns:
        counts = df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("_v")).count()
        mode = counts.agg(F.min_by("_v", F.struct(-F.col("count"), F.col("_v"))).alias("_mode"))
        df = df.crossJoin(F.broadcast(mode)).withColumn(c, F.coalesce(c, "_mode")).drop("_mode")  # one row
    return df


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text as a number, NULL where it is none."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in columns})


def select_and_drop(df: DataFrame, label: str, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose label and features are all there and finite."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    wanted = [label, *features]
    return df.select(*keys, *(finite(F.col(c), None).alias(c) if c in floats else F.col(c) for c in wanted)).dropna(subset=wanted)


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """``label, code``: the distinct values as text in alphabetical order from 0; kept for decoding.

    Values are dealt by ranges and sorted in each; a code is a value's place in its range behind the numbers of the ranges
    before, of which there are as many as shuffle partitions.  No task orders all values, whatever they begin with.
    """
    values = df.filter(F.col(label).isNotNull()).select(F.col(label).cast("string").alias(label)).distinct()
    dealt = values.repartitionByRange(F.col(label)).sortWithinPartitions(label)
    placed = written(dealt.withColumn("_id", F.monotonically_increasing_id()))  # the range, and the place in it
    ranges = placed.groupBy(F.shiftright("_id", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = ranges.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row per range
    joined = placed.join(F.broadcast(before), F.shiftright("_id", 33) == F.col("_range"))
    return joined.select(label, (F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("int").alias("code"))


def label_encode(df: DataFrame, label: str) -> DataFrame:
    """Add ``<label>_code``."""
    codes = label_codes(df, label).select(F.col(label).alias("_v"), F.col("code").alias(f"{label}_code"))
    return df.join(codes, F.col(label).cast("string") == F.col("_v"), "left").drop("_v")  # Spark broadcasts few classes, and not many


def _classes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("_class")).agg(F.count("*").alias("_n"))


def duplicate_singletons(df: DataFrame, label: str) -> DataFrame:
    """Rows of classes with one row occur twice."""
    single = _classes(df, label).filter("_n = 1").select("_class")
    return df.unionByName(df.join(single, F.col(label) == F.col("_class"), "left_semi"))


def drop_null_label(df: DataFrame, label: str) -> DataFrame:
    return df.dropna(subset=[label])


def bucket(key: Column, seed: int, buckets: int = 100) -> Column:
    """A bucket of [0, buckets) from the MD5 of the key and a seed."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long") % buckets


def train_test_split(df: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``, by a hash of the key."""
    return df.withColumn("is_test", bucket(F.col(key), seed) < round(test * 100))


def stratified_split(df: DataFrame, label: str, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_test``: in every class the same share of rows, by the order of a hash; one at least.

    The share is ``test``, or the number of classes over the number of rows if that is more.  A class is cut at a quantile
    of the hash that is found by counting, so it is never brought together in one task.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    order = F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")
    placed = df.withColumns({"_digest": digest, "_bin": order})
    classes = _classes(df, label)
    whole = classes.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_classes"))
    share = F.greatest(F.lit(test), F.col("_classes") / F.col("_rows"))
    quota = classes.crossJoin(F.broadcast(whole)).select("_class", F.greatest(F.lit(1), F.ceil(share * F.col("_n"))).alias("_quota"))  # one row
    bins = placed.groupBy(F.col(label).alias("_class"), F.col("_bin").alias("_b")).agg(F.count("*").alias("_in"))  # 65,536 a class at most
    before = bins.withColumn("_before", F.sum("_in").over(W.partitionBy("_class").orderBy("_b")) - F.col("_in")).join(quota, "_class")
    cut = before.select("_class", "_b", "_before", "_quota", (F.col("_before") + F.col("_in") <= F.col("_quota")).alias("_all"), (F.col("_before") >= F.col("_quota")).alias("_none"))
    joined = placed.join(cut, (F.col(label) == F.col("_class")) & (F.col("_bin") == F.col("_b")), "left")
    edge = joined.filter("not _all and not _none").withColumn("_rank", F.row_number().over(W.partitionBy(label, "_bin").orderBy("_digest", key)))
    rest = joined.filter("_all or _none or _all is null").withColumn("_rank", F.lit(0))
    both = rest.unionByName(edge)
    return both.select(*df.columns, F.coalesce(F.col("_all") | (~F.col("_none") & (F.col("_before") + F.col("_rank") <= F.col("_quota"))), F.lit(False)).alias("is_test"))
