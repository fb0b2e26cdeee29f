"""Helpers shared by the corpus operators: tables, scratch tables and constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

__all__ = ["DOCUMENT_COLUMNS", "LOWER", "UPPER", "WORD", "drop_written", "keep_rows", "lower_ascii", "scratch", "table", "tune", "written"]

#: Python regular expression of a word: a run of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

#: The columns of the documents table; filtering stages return these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch may hold, so that a Python worker stays small however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    return shared_path(spark, "corpus")


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that :func:`written` made and that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)


def keep_rows(docs: DataFrame, id_col: str, key: Column, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` but those that ``verdicts(id, key, kept)`` rejects; a row is known by its id and ``key``, a hash of its text.

    Rows without a verdict stay; of rows that are kept and repeat an id and a key one stays.  Only ids and hashes are written,
    and texts are shuffled once at most.
    """
    asked = verdicts.groupBy("id", "key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("times")).filter("not kept or times > 1")
    # the table grows with the rows, so the plan is the one for many rows at any size
    asked = written(asked.select(F.col("id").alias("_id"), F.col("key").alias("_key"), "kept")).hint("merge")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col(id_col).alias("id"), key.alias("key"))
    same = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id"))
    rest = rows.join(asked, same, "left_anti")
    again = asked.filter("kept")
    if not again.isEmpty():  # repeated rows
        rest = rest.union(rows.join(again, same, "left_semi").dropDuplicates(["id", "key"]))
    return rest.select("doc.*")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; NULL becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
