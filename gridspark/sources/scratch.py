"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Where neither is set, a session on one machine gets a temporary folder; on a cluster, whose executors could not read each
    other's files there, that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What is written inside :func:`dropping_tables`, by thread, so that pipelines side by side drop their own tables.
_made: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


@contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`written` writes inside, at the end; results that need it must have been written elsewhere by then."""
    paths: list[str] = []
    before = _made.set((*_made.get(), paths))
    try:
        yield
    finally:
        _made.reset(before)
        for path in map(spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: ``df`` written once and read back."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    if _made.get():
        _made.get()[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
