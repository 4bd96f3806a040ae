"""Tables written to the folder in spark.checkpoint.dir, which driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: folders that `written` made for the innermost `finished` that is running in this thread
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. A local session that names none gets one; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        where = spark.sparkContext._jsc.sc().getCheckpointDir()
        if where.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "maskwright-checkpoints"))
            where = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = where.get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The same rows, read back from the shared folder: evaluated once, independent of any executor. options: the writer's."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides by key, for rows that are as many as the corpus has. What a written table takes on
    disk tells little of them: repeated texts and running numbers take next to nothing there, so Spark would hold the table to be
    small and send it whole through the driver."""
    return df.hint("merge")


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make()'s rows from a table of their own; the tables that were written for them on the way are deleted."""
    outer = _MADE.set(made := [])
    try:
        out = written(make(), name)
    finally:
        _MADE.reset(outer)
    for path in made[:-1]:
        deleted(spark, path)
    if (around := _MADE.get()) is not None:
        around.append(made[-1])
    return out
