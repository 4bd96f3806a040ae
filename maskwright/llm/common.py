"""What several operators of this subpackage share: the folder all executors see, written tables, components of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.shared import deleted, finished, fresh_path, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch that go to a Python worker together: a few MB of texts, where Spark's default would be tens.
ARROW_ROWS = 2500


def texts(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (long) and text (string) alone, for a Python worker with bounded memory."""
    bounded(rows.sparkSession)
    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batch rows to ARROW_ROWS, unless they are lower already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


def tidy(run):
    """A batch function that, when its task ends, hands the worker's free memory back: workers stay for later stages."""

    def wrapped(it):
        try:
            yield from run(it)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def dropped(df: DataFrame) -> None:
    """Delete the files of a table that `written` made, when no later plan reads it."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        deleted(df.sparkSession, f)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of an edge can reach.

    Alternating large-star and small-star steps; every step is a grouped minimum and an equality join, so no component
    is ever gathered in one place. Each round is written to the shared folder. Nodes without an edge do not appear.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = written(edges.where(F.col(a) != F.col(b)).select(hi.cast("long").alias("u"), lo.cast("long").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(rounds):
        n, h = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if (n, h) == seen or not n:
            break
        seen = (n, h)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        dropped(e)
        e = nxt
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
