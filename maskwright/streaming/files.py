"""New documents as a stream, against a dictionary that grows (an extension; the batch queries do not need it)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.operators.rules import Rule
from maskwright.operators.sanitize import applied, detected, dictionary, extended
from maskwright.sources.shared import written


def sanitize_stream(docs: DataFrame, rules: list[Rule], out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rewrite each batch of (doc_id, content) and append to out/documents; out/dictionary-<batch> holds all aliases so far.

    Numbers given out never change. A batch that runs again after a failure starts from the same dictionary and overwrites
    its own output, so each document appears once.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = detected(batch, rules)
        known = spark.read.parquet(f"{out}/dictionary-{epoch - 1}") if epoch else None
        names = written(extended(found, known) if known is not None else dictionary(found), "dictionary")
        names.write.mode("overwrite").parquet(f"{out}/dictionary-{epoch}")
        applied(found, names).write.mode("overwrite").parquet(f"{out}/documents/batch={epoch}")

    w = docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files as they arrive: (doc_id, path, content)."""
    rows = spark.readStream.format("text").option("wholetext", True).load(folder)
    return rows.select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.input_file_name().alias("path"), F.col("value").alias("content"))
