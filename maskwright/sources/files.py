"""Corpora from folders of files, rule files by precedence, manifests, and the way back to files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators.paths import should_ignore, should_process

RULE_FILE = ".maskwright-rules.json"
HOME_VARIABLE = "MASKWRIGHT_HOME"
MANIFEST = "version string, source_path string, destination_path string, created_at timestamp, restored_at timestamp, level int, scope_specifiers array<string>, total_files long, processed_files long, skipped_files long, total_replacements long, unique_values long"


def read_corpus(spark: SparkSession, root: str, extensionless: bool = False) -> DataFrame:
    """(doc_id, path, length, content, bytes) of the files under root that are to be processed; doc_id by path.

    In a file that is not UTF-8 each bad byte is read as U+FFFD; bytes holds such a file as it was, and is null for all others. Only names and sizes are read of what is filtered out. A missing folder gives no rows.
    """
    schema = "doc_id long, path string, length long, content string, bytes binary"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + _quoted(base) + "/", "")
    kept = files.withColumn("path", rel).where(should_process(F.col("path"), extensionless) & ~should_ignore(F.col("path"), F.col("length")))
    text = F.col("content").cast("string")
    return kept.select(F.xxhash64("path").alias("doc_id"), "path", "length", F.make_valid_utf8(text).alias("content"), F.when(~F.is_valid_utf8(text), F.col("content")).alias("bytes"))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def home_dir() -> str:
    """Where the global rule file lies: the environment variable, else the platform's place."""
    if os.environ.get(HOME_VARIABLE):
        return os.environ[HOME_VARIABLE]
    if os.name == "nt":
        return os.path.join(os.environ.get("APPDATA", os.path.expanduser("~")), "maskwright")
    return os.path.join(os.environ.get("XDG_CONFIG_HOME", os.path.expanduser("~/.config")), "maskwright")


def find_rule_file(start: str) -> str | None:
    """The nearest rule file in start or a folder above it."""
    at = os.path.abspath(start)
    while True:
        if os.path.isfile(found := os.path.join(at, RULE_FILE)):
            return found
        if (up := os.path.dirname(at)) == at:
            return None
        at = up


def rule_files(start: str, explicit: str | None = None) -> list[str]:
    """Rule files from the weakest to the strongest: global, given, the project's own; each once."""
    found = [os.path.join(home_dir(), "rules.json"), explicit, find_rule_file(start)]
    return list(dict.fromkeys(os.path.abspath(p) for p in found if p and os.path.isfile(p)))


def write_result(result: DataFrame, names: DataFrame, path: str) -> None:
    """Rewritten documents and their dictionary as Parquet."""
    result.write.parquet(f"{path}/documents")
    names.write.parquet(f"{path}/dictionary")


def write_manifest(spark: SparkSession, path: str, stats: DataFrame, level: int, scope: list[str] | None = None, source_path: str = "", destination_path: str = "") -> None:
    """One JSON row: what ran, when, over how much."""
    row = stats.select(
        F.lit("2.0").alias("version"), F.lit(source_path).alias("source_path"), F.lit(destination_path).alias("destination_path"), F.current_timestamp().alias("created_at"),
        F.lit(None).cast("timestamp").alias("restored_at"), F.lit(level).alias("level"), F.array(*map(F.lit, scope or [])).cast("array<string>").alias("scope_specifiers"), "*",
    )
    row.coalesce(1).write.json(f"{path}/manifest")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest's row; of an older one missing fields are null; a corrupt or missing one has no row."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], MANIFEST)
    found = spark.read.schema(MANIFEST).json(f"{path}/manifest").where("version is not null")
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/restored")
    if not marks.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marks):
        return found
    last = spark.read.schema("restored_at timestamp").json(f"{path}/restored").agg(F.max("restored_at").alias("__at"))
    return found.crossJoin(last).withColumn("restored_at", F.coalesce("__at", "restored_at")).drop("__at")  # one row each


def mark_restored(spark: SparkSession, path: str) -> None:
    """Note in the run's folder that, and when, it was restored."""
    spark.range(1).select(F.current_timestamp().alias("restored_at")).coalesce(1).write.mode("append").json(f"{path}/restored")


def copy_untouched(spark: SparkSession, root: str, to: str, extensionless: bool = False) -> int:
    """Copy what is not processed (but not what is ignored by folder) from root to the same places under `to`; how many files.

    Both must be folders that all executors see. Contents are copied by the tasks, one file at a time.
    """
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + _quoted(base) + "/", "")
    rest = files.select(rel.alias("path"), "length").where(~(should_process(F.col("path"), extensionless) & ~should_ignore(F.col("path"), F.col("length"))))

    def put(rows):
        import shutil

        for r in rows:
            where = os.path.join(to, r.path)
            os.makedirs(os.path.dirname(where), exist_ok=True)
            shutil.copyfile(os.path.join(base, r.path), where)

    rest.select("path").foreachPartition(put)
    return rest.count()


def clean_empty_folders(root: str) -> int:
    """Remove folders under root that hold nothing, the deepest first; how many."""
    gone = 0
    for at, _, _ in os.walk(root, topdown=False):
        if at != root and not os.listdir(at):
            os.rmdir(at)
            gone += 1
    return gone


def write_xref(lines: DataFrame, path: str) -> None:
    """The lines of audit.xref_lines as text files in their order."""
    lines.select("line").write.text(path)


def write_files(result: DataFrame, root: str) -> None:
    """Documents as files under root, which all executors must see; written beside and renamed, so a lost task leaves none half."""

    def put(rows):
        import uuid

        for r in rows:
            to = os.path.join(root, r.path)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}"
            with open(part, "w", encoding="utf-8", newline="") as f:
                f.write(r.content or "")
            os.replace(part, to)

    result.select("path", "content").foreachPartition(put)
