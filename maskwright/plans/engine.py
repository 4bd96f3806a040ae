"""The engine's front door: sanitize a corpus at a level and scope, restore it, check it, report on it."""

from __future__ import annotations

from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.operators import audit, paths as P, rules as R
from maskwright.operators.languages import relation, tokens
from maskwright.operators.languages.rewrite import rewritten
from maskwright.operators.restore import restored
from maskwright.operators.sanitize import ROW, applied, detected, extended, keyed, sanitized, union_all
from maskwright.operators.scope import delegation_only, in_scope, parsed_scope, processor_of
from maskwright.sources.files import mark_restored, read_manifest, write_manifest, write_result
from maskwright.sources.shared import written


def active_rules(spark: SparkSession, files: list[str] | None = None) -> list[R.Rule]:
    """The built-in rules under the rules of the given files, the last file being the strongest."""
    built = R.frame(spark, R.BUILT_IN)
    if not files:
        return R.collected(built)
    layers = [R.from_json(spark, p, rank) for rank, p in enumerate(files, 1)]
    custom = layers[0]
    for one in layers[1:]:
        custom = custom.unionByName(one)
    return R.collected(R.with_custom(built, custom))


class Run(NamedTuple):
    """What sanitizing makes: documents under their new paths, the dictionary, (path, new_path), and the references that were
    patched (path, reference, new_reference, by the old path)."""

    documents: DataFrame
    names: DataFrame
    paths: DataFrame
    references: DataFrame


def sanitize(docs: DataFrame, rules: list[R.Rule], level: int = 2, scope: str | None = None, fix_dispatch: bool = False, fixed_width: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, path, content) rewritten, and the dictionary; paths stay. Nothing is written: a dry run is all of this.

    Level 1 applies the rules. Level 2 first rewrites names, literals and comments by language, then applies the rules to
    the outcome, and goes on numbering where the first pass ended; documents out of a given scope are left to neither.
    `replacements` and `code_matches` tell of the first pass, `matches` of the second. fixed_width keeps COBOL and JCL in
    their columns; restoring what had to be cut or broken for that is not exact. Other columns come out as they went in, one
    that has the name of an output as input_<name>.
    """
    out, names, _ = _sanitized(_wrapped(docs), rules, level, parsed_scope(scope), fix_dispatch, fixed_width)
    return _unwrapped(out, docs), names


#: columns that the engine works on, and where it carries all others
OWN, REST = ("doc_id", "path", "content"), "__rest"


def _wrapped(docs: DataFrame) -> DataFrame:
    """docs with its other columns in one, so that no name among them meets one of the engine's."""
    rest = [c for c in docs.columns if c not in OWN]
    return docs.select(*(c for c in docs.columns if c in OWN), F.struct(*(F.col(f"`{c}`") for c in rest)).alias(REST)) if rest else docs


def _unwrapped(out: DataFrame, docs: DataFrame) -> DataFrame:
    rest = [c for c in docs.columns if c not in OWN]
    taken = {c.lower() for c in out.columns}
    return out.select(*(c for c in out.columns if c != REST), *(F.col(f"{REST}.`{c}`").alias(f"input_{c}" if c.lower() in taken else c) for c in rest)) if rest else out


def _sanitized(docs, rules, level, ids, fix_dispatch, fixed_width):
    if level == 1:
        return *sanitized(docs, rules), None
    once, first, types = rewritten(docs, ids, fix_dispatch, fixed_width)
    found = detected(written(once, "level-2"), rules)
    left_out = delegation_only(F.col("processor"), ids) | (F.lit(ids is not None) & F.col("processor").isNull())
    found = keyed(found.withColumn("spans", F.when(left_out, F.filter("spans", lambda s: F.lit(False))).otherwise(F.col("spans"))), "detected")
    names = written(extended(found, first), "dictionary")
    out = applied(found, names)
    return out.withColumn("was_sanitized", F.col("was_sanitized") | (F.col("replacements") > 0)), names, types


def run(docs: DataFrame, rules: list[R.Rule], level: int = 2, scope: str | None = None, rename: bool = True, fix_dispatch: bool = False, fixed_width: bool = False) -> Run:
    """As sanitize; at level 2 files in scope also take aliases for names, and imports, project entries and directory listings
    follow them. Level 1 leaves paths as they are."""
    spark, ids, given = docs.sparkSession, parsed_scope(scope), docs
    docs = _wrapped(docs)
    out, names, types = _sanitized(docs, rules, level, ids, fix_dispatch, fixed_width)
    if level == 1 or not rename:
        return Run(_unwrapped(out, given), names, spark.createDataFrame([], "path string, new_path string"), spark.createDataFrame([], "path string, reference string, new_reference string"))
    out = written(out, "level-2")
    mine = docs if ids is None else docs.where(in_scope(processor_of(F.col("path"), F.col("content"), fix_dispatch), ids))
    mapping = written(P.path_aliases(mine.select("path").distinct(), types), "paths")
    every = mapping.unionByName(docs.select(P.slashes(F.col("path")).alias("path")).distinct().join(mapping.select("path"), "path", "left_anti").withColumn("new_path", F.col("path")))
    every = written(every, "all-paths")
    refs = P.resolved_imports(P.imports(out), every).unionByName(P.resolved_entries(P.project_references(out), every))
    refs = written(refs.where("reference <> new_reference").distinct(), "references")
    return Run(_unwrapped(P.renamed(P.relisted(P.patched(out, refs), mapping), mapping), given), names, mapping, refs)


def save(result: DataFrame | Run, names: DataFrame | None = None, path: str = "", level: int = 1, scope: str | None = None, source_path: str = "") -> None:
    """Documents, dictionary, path mappings, patched references, counts by file and the manifest, under path."""
    run_ = result if isinstance(result, Run) else Run(result, names, None, None)
    write_result(run_.documents, run_.names, path)
    for name, table in (("paths", run_.paths), ("references", run_.references)):
        if table is not None:
            table.write.parquet(f"{path}/{name}")
    cols = [c for c in ("doc_id", "path") if c in run_.documents.columns]
    run_.documents.select(*cols, audit.replacements(run_.documents).alias("replacements")).write.parquet(f"{path}/files")
    write_manifest(run_.documents.sparkSession, path, audit.stats(run_.documents, run_.names), level, scope.split(",") if scope else None, source_path=source_path, destination_path=path)


def restore(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a saved run with originals, references and paths put back; ValueError if there is none. The manifest tells when."""
    if read_manifest(spark, path).isEmpty():
        raise ValueError(f"{path} holds no sanitized corpus")
    docs = spark.read.parquet(f"{path}/documents")
    docs = docs.select(*(c for c in ("doc_id", "path", "content") if c in docs.columns))
    kept = {r.name: spark.read.parquet(f"{path}/{r.name}") for r in _tables(spark, path) if r.name in ("paths", "references")}
    if "path" in docs.columns and "paths" in kept:
        docs = restored_paths(docs, kept["paths"], kept["references"])
    out = restored(docs, spark.read.parquet(f"{path}/dictionary"))
    mark_restored(spark, path)
    return out


def restored_paths(docs: DataFrame, mapping: DataFrame, references: DataFrame) -> DataFrame:
    """docs under their old paths, with the references that were patched as they were."""
    back = P.relisted(P.renamed(docs, mapping, back=True), mapping, back=True)
    old = references.select("path", F.col("new_reference").alias("reference"), F.col("reference").alias("new_reference"))
    return P.patched(back, old).drop("patched")


class _Table(NamedTuple):
    name: str


def _tables(spark: SparkSession, path: str) -> list[_Table]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [_Table(s.getPath().getName()) for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]


def verify(docs: DataFrame, fix_dispatch: bool = False) -> DataFrame:
    """(doc_id, path, problem): sources whose brackets, strings, comments or blocks do not close; none for a sound corpus.

    A stand-in for building the result: it tells what a rewriting would have broken, language by language.
    """
    asked = keyed(docs.withColumn("processor", processor_of(F.col("path"), F.col("content"), fix_dispatch)).where(F.col("processor").isin(*tokens.LANGUAGES)), "to-verify")

    def run_(it):
        for b in it:
            rows = [(r, problem) for r, c, lang in zip(*(col.to_pylist() for col in b.columns)) for problem in tokens.balanced(c or "", lang)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string()))], [ROW, "problem"])

    here = {r[0] for r in asked.select("processor").distinct().collect()}  # no more than there are languages
    by_rows = [(relation.sql_problems if lang in relation.SQL else relation.basic_problems)(relation.tokens(asked.where(F.col("processor") == lang), lang)) for lang in (*relation.SQL, *relation.BASIC) if lang in here]
    others = asked.where(~F.col("processor").isin(*relation.SQL, *relation.BASIC)).select(ROW, "content", "processor").mapInArrow(run_, f"{ROW} long, problem string")
    return union_all([others, *by_rows]).join(asked.select(ROW, "doc_id", "path"), ROW).select(F.col("doc_id").cast("long").alias("doc_id"), "path", "problem")
