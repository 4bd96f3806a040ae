"""What one source takes from others: JCL symbols as of their place, and edges from file to file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.languages import lines
from maskwright.operators.paths import stem
from maskwright.operators.sanitize import ROW, keyed
from maskwright.sources.shared import written

SYMBOL = r"&([A-Z0-9@#$]+)"
#: name and value of an assignment; a value in quotes may hold commas
ASSIGNED = r"(?:^|,)\s*([A-Z0-9@#$]{1,8})=('[^']*'|[^,\s]*)"


def _as_of(uses: DataFrame, sets: DataFrame) -> DataFrame:
    """uses (ROW, line_no, id, symbol) with `value` and `open` of the last of sets (ROW, line_no, symbol, value, open) before their line, null if none."""
    events = uses.select(ROW, "line_no", "symbol", "id", F.lit(None).cast("struct<value:string,open:boolean>").alias("set"), F.lit(0).alias("turn"))
    events = events.unionByName(sets.select(ROW, "line_no", "symbol", F.lit(None).cast("string").alias("id"), F.struct("value", "open").alias("set"), F.lit(1).alias("turn")))
    w = Window.partitionBy(ROW, "symbol").orderBy("line_no", "turn").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("last", F.last("set", ignorenulls=True).over(w)).where("turn = 0").select(ROW, "id", "symbol", F.col("last.value").alias("value"), F.col("last.open").alias("open"))


def _put(text: Column, values: Column) -> Column:
    """text with each symbol of values (struct symbol, value) replaced, all at once; a dot after it belongs to the symbol."""
    known = F.map_from_entries(values)
    parts = F.regexp_extract_all(text, F.lit(r"&[A-Z0-9@#$]+\.?|[^&]+|&"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&"), F.coalesce(F.try_element_at(known, F.regexp_extract(p, SYMBOL, 1)), p)).otherwise(p)), "")


def _filled(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows (ROW, line_no, id, text) with `filled`: all symbols replaced that are set, or none as long as one of their values is open (`left`)."""
    uses = rows.select(ROW, "line_no", "id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(SYMBOL), F.lit(1)))).alias("symbol"))
    known = _as_of(uses, sets)
    per = known.where("value is not null").groupBy(ROW, "id").agg(F.array_sort(F.collect_list(F.when(~F.col("open"), F.struct("symbol", "value")))).alias("values"), F.bool_or("open").alias("left"))
    out = rows.join(per, [ROW, "id"], "left")
    return out.withColumn("filled", F.when(F.col("values").isNull() | F.col("left"), F.col("text")).otherwise(_put(F.col("text"), F.col("values")))).withColumn("left", F.coalesce("left", F.lit(False))).drop("values")


def jcl_resolved(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, content). (doc_id, line_no, operands, resolved) of each card: its operands with every symbol as the last SET or PROC
    card before it has set it; a value that holds symbols is resolved at its own place first.

    A value only looks back, to cards before its own, so no symbol leads to itself and there are as many rounds as symbols nest. System symbols and those that
    nothing sets stay as they are. Rows with null and repeated doc_ids are jobs of their own.
    """
    d = keyed(docs.select("doc_id", "content"), "jobs")
    cards = written(lines.jcl_lines(d.select(F.col(ROW).alias("doc_id"), "content")).where("line_type not in ('Comment', 'Instream', 'Null', 'Delimiter') and operands is not null").select(F.col("doc_id").alias(ROW), "line_no", "line_type", "operands"), "cards")
    given = cards.where("line_type in ('Set', 'Proc')").withColumns({"names": F.regexp_extract_all(F.upper("operands"), F.lit(ASSIGNED), F.lit(1)), "values": F.regexp_extract_all("operands", F.lit(f"(?i){ASSIGNED}"), F.lit(2))})
    given = given.select(ROW, "line_no", F.posexplode(F.arrays_zip("names", "values")).alias("k", "x")).select(ROW, "line_no", F.concat_ws(":", "line_no", "k").alias("id"), F.col("x.names").alias("symbol"), F.regexp_replace("x.values", "^'(.*)'$", "$1").alias("value"))
    sets = written(given.withColumn("open", F.col("value").rlike(SYMBOL)), "symbols")
    while not sets.where("open").isEmpty():
        # those whose symbols are all settled, or set nowhere, are settled themselves
        now = _filled(sets.select(ROW, "line_no", "id", F.col("value").alias("text")), sets)
        sets = written(sets.drop("value", "open").join(now.select(ROW, "id", F.col("filled").alias("value"), F.col("left").alias("open")), [ROW, "id"]), "symbols")
    rows = _filled(cards.select(ROW, "line_no", F.col("line_no").cast("string").alias("id"), F.col("operands").alias("text")), sets)
    return rows.join(d.select(ROW, "doc_id"), ROW).select("doc_id", "line_no", F.col("text").alias("operands"), F.col("filled").alias("resolved"))


def file_edges(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, path, content) of COBOL sources, copybooks and JCL. (source, kind, value, target): each program that a file runs or calls and each
    copybook that it copies, with the path of the file that declares it (or, a copybook, is named like it): null if none does, and a
    row for each if several do. What a file takes twice is one edge."""
    d = keyed(docs.select("path", "content"), "linked")
    cobol = d.where(F.lower("path").rlike(r"\.(cbl|cob|cpy)$")).select(F.col(ROW).alias("doc_id"), "content")
    jobs = d.where(F.lower("path").rlike(r"\.(jcl|prc)$")).select(F.col(ROW).alias("doc_id"), "content")
    found = written(lines.cobol_names(cobol).where("category in ('Program', 'Copybook')").join(lines.lines(cobol).select("doc_id", "line_no", "text"), ["doc_id", "line_no"]), "cobol-links")
    declares = F.upper("text").rlike(r"PROGRAM-ID")
    programs = found.where(declares).select(F.col("doc_id").alias(ROW), F.lit("program").alias("what"), F.upper("value").alias("value"))
    copybooks = d.where(F.lower("path").endswith(".cpy")).select(ROW, F.lit("copybook").alias("what"), F.upper(stem(F.col("path"))).alias("value"))
    uses = found.where(~declares).select(F.col("doc_id").alias(ROW), F.when(F.col("category") == "Copybook", "copies").otherwise("calls").alias("kind"), F.upper("value").alias("value"))
    uses = uses.unionByName(lines.jcl_names(jobs).where("category = 'Program'").select(F.col("doc_id").alias(ROW), F.lit("runs").alias("kind"), F.upper("value").alias("value"))).distinct()
    homes = programs.unionByName(copybooks).distinct().join(d.select(ROW, F.col("path").alias("target")), ROW).drop(ROW)
    met = uses.withColumn("what", F.when(F.col("kind") == "copies", "copybook").otherwise("program")).join(homes, ["what", "value"], "left")
    return met.join(d.select(ROW, F.col("path").alias("source")), ROW).select("source", "kind", "value", "target").distinct()


def reached(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """edges: (source, target). (source, target, steps, cycle): all that each file reaches, in how few steps, and whether it comes round to itself.

    Each round only follows what the one before has found; a chain of more than `rounds` files is an error. Null targets lead nowhere.
    """
    one = written(edges.where("target is not null").select("source", "target").distinct(), "edges")
    seen = new = written(one.withColumn("steps", F.lit(1)), "reached")
    for k in range(2, rounds + 1):
        found = new.select("source", F.col("target").alias("via")).join(one.select(F.col("source").alias("via"), "target"), "via").select("source", "target").distinct()
        new = written(found.join(seen.select("source", "target"), ["source", "target"], "left_anti").withColumn("steps", F.lit(k)), "reached")
        if new.isEmpty():
            return seen.withColumn("cycle", F.col("source") == F.col("target"))
        seen = seen.unionByName(new)
    raise ValueError(f"chains of more than {rounds} files")
