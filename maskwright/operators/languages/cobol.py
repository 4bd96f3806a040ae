"""COBOL names, literals and comments as spans, out of rows of words: reserved words leave by an anti-join, declared names come by a join.

The code area of a line (columns 8 to 72) is split into lexemes, of which literals and PICTURE clauses are whole ones, so
nothing within them is a word. What stands in EXEC SQL blocks is left to the SQL of the level's other sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.languages import lines
from maskwright.operators.languages.mainframe import HYPHENATED, KNOWN, PLAIN, REMOVED
from maskwright.operators.sanitize import ROW
from maskwright.sources.shared import written

#: literals, PICTURE clauses, words, blanks, single marks
LEXEMES = "'[^']*'|\"[^\"]*\"|(?i:PIC(?:TURE)?\\s+(?:IS\\s+)?\\S+)|[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?| +|(?s:.)"
#: words before a literal that names a program or a copybook
CALLERS = ("CALL", "CANCEL", "COPY")


def reserved_words(docs: DataFrame) -> DataFrame:
    """(word, plain): the words that this library knows to be reserved; plain ones may name a program or a file all the same."""
    spark = docs.sparkSession
    return spark.createDataFrame([(w, True) for w in sorted(PLAIN)] + [(w, False) for w in sorted(HYPHENATED - PLAIN)], "word string, plain boolean")


def source_lines(docs: DataFrame) -> DataFrame:
    """Rows of lines.cobol_lines with offsets, of (ROW, content), where ROW stands for the document."""
    return written(lines.cobol_lines(docs.select(F.col(ROW).alias("doc_id"), "content"), offsets=True), "cobol-lines")


def words(source: DataFrame) -> DataFrame:
    """(ROW, line_no, line_type, division, at, text, kind, before, before2, depth): the lexemes of all lines that hold code, with
    their offsets in the text, the two lexemes before (blanks left out) and how many parentheses are open on the line."""
    rows = source.where("line_type not in ('Comment', 'Blank', 'DivisionHeader')")
    code = F.substring("text", 8, 65)
    parts = rows.select(F.col("doc_id").alias(ROW), "line_no", "line_type", "division", "offset", F.posexplode(F.regexp_extract_all(code, F.lit(LEXEMES), F.lit(0))).alias("place", "text")).where("text <> ''")
    w = Window.partitionBy(ROW, "line_no").orderBy("place")
    first = F.substring("text", 1, 1)
    kind = F.when(first.isin("'", '"') & (F.length("text") > 1), "literal").when(F.col("text").rlike(r"(?i)^PIC(?:TURE)?\s"), "picture").when(first == " ", "space").when(first.rlike("^[A-Za-z0-9]"), "word").otherwise("mark")
    at = F.col("offset") + 7 + F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"kind": kind, "at": at.cast("int")}).where("kind <> 'space'")
    open_ = F.when(F.col("text") == "(", 1).when(F.col("text") == ")", -1).otherwise(0)
    return parts.withColumns({"before": F.upper(F.lag("text").over(w)), "before2": F.upper(F.lag("text", 2).over(w)), "depth": F.sum(open_).over(w)}).drop("place", "offset")


def _shape(word: Column) -> Column:
    """Category of a name that no line declares."""
    return F.when(word.rlike(r"^DCLS|^DCLGEN|-RECORD$|-REC$"), "CobolRecord").when(word.rlike(r"-FILE$"), "CobolFile").otherwise("Variable")


def names(source: DataFrame, found: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """(ROW, line_no, at, text, value, category): each word of `found` that is a name, in upper case, with the category of its first declaration.

    Reserved words are none; plain ones are where they name a program, file, copybook or section. Of words that no line declares (they come from
    copybooks), all count if `reserved` (word, plain) is a full table of the dialect; with the library's own list, which holds common words
    alone, those with a hyphen or a digit do, and others are mere uses.
    """
    known = reserved_words(source) if reserved is None else reserved
    declared = lines.names_of_lines(source).where(~F.col("category").isin("HostVariable")).where("value <> 'FILLER'")
    declared = declared.groupBy(F.col("doc_id").alias(ROW), "value").agg(F.min_by("category", "line_no").alias("declared"))
    used = found.where((F.col("kind") == "word") & F.col("text").rlike("[A-Za-z]") & ((F.col("line_type") != "ExecCicsBlock") | (F.col("depth") > 0)) & (F.col("line_type") != "ExecSqlBlock"))
    used = used.select(ROW, "line_no", "at", "text", F.upper("text").alias("value")).join(declared, [ROW, "value"], "left")
    plain = known.where("plain").select(F.col("word").alias("value"))
    hard = known.where("not plain").select(F.col("word").alias("value"))
    used = used.join(hard, "value", "left_anti")
    sure = F.coalesce(F.col("declared").isin("Program", "CobolFile", "Copybook", "Section"), F.lit(False))
    open_ = used.where(sure).unionByName(used.where(~sure).join(plain, "value", "left_anti"))
    looks = F.col("value").rlike(r"[-0-9]|^DCLS|^DCLGEN") if reserved is None else F.lit(True)
    return open_.select(ROW, "line_no", "at", "text", "value", F.coalesce("declared", F.when((F.length("value") > 1) & looks, _shape(F.col("value"))).otherwise(KNOWN)).alias("category"))


def spans(docs: DataFrame, reserved: DataFrame | None = None) -> DataFrame:
    """(ROW, start, len, value, category, head) of COBOL sources without their EXEC SQL blocks: names, literals, comments."""
    source = source_lines(docs)
    found = written(words(source), "cobol-words")
    used = names(source, found, reserved).select(ROW, F.col("at").alias("start"), F.length("text").alias("len"), "value", "category", F.lit("").alias("head"))
    literal = found.where((F.col("kind") == "literal") & (F.col("line_type") != "ExecSqlBlock")).withColumn("inner", F.expr("substring(text, 2, length(text) - 2)"))
    called = F.col("before").isin(*CALLERS) | ((F.col("before") == "(") & (F.col("before2") == "PROGRAM"))
    said = F.filter(F.split(F.trim("inner"), "[ ,.]+"), lambda x: ~(x.rlike(r"^[A-Z]+_\d+$") | (F.length(x) <= 1)))
    shown = (F.length("inner") >= 4) & F.col("inner").rlike(r"\p{L}") & (F.size(said) > 0)
    called = F.coalesce(called, F.lit(False)) & (F.trim("inner") != "")
    texts = literal.where(called | shown).select(ROW, (F.col("at") + 1).alias("start"), F.length("inner").alias("len"), F.when(called, F.upper("inner")).otherwise(F.col("inner")).alias("value"), F.when(called & (F.col("before") == "COPY"), "Copybook").when(called, "Program").otherwise("StringLiteral").alias("category"), F.lit("").alias("head"))
    remarks = source.where((F.col("line_type") == "Comment") & (F.trim(F.substring("text", 8, 65)) != ""))
    n = F.when(F.length("text") <= 72, F.length("text") - 7).otherwise(65)
    remarks = remarks.select(F.col("doc_id").alias(ROW), (F.col("offset") + 7).cast("int").alias("start"), n.cast("int").alias("len"), F.lit("").alias("value"), F.lit("Comment").alias("category"), F.lit(f" {REMOVED}").alias("head"))
    return used.unionByName(texts).unionByName(remarks)
