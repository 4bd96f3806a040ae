"""COBOL and JCL sources as lines: column areas, line types, blocks, divisions, programs. Native windows over each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
JCL_KEYWORDS = ("JOB", "EXEC", "DD", "PROC", "PEND", "SET", "IF", "ENDIF", "ELSE", "INCLUDE", "JCLLIB", "OUTPUT", "COMMAND", "CNTL", "ENDCNTL", "EXPORT", "NOTIFY", "XMIT")
JCL_TYPES = {"JOB": "Job", "EXEC": "Exec", "DD": "Dd", "PROC": "Proc", "PEND": "Pend", "SET": "Set", "IF": "If", "ENDIF": "Endif", "INCLUDE": "Include", "JCLLIB": "Jcllib"}
SYSTEM_DDS = ("SYSPRINT", "SYSIN", "SYSOUT", "SYSUDUMP", "SYSABEND", "SYSDBOUT", "SYSDUMP", "SYSTSPRT", "STEPLIB", "JOBLIB", "SYSLIB", "SYSLMOD", "SYSUT1", "SYSUT2", "SYSUT3", "SYSUT4", "CEEDUMP", "SYSMDUMP", "SORTLIB", "DFHRPL", "SYSTSIN")
SYSTEM_SYMBOLS = ("&SYSUID", "&SYSDATE", "&SYSTIME", "&SYSJOBID", "&SYSSTEP", "&SYSNAME")
SQL_PROGRAMS = ("IKJEFT01", "DSNTEP2", "DSNTEP4", "DSNTIAD", "DSNUPROC", "IKJEFT1B")
NOT_PARAGRAPHS = ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE", "FD", "SD", "RD", "COPY", "REPLACE", "EXEC", "SELECT", "USE", "DECLARATIVES", "END")
LEVEL = r"^(0?[1-9]|[1-4]\d|66|77|88)\b"


def lines(docs: DataFrame, offsets: bool = False) -> DataFrame:
    """(doc_id, line_no from 1, text) of content, carriage returns at line ends dropped; with offsets also where each line begins."""
    if offsets:
        rows = docs.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text"))
        before = F.sum(F.length("text") + 1).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        return rows.select("doc_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("text", r"\r+$", "").alias("text"), F.coalesce(before, F.lit(0)).alias("offset"))
    return docs.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("at", "text")).select("doc_id", (F.col("at") + 1).alias("line_no"), F.regexp_replace("text", r"\r+$", "").alias("text"))


def cobol_areas(text: Column) -> dict[str, Column]:
    padded = F.when(F.length(text) < 80, F.rpad(text, 80, " ")).otherwise(text)
    return {
        "sequence_area": F.substring(padded, 1, 6), "indicator": F.substring(padded, 7, 1), "area_a": F.substring(padded, 8, 4), "area_b": F.substring(padded, 12, 61),
        "ident_area": F.when(F.length(text) > 72, F.substring(padded, 73, 8)).otherwise(""),
    }


def cobol_lines(docs: DataFrame, offsets: bool = False) -> DataFrame:
    """Lines with their areas, line_type, and the division they stand in.

    Lines from EXEC SQL or EXEC CICS to END-EXEC take the block's type; comments and blank lines keep theirs.
    """
    rows = lines(docs, offsets).withColumns(cobol_areas(F.col("text")))
    body = F.upper(F.trim(F.concat("area_a", "area_b")))
    first = F.upper(F.regexp_extract(F.ltrim("area_a"), r"^([\w-]+)", 1))
    kind = (
        F.when(F.col("indicator").isin("*", "/"), "Comment")
        .when(F.col("indicator") == "-", "Continuation")
        .when(body == "", "Blank")
        .when(body.rlike(r"^COPY(\s|$)"), "CopyStatement")
        .when(body.rlike(r"^EXEC\s+SQL\b"), "ExecSqlBlock")
        .when(body.rlike(r"^EXEC\s+CICS\b"), "ExecCicsBlock")
        .when(body.rlike(r"\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b"), "DivisionHeader")
        .when(body.rlike(r"\bSECTION\s*\.\s*$") | body.rlike(r"\b(WORKING-STORAGE|LINKAGE|FILE|LOCAL-STORAGE|COMMUNICATION|REPORT|SCREEN|INPUT-OUTPUT|CONFIGURATION)\s+SECTION\b"), "SectionHeader")
        .when(body.rlike(LEVEL), "DataDefinition")
        .when((first != "") & F.ltrim("area_a").rlike(r"^[\p{L}\p{N}]") & ~first.isin(*NOT_PARAGRAPHS) & ~F.contains(body, F.lit("DIVISION")) & ~F.contains(body, F.lit("SECTION")), "ParagraphHeader")
        .otherwise("ProcedureStatement")
    )
    rows = rows.withColumn("body", body).withColumn("own_type", kind)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    live = ~F.col("own_type").isin("Comment", "Blank")
    # a block opens where one begins without ending on its line, and is over after the next END-EXEC
    opens = F.when(live & F.col("own_type").isin("ExecSqlBlock", "ExecCicsBlock") & ~F.contains("body", F.lit("END-EXEC")), F.col("own_type"))
    closes = F.when(live & F.contains("body", F.lit("END-EXEC")), F.lit("closed"))
    state = F.last(F.coalesce(closes, opens), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    inside = F.when(state.isin("ExecSqlBlock", "ExecCicsBlock"), state)
    rows = rows.withColumn("__in", inside).withColumn("line_type", F.when(live & F.col("__in").isNotNull(), F.col("__in")).otherwise(F.col("own_type")))
    name = F.when(F.col("line_type") == "DivisionHeader", F.regexp_extract("body", r"\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b", 1))
    return rows.withColumn("division", F.last(name, ignorenulls=True).over(w)).drop("__in", "own_type", "body")


def cobol_names(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, value, category) of what COBOL lines declare; FILLER and level-number clauses name nothing."""
    return names_of_lines(cobol_lines(docs))


def names_of_lines(rows: DataFrame) -> DataFrame:
    """cobol_names of rows of cobol_lines."""
    w = Window.partitionBy("doc_id").orderBy("line_no")
    body = F.upper(F.trim(F.concat("area_a", "area_b")))
    fd = F.regexp_extract(body, r"^[FS]D\s+([A-Z0-9][A-Z0-9-]*)", 1)
    rows = rows.withColumn("body", body).withColumn("fd", F.when(fd != "", fd))
    under = F.last(F.when(F.col("line_type") == "SectionHeader", F.lit("")).otherwise(F.col("fd")), ignorenulls=True).over(w)
    rows = rows.withColumn("under", under)
    level = F.regexp_extract("body", r"^(\d{1,2})\s", 1)
    item = F.regexp_extract("body", r"^\d{1,2}\s+([A-Z0-9][A-Z0-9-]*)", 1)
    kinds = (
        (F.col("body").rlike(r"^PROGRAM-ID"), F.regexp_extract("body", r"^PROGRAM-ID\s*\.?\s+([A-Z0-9][A-Z0-9-]*)", 1), F.lit("Program")),
        (F.col("fd").isNotNull(), F.col("fd"), F.lit("CobolFile")),
        (F.col("line_type") == "CopyStatement", F.regexp_extract("body", r"^COPY\s+['\"]?([A-Z0-9][A-Z0-9-]*)", 1), F.lit("Copybook")),
        ((F.col("line_type") == "DataDefinition") & (item != "FILLER") & ~item.isin("PIC", "REDEFINES", "VALUE"), item, F.when(level == "88", "Condition").when(level.isin("01", "1") & (F.coalesce("under", F.lit("")) != ""), "CobolRecord").otherwise("Variable")),
        ((F.col("line_type") == "ParagraphHeader") & (F.col("division") == "PROCEDURE"), F.regexp_extract("body", r"^([A-Z0-9][A-Z0-9-]*)", 1), F.lit("Paragraph")),
        ((F.col("line_type") == "SectionHeader") & (F.col("division") == "PROCEDURE"), F.regexp_extract("body", r"^([A-Z0-9][A-Z0-9-]*)\s+SECTION", 1), F.lit("Section")),
        (F.col("body").rlike(r"\bCALL\s+['\"]"), F.regexp_extract("body", r"\bCALL\s+['\"]([A-Z0-9][A-Z0-9-]*)", 1), F.lit("Program")),
        (F.col("line_type") == "ExecSqlBlock", F.regexp_extract("body", r":([A-Z][A-Z0-9_-]*)", 1), F.lit("HostVariable")),
    )
    found = F.array(*(F.struct(F.when(ok, v).alias("value"), c.alias("category")) for ok, v, c in kinds))
    return rows.select("doc_id", "line_no", F.explode(F.filter(found, lambda x: x["value"] != "")).alias("x")).select("doc_id", "line_no", "x.value", "x.category")


def jcl_lines(docs: DataFrame) -> DataFrame:
    """Lines with name, operation, operands, line_type, in-stream data marked, and the program of the last EXEC before them."""
    rows = lines(docs)
    t, body = F.col("text"), F.substring(F.col("text"), 3, 1 << 20)
    bare = F.startswith(body, F.lit(" "))
    rest = F.when(bare, F.ltrim(body)).otherwise(F.ltrim(F.regexp_replace(body, r"^\S+", "")))
    word, after = F.regexp_extract(rest, r"^(\S+)", 1), F.ltrim(F.regexp_replace(rest, r"^\S+", ""))
    card = t.startswith("//") & ~t.startswith("//*") & (F.length(t) > 2)
    keyword = F.upper(word).isin(*JCL_KEYWORDS)
    operation = F.when(card & (~bare & (word != "") | bare & keyword), F.upper(word))
    kinds = F.create_map(*[F.lit(x) for p in JCL_TYPES.items() for x in p])
    rows = rows.withColumns({
        "name": F.when(card & ~bare, F.regexp_extract(body, r"^(\S+)", 1)),
        "operation": operation,
        "operands": F.when(card, F.when(operation.isNotNull(), F.nullif(after, F.lit(""))).when(bare, F.nullif(rest, F.lit("")))),
        "own_type": F.when(t.startswith("//*"), "Comment").when((t == "//") | t.startswith("//") & (F.trim(body) == ""), "Null").when(t == "/*", "Delimiter")
        .when(operation.isNotNull(), F.coalesce(F.try_element_at(kinds, operation), F.lit("Unknown"))).otherwise("Unknown"),
    })
    w = Window.partitionBy("doc_id").orderBy("line_no")
    o = F.trim("operands")
    starts = (F.col("own_type") == "Dd") & ((o == "*") | o.startswith("*,") | o.startswith("* ") | F.upper(o).startswith("DATA"))
    # data run from a DD * or DD DATA card to a delimiter or the next card; DLM= names another delimiter
    dlm = F.when(starts, F.regexp_extract("operands", r"(?i)DLM=(.{2})", 1))
    mark = F.last(dlm, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ends = F.when(mark != "", F.startswith("text", mark)).otherwise((F.col("own_type") == "Delimiter") | t.startswith("//"))
    event = F.when(F.coalesce(starts, F.lit(False)), "in").when(F.coalesce(ends, F.lit(False)), "out")
    rows = rows.withColumn("__event", event).withColumn("__state", F.last("__event", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("instream", F.coalesce((F.col("__state") == "in") & F.col("__event").isNull(), F.lit(False)))
    live = F.when(~F.col("instream") & ~F.col("own_type").isin("Comment"), F.coalesce("operands", F.lit("")))
    before = F.last(live, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    continues = (F.col("own_type") == "Unknown") & t.startswith("// ") & F.coalesce(F.rtrim(before).endswith(","), F.lit(False))
    rows = rows.withColumn("line_type", F.when(F.col("instream"), "Instream").when(continues, "Continuation").otherwise(F.col("own_type")))
    pgm = F.when((F.col("line_type") == "Exec") & F.col("operands").isNotNull(), F.upper(F.regexp_extract("operands", r"(?i)PGM=([A-Z0-9@#$]+)", 1)))
    rows = rows.withColumn("program", F.nullif(F.last(pgm, ignorenulls=True).over(w), F.lit("")))
    return rows.withColumn("instream_sql", F.col("instream") & F.coalesce(F.col("program").isin(*SQL_PROGRAMS), F.lit(False))).drop("own_type", "__event", "__state")


def jcl_names(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, value, category) of what JCL cards declare and name; system DD names and symbols are left out."""
    rows = jcl_lines(docs).where("line_type not in ('Comment', 'Instream', 'Null', 'Delimiter')")
    n, kind, o = F.col("name"), F.col("line_type"), F.coalesce("operands", F.lit(""))

    def tag(values: Column, category: str) -> Column:
        return F.transform(values, lambda v: F.struct(v.alias("value"), F.lit(category).alias("category")))

    named = F.when(kind == "Job", "Job").when(kind == "Exec", "Step").when((kind == "Dd") & ~F.upper(n).isin(*SYSTEM_DDS) & ~n.rlike(r"(?i)^SORTWK\d{1,2}$"), "DDName").when(kind == "Proc", "Proc")
    own = F.when(named.isNotNull() & n.isNotNull(), F.array(F.struct(n.alias("value"), named.alias("category")))).otherwise(F.array().cast("array<struct<value:string,category:string>>"))
    symbols = F.filter(F.regexp_extract_all(o, F.lit(r"(&[A-Z0-9@#$]+)"), F.lit(1)), lambda s: ~F.upper(s).isin(*SYSTEM_SYMBOLS))
    found = F.concat(
        own,
        tag(F.regexp_extract_all(o, F.lit(r"(?i)\bPGM=([A-Z0-9@#$]+)"), F.lit(1)), "Program"),
        tag(F.regexp_extract_all(o, F.lit(r"(?i)\b(?:DSN|DSNAME)=([A-Z0-9@#$.&]+)"), F.lit(1)), "Dataset"),
        tag(F.regexp_extract_all(o, F.lit(r"(?i)\bMEMBER=([A-Z0-9@#$]+)"), F.lit(1)), "Include"),
        tag(symbols, "Symbol"),
    )
    return rows.select("doc_id", "line_no", F.explode(found).alias("x")).select("doc_id", "line_no", "x.value", "x.category")


def cross_references(docs: DataFrame) -> DataFrame:
    """(value, source_language, target_language, n): programs that JCL runs, a COBOL program being the target."""
    pgm = jcl_names(docs).where("category = 'Program'")
    return pgm.groupBy("value").agg(F.count("*").alias("n")).select("value", F.lit("jcl").alias("source_language"), F.lit("cobol").alias("target_language"), "n")


def host_references(docs: DataFrame) -> DataFrame:
    """(value, source_language, target_language, n): host variables of EXEC SQL blocks, records and fields apart; names in upper case."""
    rows = cobol_lines(docs).where("line_type = 'ExecSqlBlock'").select(F.upper(F.concat("area_a", "area_b")).alias("body"))
    used = rows.select(F.explode(F.regexp_extract_all("body", F.lit(r":([A-Z][A-Z0-9_-]*(?:\.[A-Z][A-Z0-9_-]*)?)"), F.lit(1))).alias("used"))
    parts = used.select(F.explode(F.split("used", r"\.")).alias("value"))
    return parts.groupBy("value").agg(F.count("*").alias("n")).select("value", F.lit("cobol").alias("source_language"), F.lit("sql").alias("target_language"), "n")
