"""Level 2 over a corpus: spans of every language, one dictionary, texts spliced.

Python runs in Arrow batches, one document at a time; nothing is shared between documents but the dictionary, which is
computed by aggregation like that of the rules.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.naming import prefix_of
from maskwright.functions.text import is_number_like
from maskwright.operators.languages import cards, cobol, mainframe, relation
from maskwright.operators.languages.tokens import KNOWN_BY_FAMILY, REMOVED, code_spans, local_places
from maskwright.operators.sanitize import ROW, keyed, numbered, resolved, union_all
from maskwright.operators.scope import delegation_only, in_scope, processor_of
from maskwright.sources.shared import by_key, written

SPANS = "__row long, doc_id long, start int, len int, value string, category string, family string, head string, tail string"
#: languages whose files share the names they declare, and what is local to a routine
FAMILIES = {"csharp": "dotnet", "vbnet": "dotnet", "fsharp": "dotnet"}
LOCAL = ("Variable", "Parameter")


#: category of a place that declares a local name; no span of its own
LOCAL_PLACE = "LocalPlace"


def parsed(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(ROW, masked, found): of sources in the given languages the text without comments and literals, and both as (start, len, kind,
    text). docs: (ROW, processor, content)."""
    out = []
    for language in languages:
        rows = relation.tokens(docs.where(F.col("processor") == language), language)
        taken = F.col("kind").isin("comment", "literal")
        shown = F.when(taken, F.regexp_replace("text", r"[^\n]", " ")).otherwise(F.col("text"))
        one = F.struct("place", shown.alias("shown"), F.when(taken, F.struct("start", "len", "kind", "text")).alias("taken"))
        per = rows.groupBy(ROW).agg(F.array_sort(F.collect_list(one)).alias("all"))
        out.append(per.select(ROW, F.array_join(F.col("all.shown"), "").alias("masked"), F.filter(F.col("all.taken"), lambda t: t.isNotNull()).alias("found")))
    return union_all(out)


def sql_spans(docs: DataFrame) -> DataFrame:
    """SPANS of the comments and literals of SQL sources. docs: (ROW, doc_id, processor, found)."""
    one = docs.where(F.col("processor").isin(*relation.SQL)).select(ROW, F.col("doc_id").cast("long").alias("doc_id"), F.col("processor").alias("family"), F.explode("found").alias("t")).select(ROW, "doc_id", "family", "t.*")
    block = F.startswith("text", F.lit("/*"))
    comments = one.where("kind = 'comment'").select(ROW, "doc_id", "start", "len", F.lit("").alias("value"), F.lit("Comment").alias("category"), "family", F.when(block, f"/* {REMOVED} */").otherwise(f"-- {REMOVED}").alias("head"), F.lit("").alias("tail"))
    special = F.col("text").rlike(r"^[nN]?[qQ]'")
    mark = F.when(special, F.length(F.regexp_extract("text", r"^([nN]?)", 1)) + 3).otherwise(F.length(F.regexp_extract("text", r"^([nN]?)", 1)) + 1)
    end = F.when(special, 2).otherwise(1)
    said = one.where((F.col("kind") == "literal") & relation.closed(F.col("text"), F.col("kind"))).withColumns({"mark": mark, "end": end})
    said = said.withColumn("value", F.expr("substring(text, mark + 1, len - mark - end)")).where((F.trim("value") != "") & ~F.col("value").rlike(r"^\s*$") & ~is_number_like(F.col("value")))
    literals = said.select(ROW, "doc_id", "start", "len", "value", F.lit("StringLiteral").alias("category"), "family", F.expr("substring(text, 1, mark)").alias("head"), F.expr("substring(text, len - end + 1, end)").alias("tail"))
    return comments.unionByName(literals)


def code_frames(docs: DataFrame) -> DataFrame:
    """Spans of (ROW, doc_id, processor, content, masked); see mainframe.spans for processors with a detail. masked is what `parsed`
    made of the text, if it did; then comments and literals of SQL sources are not among the spans."""

    def spans_of(text, processor, masked):
        if processor == "cobol":  # its own words are found by cobol.spans
            return mainframe.spans(text, "cobol:sql") if "exec" in text.lower() else []
        if masked is None or processor not in (*relation.SQL, "csharp"):
            return mainframe.spans(text, processor)
        if processor == "csharp":
            return mainframe.spans(text, processor) + [(a, 0, name, LOCAL_PLACE, "", "") for a, name in local_places(masked, processor)]
        return code_spans(text, processor, masked)

    def run(it):
        names = [x.split()[0] for x in SPANS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5]
        for b in it:
            rows = [(r, d, *s[:4], FAMILIES.get(p, p), *s[4:]) for r, d, p, c, m in zip(*(col.to_pylist() for col in b.columns)) for s in spans_of(c or "", p or "", m)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select(ROW, F.col("doc_id").cast("long").alias("doc_id"), "processor", "content", "masked").mapInArrow(run, SPANS)


def detailed(processor: Column, content: Column, scope: set[str] | None) -> Column:
    """The processor with what it needs to know: a card's type, or that only embedded SQL is in scope; null if nothing is."""
    embedded = F.lit(scope is not None and "tsql" in scope) & delegation_only(processor, scope) & processor.isin("cobol", "jcl")
    mine = F.when(processor == "mainframe-utility", F.concat(processor, F.lit(":"), cards.card_type(content))).otherwise(processor)
    return F.when(embedded, F.concat(processor, F.lit(":sql"))).when(in_scope(processor, scope), mine)


def obfuscated(docs: DataFrame, scope: set[str] | None = None, fix_dispatch: bool = False, fixed_width: bool = False) -> tuple[DataFrame, DataFrame]:
    """Level 2 over (doc_id, path, content): names, literals and comments by language; the rewritten corpus and its dictionary.

    Documents out of scope or without a processor stay as they are, but for the SQL embedded in COBOL and JCL. A name that
    another file declares is rewritten where it is used: in .NET languages types, members and namespaces of any of them,
    in the others names of the same language, in mainframe sources any name. Uses of names that no document declares stay.
    fixed_width puts COBOL and JCL lines back in their columns. `replacements` counts spans; `code_matches` lists them like
    `matches`, with the category as rule_id and places in the original text.
    """
    out, names, _ = rewritten(docs, scope, fix_dispatch, fixed_width)
    return out, names


def rewritten(docs: DataFrame, scope: set[str] | None = None, fix_dispatch: bool = False, fixed_width: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As obfuscated, and the names that each document declares: (doc_id, path, value, alias, category)."""
    d = keyed(docs.withColumn("processor", processor_of(F.col("path"), F.col("content"), fix_dispatch)), "sources")
    asked = d.withColumn("processor", detailed(F.col("processor"), F.col("content"), scope)).where("processor is not null")
    here = {r[0] for r in asked.select("processor").distinct().collect()}  # no more than there are processors and cards
    if lexed := [x for x in (*relation.SQL, "csharp") if x in here]:
        asked = asked.join(by_key(written(parsed(asked.select(ROW, "processor", "content"), lexed), "lexed")), ROW, "left")
        spans = written(sql_spans(asked).unionByName(code_frames(asked)), "code-spans")
    else:
        spans = written(code_frames(asked.withColumn("masked", F.lit(None).cast("string"))), "code-spans")
    if "cobol" in here:
        own = cobol.spans(written(asked.where("processor = 'cobol'").select(ROW, "content"), "cobol"))
        own = own.join(by_key(asked.select(ROW, F.col("doc_id").cast("long").alias("doc_id"))), ROW).withColumns({"family": F.lit("cobol"), "tail": F.lit("")})
        spans = written(spans.unionByName(own.select(*spans.columns)), "code-spans")
    spans = bound(spans, asked) if "csharp" in here else spans
    declared = spans.where(~F.col("category").isin("Comment", mainframe.KNOWN, KNOWN_BY_FAMILY))
    first = declared.groupBy("value").agg(F.min(F.struct("doc_id", "start", "category")).alias("f"))
    names = numbered(first.select("value", prefix_of(F.col("f.category")).alias("prefix"), "f.doc_id", "f.start", "f.category"), ["doc_id", "start"])
    names = written(names.select("value", "prefix", "n", "alias", "category"), "dictionary")
    shared = declared.where(~F.col("category").isin(*LOCAL) | (F.col("family") != "dotnet")).select("value", "family").distinct().withColumn("__shared", F.lit(True))
    both = spans.join(names.select("value", "alias"), "value", "left").join(shared, ["value", "family"], "left")
    both = both.where((F.col("category") == "Comment") | (F.col("alias").isNotNull() & ((F.col("category") != KNOWN_BY_FAMILY) | F.col("__shared"))))
    one = F.struct("start", (-F.col("len")).alias("neg"), "len", F.concat("head", F.coalesce("alias", F.lit("")), "tail").alias("alias"), "value", F.col("category").alias("rule_id"))
    per = by_key(both.groupBy(ROW).agg(F.array_sort(F.collect_list(one)).alias("__all")))
    put = resolved(d.withColumn("__old", F.col("content")).join(per, ROW, "left") if fixed_width else d.join(per, ROW, "left"), "__all")
    out = put.withColumn("replacements", F.size("matches")).withColumnRenamed("matches", "code_matches").drop(ROW)
    types = declared.select(ROW, "value", "category").distinct().join(names.select("value", "alias"), "value").join(by_key(d.select(ROW, "doc_id", "path")), ROW).select("doc_id", "path", "value", "alias", "category")
    return (_refitted(out).drop("__old") if fixed_width else out), names, types


def bound(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans without the places of declarations; in C# a parameter's or variable's name counts only where a block around it declares
    it, and is a mere use elsewhere (a member of the same name, say, which counts if any file declares it).

    Declarations and uses are placed in blocks by their offsets; see relation.bound_uses.
    """
    places = spans.where(F.col("category") == LOCAL_PLACE).select(ROW, F.col("start").alias("place"), "value")
    rest = spans.where(F.col("category") != LOCAL_PLACE)
    local = F.col("category").isin(*LOCAL) & (F.col("family") == "dotnet")
    blocks = relation.brace_blocks(relation.tokens(docs.where("processor = 'csharp'").select(ROW, "content"), "csharp"), "start")
    named = rest.where(local).join(by_key(docs.where("processor = 'csharp'").select(ROW)), ROW, "left_semi")
    seen = relation.bound_uses(places, named.select(ROW, F.col("start").alias("place"), "value"), blocks)
    lost = written(named.select(ROW, "start", "value").join(by_key(seen.select(ROW, F.col("place").alias("start"), "value")), [ROW, "start", "value"], "left_anti").withColumn("__lost", F.lit(True)), "unbound")
    out = rest.join(by_key(lost), [ROW, "start", "value"], "left").withColumn("category", F.when(F.col("__lost") & local, KNOWN_BY_FAMILY).otherwise(F.col("category")))
    return written(out.drop("__lost").select(*spans.columns), "bound-spans")


def _refitted(docs: DataFrame) -> DataFrame:
    at = [docs.columns.index(c) for c in ("__old", "content", "processor")]

    def run(it):
        for b in it:
            texts = [mainframe.refitted(o, n, p) if o is not None and p else n for o, n, p in zip(*(b.column(k).to_pylist() for k in at))]
            yield b.set_column(at[1], "content", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
