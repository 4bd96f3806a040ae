"""Reports: statistics, cross-references, source map, status, leakage, severities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.sanitize import ROW, keyed
from maskwright.sources.shared import by_key, written


def stats(result: DataFrame, names: DataFrame) -> DataFrame:
    """One row: documents in all, rewritten, untouched; replacements; values in the dictionary (those of losing spans too)."""
    per = result.agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(F.col("was_sanitized").cast("long")), F.lit(0)).alias("processed_files"),
        F.coalesce(F.sum((~F.col("was_sanitized")).cast("long")), F.lit(0)).alias("skipped_files"),
        F.coalesce(F.sum(replacements(result)), F.lit(0)).alias("total_replacements"),
    )
    return per.crossJoin(names.agg(F.count("*").alias("unique_values")))  # one row each


def replacements(result: DataFrame) -> Column:
    """Replacements of a row at both levels, comments included."""
    return sum((F.size(c).cast("long") for c in ("matches", "code_matches") if c in result.columns), F.lit(0).cast("long"))


def occurrences(result: DataFrame) -> DataFrame:
    """What was replaced, where: (doc_id, start, len, value, alias, rule_id, line). Of level 2 too, without comments, which have no
    value; there rule_id is the category, and places are those of the original text."""
    out = result.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.*")
    if "code_matches" not in result.columns:
        return out
    code = result.select("doc_id", F.explode("code_matches").alias("m")).select("doc_id", "m.*").where("value <> ''")
    return out.unionByName(code.withColumn("alias", F.regexp_extract("alias", r"[A-Z0-9]+_\d+", 0)))


def source_map(result: DataFrame) -> DataFrame:
    """One row for each value: (value, alias, rule_id of the first place, n, first: doc_id, line, start, end). `locations` has all places."""
    one = occurrences(result).withColumn("at", F.struct("doc_id", "line", "start", (F.col("start") + F.col("len")).alias("end")))
    return one.groupBy("value", "alias").agg(F.min_by("rule_id", "at").alias("rule_id"), F.count("*").alias("n"), F.min("at").alias("first"))


def locations(result: DataFrame) -> DataFrame:
    """All places of all values as rows, so a common value fills no row: (value, alias, rule_id, doc_id, line, start, end)."""
    return occurrences(result).select("value", "alias", "rule_id", "doc_id", "line", "start", (F.col("start") + F.col("len")).alias("end"))


def xref(names: DataFrame, result: DataFrame) -> DataFrame:
    """Alias, original and how often it was replaced, by alias."""
    n = occurrences(result).groupBy("value").agg(F.count("*").alias("occurrences"))
    return names.join(n, "value", "left").select("alias", "value", F.coalesce("occurrences", F.lit(0)).alias("occurrences")).orderBy("alias")


def status(names: DataFrame, k: int = 10) -> DataFrame:
    return names.select("alias", "value").orderBy("alias").limit(k)


def leaks(result: DataFrame, original: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, value): values that were replaced in a document and still occur there as whole words. Must be empty.

    Each document is only searched for what was found in it: a join by doc_id, never every value against every document.
    """
    seen = occurrences(result).select("doc_id", "value").distinct()
    both = seen.join(result.select("doc_id", "content"), "doc_id")
    return both.where(F.contains("content", "value")).select("doc_id", "value")


def leaked_names(result: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, value): words of any document that are values of the dictionary, of at least `least` characters and one word each.

    Every word of every document meets the dictionary by equality, so a name that one file hides and another shows is seen.
    """
    words = result.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))).alias("value"))
    return words.join(names.where(F.length("value") >= least).select("value").distinct(), "value").select("doc_id", "value")


#: a word, and what may not stand beside a value that begins or ends with one
_WORD, _EDGE = r"[\p{L}\p{N}_]+", r"[\p{L}\p{N}_]"


def leak_search(result: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, value): values of the dictionary, of at least `least` characters, that stand in any document of result, wherever else they were
    replaced: names, literals of several words, e-mails, paths. A value counts where its first and last word are whole words.

    Each value is looked up by its rarest word over all documents: these words meet the documents' words by equality, and
    only such pairs are verified by the text. Values without a letter or digit have no word and are not searched. A value of
    which some word stands nowhere costs nothing. Null contents hold nothing; repeated and null doc_ids are found like others.
    """
    docs = keyed(result.select("doc_id", "content"), "searched")
    words = written(docs.select(ROW, F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(_WORD), F.lit(0)))).alias("word")), "words")
    known = names.select("value").distinct().where(F.length("value") >= least)
    parts = known.select("value", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(_WORD), F.lit(0)))).alias("word"))
    # counts of the words that values have alone
    counts = words.join(parts.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("docs"))
    anchors = written(parts.join(counts, "word", "left").groupBy("value").agg(F.min_by("word", F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word")).alias("word")), "anchors")
    pairs = words.join(anchors, "word")
    alone = pairs.where(F.col("value") == F.col("word")).select(ROW, "value")
    rest = pairs.where(F.col("value") != F.col("word")).join(by_key(docs.select(ROW, "content")), ROW).where(F.contains("content", "value"))
    quoted = F.concat(F.lit("\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    side = lambda near, look: F.when(near.rlike(_EDGE), look).otherwise("")
    bounded = F.concat(side(F.substring("value", 1, 1), f"(?<!{_EDGE})"), quoted, side(F.expr("right(value, 1)"), f"(?!{_EDGE})"))
    found = alone.unionByName(rest.where(F.regexp_like("content", bounded)).select(ROW, "value"))
    return found.join(by_key(docs.select(ROW, "doc_id")), ROW).select("doc_id", "value")


def file_counts(result: DataFrame) -> DataFrame:
    return result.select("doc_id", replacements(result).alias("replacements"))


def by_severity(result: DataFrame, rules: DataFrame) -> DataFrame:
    """Replacements by severity and rule, with subtotals (an extension)."""
    r = rules.select("rule_id", "severity")
    return occurrences(result).join(F.broadcast(r), "rule_id").rollup("severity", "rule_id").agg(F.count("*").alias("n"))


def xref_lines(names: DataFrame, result: DataFrame) -> DataFrame:
    """The cross-reference as a Markdown table: (n, line) in order, numbered by a range-sorted pass, never in one task."""
    rows = xref(names, result).select("alias", F.concat(F.lit("| "), "alias", F.lit(" | "), F.replace(F.regexp_replace("value", r"\s+", " "), F.lit("|"), F.lit("\\|")), F.lit(" | "), F.col("occurrences").cast("string"), F.lit(" |")).alias("line"))
    head = names.sparkSession.createDataFrame([("", "| Alias | Original | Occurrences |"), (" ", "|---|---|---|")], "alias string, line string")
    return head.unionByName(rows).orderBy("alias").select("line")
