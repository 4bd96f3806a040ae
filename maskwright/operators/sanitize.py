"""Detect, number, resolve, splice: the core of sanitizing, over a corpus of (doc_id, content)."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from maskwright.functions.naming import alias_of
from maskwright.functions.text import hits, unicode_pattern
from maskwright.operators.rules import Rule
from maskwright.sources.shared import written

SPAN = "struct<start:int,len:int,rule:int,value:string,prefix:string,rule_id:string>"
MATCH = "struct<start:int,len:int,value:string,alias:string,rule_id:string,line:int>"


def matches(text: Column, rules: list[Rule]) -> Column:
    """Spans of all rules, by rule and then by place; values in a rule's exceptions, in any case, are left out."""

    def of(i: int, r: Rule) -> Column:
        found = hits(text, unicode_pattern(r.pattern))
        if r.exceptions:
            found = F.filter(found, lambda m: ~F.lower(m["value"]).isin([e.lower() for e in r.exceptions]))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["len"].alias("len"), F.lit(i).alias("rule"), m["value"].alias("value"), F.lit(r.prefix).alias("prefix"), F.lit(r.rule_id).alias("rule_id")))

    return F.concat(*(of(i, r) for i, r in enumerate(rules))) if rules else F.array().cast(f"array<{SPAN}>")


def compiled(pattern: str):
    """The pattern in Python's dialect; by the regex package where the standard one lacks what it uses (look-behind of any length)."""
    import re

    try:
        return re.compile(pattern)
    except re.error:
        import regex

        return regex.compile(pattern)


def _python_matches(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32()), ("rule", pa.int32()), ("value", pa.string()), ("prefix", pa.string()), ("rule_id", pa.string())]))
    at, schema = docs.columns.index("content"), StructType(docs.schema.fields + StructType.fromDDL(f"spans array<{SPAN}>").fields)

    def run(it):
        each = [(i, compiled(r.pattern).finditer, {e.lower() for e in r.exceptions}, r.prefix, r.rule_id) for i, r in enumerate(rules)]
        for b in it:
            found = []
            for t in b.column(at).to_pylist():
                spans = []
                if t:
                    for i, finditer, skip, prefix, rule_id in each:
                        for m in finditer(t):
                            v = m[0]
                            if v and v.lower() not in skip:
                                spans.append((m.start(), len(v), i, v, prefix, rule_id))
                found.append(spans)
            flat = [s for x in found for s in x]
            cols = [pa.array([s[k] for s in flat], f.type) for k, f in enumerate(kind.value_type)]
            ends = [0]
            for x in found:
                ends.append(ends[-1] + len(x))
            spans = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*b.columns, spans], [*b.schema.names, "spans"])

    return docs.mapInArrow(run, schema)


def detected(docs: DataFrame, rules: list[Rule], native: bool = False) -> DataFrame:
    """docs with `spans`, by rule and then by place; none for null and empty contents.

    By default one Arrow pass tries all rules on a text, which took a tenth of the time of the same in expressions (native,
    the same spans): an expression has to match each rule three times to learn where its matches lie.
    """
    if not native:
        return _python_matches(docs, rules)
    return docs.withColumn("spans", F.when(F.length("content") > 0, matches(F.col("content"), rules)).otherwise(F.array().cast(f"array<{SPAN}>")))


def numbered(first: DataFrame, order: list[str], start: DataFrame | None = None) -> DataFrame:
    """first (value, prefix, and what it is ordered by) with n from 0 within each prefix, and alias.

    Values are dealt by ranges of (prefix, order), numbered within each part, and moved up by what the parts before hold:
    no prefix is ever numbered in one task. start: (prefix, taken) of numbers already given out.
    """
    spread = written(first.repartitionByRange("prefix", *order).sortWithinPartitions("prefix", *order).withColumn("part", F.spark_partition_id()), "first-seen")
    sizes = spread.groupBy("prefix", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("prefix").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.withColumn("base", before).drop("size")
    if start is not None:
        bases = bases.join(start, "prefix", "left").withColumn("base", F.col("base") + F.coalesce("taken", F.lit(0))).drop("taken")
    within = F.row_number().over(Window.partitionBy("part", "prefix").orderBy(*order)) - 1
    out = spread.withColumn("n", within).join(bases, ["prefix", "part"]).withColumn("n", (F.col("n") + F.col("base")).cast("long"))
    return out.withColumn("alias", alias_of(F.col("prefix"), F.col("n"))).drop("part", "base")


def first_seen(found: DataFrame) -> DataFrame:
    """Each value once, with the prefix that claims it first: by document, then rule, then place."""
    one = found.select("doc_id", F.explode("spans").alias("s"))
    first = one.groupBy(F.col("s.value").alias("value")).agg(F.min(F.struct("doc_id", F.col("s.rule").alias("rule"), F.col("s.start").alias("start"), F.col("s.prefix").alias("prefix"))).alias("f"))
    return first.select("value", "f.prefix", "f.doc_id", "f.rule", "f.start")


def dictionary(found: DataFrame) -> DataFrame:
    """(value, prefix, n, alias) of the corpus. Spans that lose to others take numbers too."""
    return numbered(first_seen(found), ["doc_id", "rule", "start"]).select("value", "prefix", "n", "alias")


def extended(found: DataFrame, known: DataFrame) -> DataFrame:
    """known and, after its numbers, the values of found that it lacks."""
    fresh = first_seen(found).join(known.select("value"), "value", "left_anti")
    taken = known.groupBy("prefix").agg((F.max("n") + 1).alias("taken"))
    return known.select("value", "prefix", "n", "alias").unionByName(numbered(fresh, ["doc_id", "rule", "start"], taken).select("value", "prefix", "n", "alias"))


#: the engine's own number of a row: doc_ids may be null or repeated
ROW = "__row"


def keyed(docs: DataFrame, name: str) -> DataFrame:
    """docs with ROW, from a written table, as a number worked out twice would not be the same."""
    return docs if ROW in docs.columns else written(docs.withColumn(ROW, F.monotonically_increasing_id()), name)


def applied(found: DataFrame, names: DataFrame) -> DataFrame:
    """found with `content` rewritten, `was_sanitized`, and `matches`: the spans kept (start, len, value, alias, rule_id, line).

    Aliases come by a join on the value, so the dictionary may be of any size (a value that is common beyond measure is a
    skewed join, which AQE splits); only spans move, and the contents once, by row, to meet theirs (a small side is
    broadcast by Catalyst). Null and repeated doc_ids are rows like any others.
    """
    found = keyed(found, "detected")
    spans = found.select(ROW, F.explode("spans").alias("s")).select(ROW, "s.*")
    named = spans.join(names.select("value", "alias"), "value")
    one = F.struct("start", (-F.col("len")).alias("neg"), "rule", "len", "value", "alias", "rule_id")
    per = named.groupBy(ROW).agg(F.array_sort(F.collect_list(one)).alias("__all"))
    return resolved(found.drop("spans").join(per, ROW, "left"), "__all").drop(ROW).withColumn("was_sanitized", F.size("matches") > 0)


def resolved(docs: DataFrame, spans: str) -> DataFrame:
    """docs with `content` rewritten and `matches`: of the spans (start, len, value, alias, rule_id and more; sorted by start, the
    longer first; null for none) those that do not overlap one kept before. The column of spans goes.

    One Arrow pass, linear in text and spans: a fold of expressions copies what it has at each span, which for a text of
    some megabytes would take hours.
    """
    at, where = docs.columns.index("content"), docs.columns.index(spans)
    rest = [k for k in range(len(docs.columns)) if k != where]
    schema = StructType([docs.schema[k] for k in rest] + StructType.fromDDL(f"matches array<{MATCH}>").fields)
    kind = [("start", pa.int32()), ("len", pa.int32()), ("value", pa.string()), ("alias", pa.string()), ("rule_id", pa.string()), ("line", pa.int32())]

    def run(it):
        for b in it:
            ends, all_ = b.column(where).offsets.to_pylist(), b.column(where).values
            starts, lens, values, aliases, ids = (all_.field(c).to_pylist() for c in ("start", "len", "value", "alias", "rule_id"))
            texts, kept, lines, upto = [], [], [], [0]
            for text, lo, hi in zip(b.column(at).to_pylist(), ends, ends[1:]):
                out, end, line = [], 0, 1
                for k in range(lo, hi):
                    a = starts[k]
                    if a >= end:
                        gap = text[end:a]
                        line += gap.count("\n")
                        out += (gap, aliases[k])
                        lines.append(line)
                        end = a + lens[k]
                        line += text.count("\n", a, end)
                        kept.append(k)
                texts.append("".join(out) + text[end:] if out else text)
                upto.append(len(kept))
            cols = [[c[k] for k in kept] for c in (starts, lens, values, aliases, ids)] + [lines]
            rows = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kind)], fields=[pa.field(n, t) for n, t in kind])
            new = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in rest]
            yield pa.RecordBatch.from_arrays([*new, pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows)], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def sanitized(docs: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """The rewritten corpus and its dictionary."""
    found = keyed(detected(docs, rules), "detected")
    names = written(dictionary(found), "dictionary")
    return applied(found, names), names


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
