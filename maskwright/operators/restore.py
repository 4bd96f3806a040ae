"""Put originals back, and report aliases that no dictionary entry explains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.operators.rules import Rule
from maskwright.operators.sanitize import ROW, detected, keyed, resolved
from maskwright.sources.shared import written

ALIAS = r"\b[A-Z]+_\d+\b"


def unmatched(text: Column, known: Column | None = None) -> Column:
    """Distinct alias-like words of the text, without those in `known`."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(ALIAS), F.lit(0)))
    return F.array_except(found, known) if known is not None else found


def restored(docs: DataFrame, names: DataFrame) -> DataFrame:
    """docs with `content` restored, `was_restored`, `replacements` and `unmatched`. Null and repeated doc_ids are rows like any others.

    One pass replaces whole words only, so IP_1 never touches IP_10, and originals are put in literally. Originals that
    hold aliases themselves are restored by further passes, until a pass finds nothing. A chain of such originals is no
    longer than there are of them; one that goes on beyond has come round to itself, which is an error.
    """
    now = keyed(docs.withColumn("replacements", F.lit(0)).withColumn("__open", F.lit(True)), "to-restore")
    # only originals that hold an alias can call for another pass; each is then written, so that none is computed twice
    links = names.where(F.col("value").rlike(ALIAS)).count()
    passes = 0
    while True:
        now = written(_pass(now, names), "restored") if links else _pass(now, names)
        passes += 1
        if not links or now.where("__open").isEmpty():
            break
        if passes > links + 1:
            raise ValueError("the dictionary holds aliases whose originals lead back to them")
    left = now.select(ROW, F.explode(unmatched(F.col("content"))).alias("alias")).join(names.select("alias"), "alias", "left_anti")
    per = left.groupBy(ROW).agg(F.array_sort(F.collect_set("alias")).alias("unmatched"))
    out = now.drop("__open").join(per, ROW, "left").drop(ROW)
    return out.withColumn("was_restored", F.col("replacements") > 0).withColumn("unmatched", F.coalesce("unmatched", F.array().cast("array<string>")))


def _pass(docs: DataFrame, names: DataFrame) -> DataFrame:
    found = detected(docs.where("__open").select(ROW, "content"), [Rule("alias", ALIAS, "")])
    words = found.select(ROW, F.explode("spans").alias("s")).select(ROW, "s.start", "s.len", F.col("s.value").alias("alias"))
    known = words.join(names.select("alias", "value"), "alias").select(ROW, "start", "len", F.col("value").alias("alias"), F.col("alias").alias("value"), F.lit("").alias("rule_id"))
    per = known.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "len", "alias", "value", "rule_id"))).alias("__spans"))
    out = resolved(docs.join(per, ROW, "left"), "__spans")
    return out.withColumn("replacements", F.col("replacements") + F.size("matches")).withColumn("__open", F.size("matches") > 0).drop("matches")
