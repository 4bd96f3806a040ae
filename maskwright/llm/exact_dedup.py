"""Exact dedup: equal texts are combined within tasks, then by salted digest, then over the salts, by whole content at each step.

A group of copies may hold any share of all rows. Each task first combines its own copies to one row a text; these meet
by (digest, text, salt), the salt being the task's, so a text that every task holds still goes to SALTS places; the winners
of the salts meet last, at most SALTS rows a text. Digest and text are keys together at every step, so two texts of one
digest never mix.

The way back takes no text along. A group that holds over one in SHARE of all rows is crowded; there are fewer than SHARE
such groups, whatever the input, and they go to their rows by broadcast. All other rows meet their group by a shuffled
join on the digest. Digests that several texts share, should there be any, are settled by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import finished, table, written

SALTS, SHARE = 64, 10_000


def normalized(text: Column) -> Column:
    """Every run of blanks, tabs and line ends as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def combined(rows: DataFrame, salts: int = SALTS) -> DataFrame:
    """(digest, text, keep_id, n): one row a text; keep_id is its smallest id that is not null, n its rows. rows: (digest, text, doc_id)."""
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    # the aggregate's first half runs in the task that reads the rows, where the salt is one value: copies there become one row
    by_salt = salted.groupBy("digest", "text", "salt").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return by_salt.groupBy("digest", "text").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def _placed(rows: DataFrame, groups: DataFrame, total: int, share: int) -> DataFrame:
    """rows with their group's columns, by digest."""
    crowded = groups.where(F.col("n") * share > total)  # under `share` rows: they hold more than 1 / share of all rows each
    near = rows.join(F.broadcast(crowded), "digest")
    cold = rows.join(F.broadcast(crowded.select("digest")), "digest", "left_anti")
    return near.unionByName(cold.join(groups.where(F.col("n") * share <= total), "digest"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256, salts: int = SALTS, share: int = SHARE, key: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, and the column `key` if one is named.

    Null texts equal empty and none but them; texts that differ in white space only within runs are equal, but a run at an end stays
    one space. Of equal texts the row with the smallest doc_id is kept, null ones last; of rows that also share it exactly one, any
    (the smallest `key`, if given). keep_id is null only where all of a group are. Other columns are not looked at.
    """
    # read twice: once with the texts, to combine them, and once for what is small of each row
    text = normalized(F.col(text_col))
    of = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *([F.col(key).alias("own")] if key else []))
    groups = combined(of.select(digest(F.col("text")).alias("digest"), "text", "doc_id"), salts)
    own = sha256(F.col("text"))
    found = written(groups.select("digest", F.when(own != F.col("digest"), own).alias("sha"), "keep_id", "n"), "groups")
    shared = written(found.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest"), "shared-digests")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    keep = ["own"] if key else []
    light = written(of.select("doc_id", digest(F.col("text")).alias("digest"), *keep), "digests")
    if shared.isEmpty():
        out = _placed(light, found, total, share).withColumn("place", F.col("digest"))
    else:
        lone = _placed(light.join(shared, "digest", "left_anti"), found.join(shared, "digest", "left_anti"), total, share).withColumn("place", F.col("digest"))
        mixed = of.withColumn("digest", digest(F.col("text"))).join(shared, "digest")
        again = combined(mixed.select("digest", "text", "doc_id"), salts).withColumn("sha", own)
        # the whole text is the key here; it also names the group
        several = mixed.join(again, ["digest", "text"]).select("digest", "doc_id", *keep, "sha", "keep_id", "n", F.concat("digest", "text").alias("place"))
        out = lone.unionByName(several)
    out = out.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.coalesce("sha", "digest").alias("text_sha256"), "place", *keep)
    out = written(out.withColumn("row", F.monotonically_increasing_id()), "placed")
    firsts = out.where("kept")
    if firsts.count() > found.count():  # some ids repeat within their group: one row of each is enough
        order = F.struct("own", "row") if key else F.struct("row")
        one = firsts.groupBy("place").agg(F.min(order).getField("row").alias("row")).select("row", F.lit(True).alias("one"))
        out = out.join(one, "row", "left").withColumn("kept", F.col("kept") & F.coalesce("one", F.lit(False)))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256", *([F.col("own").alias(key)] if key else []))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are: one of each text, as `classes` tells."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    rows = written(docs.toDF(*names).withColumn("key", F.monotonically_increasing_id()), "rows")
    stay = classes(rows, at[id_col], at[text_col], key="key").where("kept").select("key")
    return rows.join(stay, "key", "left_semi").select(*(F.col(c).alias(d) for d, c in at.items()))


#: over tables with unique doc_ids
ORACLE_SQL = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256 FROM n WINDOW w AS (PARTITION BY t)"""


def op12_salted_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: classes(table(spark, sf_dir, "documents")), "op12")
