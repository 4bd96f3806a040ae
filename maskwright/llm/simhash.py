"""SimHash near-duplicates: fingerprints within a Hamming distance, found by deletion-variant signatures.

With at most 4 differing bits and 3 segments, some segment differs in at most one bit. Each distinct fingerprint is
indexed under each segment with each of its bits left out (one-wildcard variants): two segments that differ in at most
one bit agree on a variant. Rows of a variant meet by equality and their whole fingerprints are compared. Of a variant's
links only a spanning forest is kept, which joins the same components: a linked fingerprint is taken out of the list of
those still to be reached, so a crowd of near copies is walked in about as many steps as it has members, not pairs.
A variant of more than CROWD fingerprints is dealt by their hash into tiles, and each pair of tiles meets in a group of its
own. Which variants are so crowded is learned from the fingerprints whose hash one in SHARE has; that only lays out
the work: tiled or not, every two fingerprints of a variant meet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded, components, finished, table, texts, tidy, written
from .words import parts

DISTANCE, SHINGLE, SEED, CROWD, SHARE = 4, 4, 42, 16_384, 16


def segments(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(first bit, bits): as few segments of 64 bits as make one of them differ in at most one bit."""
    k = distance // 2 + 1
    cuts = [64 * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def text_fingerprints(texts: list[str | None], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text; 0 for null, empty and blank ones."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        words = (t or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        norm = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        if len(words) <= shingle:
            h = [digest(norm, seed)]
        else:
            starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
            h = [digest(norm[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        h = np.array(h, np.uint64)
        n = np.zeros(64, np.int64)
        for lo in range(0, len(h), 1 << 15):
            n += np.unpackbits(h[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * n > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every whole text."""

    def run(it):
        for b in it:
            for some in parts(b):
                fp = text_fingerprints(some.column(1).to_pylist(), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, fp long")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what any links of at most `distance` bits among fps join."""
    left, out = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def group_links(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal keys (sorted)."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    a, b = [], []
    small = (size > 1) & (size <= 16)
    for d in range(1, 16):
        starts, n = first[small & (size > d)], size[small & (size > d)] - d
        if not len(starts):
            break
        i = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near = np.bitwise_count(fps[i] ^ fps[i + d]) <= distance
        a.append(fps[i[near]])
        b.append(fps[i[near] + d])
    for s, n in zip(first[size > 16], size[size > 16]):
        if links := _forest(fps[s : s + n], distance):
            x = np.array(links, np.uint64)
            a.append(x[:, 0])
            b.append(x[:, 1])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links(prints: DataFrame, distance: int = DISTANCE, crowd: int = CROWD, share: int = SHARE) -> DataFrame:
    """(a, b): links among distinct fingerprints (column fp) that join the same components as all of them do."""
    variants = []
    for s, (lo, bits) in enumerate(segments(distance)):
        for i in range(bits):
            mask = ((1 << bits) - 1) << lo & ~(1 << lo + i)
            mask -= (1 << 64) if mask >= 1 << 63 else 0
            kept = F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(mask)), lo)
            variants.append(kept.bitwiseOR(F.lit((s * 64 + i) << 48)) if bits <= 48 else F.xxhash64(F.lit(s * 64 + i), kept))

    def run(it):
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k, f):
            a, b = group_links(k, f, distance)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in np.ascontiguousarray(pairs)], ["a", "b"])

        for batch in it:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys) > 200_000 and keys[-1] != keys[0]:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                yield out(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield out(keys, fps)

    rows = prints.select(F.explode(F.array(*variants)).alias("key"), "fp")
    # a few rows for each CROWD fingerprints at most
    some = prints.where(F.pmod(F.xxhash64("fp"), F.lit(share)) == 0).select(F.explode(F.array(*variants)).alias("key"))
    crowded = written(some.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * share > crowd).select("key", F.ceil(F.col("n") * share * 2 / crowd).cast("int").alias("tiles")), "crowded")
    if not crowded.isEmpty():
        both = rows.join(crowded, "key", "left")
        mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int")
        pair = lambda t: F.xxhash64("key", F.least(mine, t), F.greatest(mine, t))
        keys = F.when(F.col("tiles").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair))
        rows = both.select(F.explode(keys).alias("key"), "fp")
    return rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(tidy(run), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint and component_id of every row: the smallest doc_id reachable over links.

    Equal fingerprints, those of blank texts among them, are one node from the start. Repeated doc_ids keep their rows; rows
    with a null doc_id count as the largest, and a group of such alone has a null component_id.
    """
    own = written(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = written(own.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    found = links(nodes.select("fp"), distance)
    edges = found.join(nodes.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(nodes.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b")
    comp = components(edges, "ra", "rb")
    known = nodes.join(comp, nodes.rep == comp.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return own.join(known, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """Of each group of near duplicates one row, all columns: that with the smallest doc_id, null ones last, the first of equal ones."""
    at = docs.columns.index("text")
    bounded(docs.sparkSession)
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(it):
        for b in it:
            for some in parts(b, at):
                fp = text_fingerprints(some.column(at).to_pylist(), shingle, seed).view(np.int64)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(fp)], [*names, "fp"])

    plain = docs.withColumn("text", F.col("text").cast("string")).toDF(*names)
    kind = StructType([*plain.schema.fields, StructField("fp", LongType())])
    # written with its keys, which would not be the same if worked out twice
    rows = written(plain.mapInArrow(tidy(run), kind).withColumn("key", F.monotonically_increasing_id()), "rows")
    doc_id = F.col(names[docs.columns.index("doc_id")])
    own = rows.select("fp", F.struct(doc_id.isNull().alias("null"), doc_id.cast("long").alias("doc_id"), "key").alias("first"))
    nodes = written(own.groupBy("fp").agg(F.min("first").alias("first")), "nodes")
    comp = components(links(nodes.select("fp"), distance))
    groups = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("component"), "first")
    kept = groups.groupBy("component").agg(F.min("first").alias("first"))
    spare = own.join(groups.select("fp", "component"), "fp").select("component", F.col("first.key").alias("key")).join(kept, "component").where("key <> first.key").select("key")
    return rows.join(spare, "key", "left_anti").select(*(F.col(c).cast(docs.schema[d].dataType).alias(d) for c, d in zip(names, docs.columns)))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: near_duplicates(table(spark, sf_dir, "documents")), "op8")
