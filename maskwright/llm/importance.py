"""Target-distribution importance resampling over hashed word runs.

Every document is a sparse row of counts over BUCKETS hashed features. The matrix is written once, in blocks of compressed
sparse rows (row starts, bucket numbers, counts; packed numbers) of BLOCK_BYTES of text each, and read twice: its column sums
give the raw distribution, and its product with the vector of gains gives every document's weight. A task holds a few blocks
at a time (small row groups, Arrow batches of BATCH_BYTES), and of each task's columns only their sums move, BUCKETS rows at
most. Gains are BUCKETS numbers, which go to all tasks.

Buckets come from crc32 of the feature's bytes. Each distinct word of a block is hashed once; the crc of a run of words
follows from those of its parts, as appending bytes is a linear map of the crc's bits, looked up in tables.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finished, table, texts, tidy, written
from .words import slices

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
BLOCK_BYTES, PIECE_BYTES, BATCH_BYTES = 500_000, 8_000_000, 8_000_000
#: Parquet's row groups, whose columns Spark reads into memory at once; their size is looked at after each block
ROW_GROUPS = {"parquet.block.size": 4 * BATCH_BYTES, "parquet.page.size.row.check.min": 1}
#: starts, one more than rows, as 64 bits each; buckets and counts as 8, 16 or 32 bits, as many as a block's largest takes
BLOCK = "ids array<long>, words array<long>, starts binary, buckets binary, counts binary"

#: bytes of a word: digits, letters, and all that is not ASCII; others are blanks
_WORD_BYTES = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256))


def _appended(bits: int) -> np.ndarray:
    """[4, 256]: what a crc's byte of a place and value becomes when 2 ** bits zero bytes follow."""
    step = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)  # the polynomial of crc32
        step[b] = c
    one = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    out = one >> 8 ^ step[one & 255]
    for _ in range(bits):
        out = _through(out, out)
    return out


def _through(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[0][crc & 255] ^ by[1][crc >> 8 & 255] ^ by[2][crc >> 16 & 255] ^ by[3][crc >> 24]


class Shifts:
    """Crcs with zero bytes appended: as many as `lengths` says, which may differ from crc to crc."""

    def __init__(self, most: int = 64):
        self.powers = [_appended(0)]
        rows, one = [np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])], self.powers[0]
        for _ in range(most):
            rows.append(_through(rows[-1], one))
        self.short = np.stack(rows, axis=1)  # place, length, byte

    def __call__(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        most = self.short.shape[1] - 1
        if not len(crc) or lengths.max() <= most:
            return self.short[0, lengths, crc & 255] ^ self.short[1, lengths, crc >> 8 & 255] ^ self.short[2, lengths, crc >> 16 & 255] ^ self.short[3, lengths, crc >> 24]
        out, left, k = crc, lengths.astype(np.int64), 0
        while left.any():
            if k == len(self.powers):
                self.powers.append(_through(self.powers[-1], self.powers[-1]))
            out, left, k = np.where(left & 1, _through(out, self.powers[k]), out), left >> 1, k + 1
        return out


_SHIFTS: list[Shifts] = []


def word_lists(text: bytes, most: int = PIECE_BYTES):
    """The words of a text, ASCII letters in lower case, in lists of about `most` bytes."""
    plain = text.lower().translate(_WORD_BYTES)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= most else plain.find(b" ", at + most)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def run_buckets(words: list[bytes], owner: np.ndarray, skip: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every run of 1 to `run` consecutive words of one owner; a run counts where its last word is not in skip."""
    if not _SHIFTS:
        _SHIFTS.append(Shifts())
    shift = _SHIFTS[0]
    coded = pa.array(words, pa.binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy()
    plain = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))[at]
    spaced = np.fromiter((zlib.crc32(b" ", zlib.crc32(w)) for w in distinct), np.uint32, len(distinct))[at]
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))[at]
    whose, found = [owner[~skip]], [plain[~skip]]
    head = spaced  # crc of a run's words but the last, a space after each
    for n in range(1, run):
        if len(words) <= n:
            break
        same = (owner[n:] == owner[:-n]) & ~skip[n:]
        here = shift(head[: len(words) - n], size[n:]) ^ plain[n:]
        whose.append(owner[n:][same])
        found.append(here[same])
        head = shift(head[: len(words) - n], size[n:] + 1) ^ spaced[n:]
    return np.concatenate(whose), (np.concatenate(found) % np.uint32(buckets)).astype(np.int64)


def block_of(rows: list[bytes | None], run: int = RUN, buckets: int = BUCKETS, most: int = PIECE_BYTES) -> tuple[np.ndarray, ...]:
    """(words, starts, buckets, counts) of texts: the number of words of each, and the rows of counts, compressed."""
    n_words = np.zeros(len(rows), np.int64)
    sums: dict[int, np.ndarray] = {}  # of texts in several lists, one at a time
    words, owner, cells = [], [], []

    def gathered():
        if words:
            who, where = run_buckets(words, np.repeat(np.array([o for o, _ in owner]), [n for _, n in owner]), np.zeros(len(words), bool), run, buckets)
            cell, count = np.unique(who * buckets + where, return_counts=True)
            cells.append((cell, count))
        words.clear()
        owner.clear()

    for k, text in enumerate(rows):
        if not text:
            continue
        if len(text) <= most:
            some = next(word_lists(text, most))
            n_words[k] = len(some)
            if some:
                words += some
                owner.append((k, len(some)))
            continue
        gathered()
        before, total = [], np.zeros(buckets, np.int64)
        for some in word_lists(text, most):
            n_words[k] += len(some)
            if both := before + some:  # runs that began in the list before
                skip = np.arange(len(both)) < len(before)
                total += np.bincount(run_buckets(both, np.zeros(len(both), np.int64), skip, run, buckets)[1], minlength=buckets)
                before = both[-(run - 1) :] if run > 1 else []
        live = np.flatnonzero(total)
        cells.append((k * buckets + live, total[live]))
    gathered()
    cell = np.concatenate([c for c, _ in cells]) if cells else np.zeros(0, np.int64)
    count = np.concatenate([c for _, c in cells]) if cells else np.zeros(0, np.int64)
    starts = np.searchsorted(cell, np.arange(len(rows) + 1) * buckets)
    return n_words, starts, cell % buckets, count


def matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of rows (BLOCK): ids and words of each text, where its cells start, bucket numbers and counts."""

    def work(it):
        for b in it:
            raw = b.column(1).cast(pa.binary())
            for lo, hi in slices(raw, block_bytes):
                words, starts, where, counts = block_of(raw.slice(lo, hi - lo).to_pylist(), run, buckets)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), values)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([one(b.column(0).slice(lo, hi - lo)), one(pa.array(words)), *(pa.array([x]) for x in packed(starts, where, counts))], ["ids", "words", "starts", "buckets", "counts"])

    return texts(docs, id_col, text_col).mapInArrow(tidy(work), BLOCK)


def packed(starts: np.ndarray, where: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    small = lambda x: x.astype(next(k for k in ("<u1", "<u2", "<u4") if not len(x) or x.max() <= np.iinfo(k).max)).tobytes()
    return starts.astype("<i8").tobytes(), small(where), small(counts)


def unpacked(starts: bytes, where: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(starts, "<i8")
    n = int(at[-1])
    kind = lambda x: f"<u{len(x) // n}" if n else "<u1"
    return at, np.frombuffer(where, kind(where)), np.frombuffer(counts, kind(counts)).astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of buckets with any count: each task adds its blocks up first."""

    def work(it):
        total = np.zeros(buckets, np.int64)
        for b in it:
            for k in range(len(b)):
                _, where, counts = unpacked(*(b.column(c)[k].as_py() for c in range(3)))
                total += np.bincount(where, counts, buckets).astype(np.int64)
        live = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(total[live], pa.int64())], ["bucket", "n"])

    each = blocks.select("starts", "buckets", "counts").mapInArrow(work, "bucket int, n long")
    return each.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket floor(1000 * ln of the target's share over the raw share), both smoothed by one. BUCKETS rows come to the driver."""
    def vector(sums):
        out = [0] * buckets
        for r in sums.collect():  # at most one row a bucket
            out[r.bucket] = r.n
        return out

    s, t = vector(raw), vector(target)
    big_s, big_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((t[k] + 1) * (big_s + buckets) / ((s[k] + 1) * (big_t + buckets)))) for k in range(buckets)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of the matrix: its product with the gains."""

    def work(it):
        for b in it:
            for k in range(len(b)):
                ids, words = (b.column(c).slice(k, 1).flatten() for c in range(2))
                starts, where, counts = unpacked(*(b.column(c)[k].as_py() for c in range(2, 5)))
                both = np.concatenate([[0], np.cumsum(counts * gain[where])]), np.concatenate([[0], np.cumsum(counts)])
                weight, n = (np.diff(x[starts]) for x in both)
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(work, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the hash of the seed and the id; a null id counts as no digits."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, take: int) -> DataFrame:
    """The first `take` rows by score (high to low) and doc_id (nulls last), with rank from 1.

    Rows are dealt by ranges of that order, numbered within each part and moved up by the sizes of the parts before.
    """
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "by-score")
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a part
    mine = dealt.join(F.broadcast(before.where(F.col("before") < take)), "part")
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return mine.withColumn("rank", F.col("before") + within).where(F.col("rank") <= take).drop("part", "before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, run: int = RUN, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_features, weight, score, and rank (null unless drawn), all long.

    docs is the raw corpus, target a table with a column `text` that the draw should be like. Null and empty texts have no
    features and weight 0. Rows with fewer than least_words words are never drawn. Repeated doc_ids keep their rows, and so their
    scores; of rows alike in score and id any may come first, null ids last. Other columns are not looked at. An empty target
    or corpus is a distribution without counts, so only the smoothing speaks.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    blocks = written(matrix(docs, id_col, text_col, run, buckets), "matrix", **ROW_GROUPS)
    aim = matrix(target.select(F.lit(0).alias("none"), "text"), "none", "text", run, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(aim, buckets), buckets)
    found = weights(blocks, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    found = written(found, "weights")
    able = found.where(F.col("n_words") >= least_words)
    take = able.count() * percent // 100
    drawn = ranked(able.select("score", "doc_id", "row"), take).select("row", F.col("rank").cast("long").alias("rank")) if take else spark.createDataFrame([], "row long, rank long")
    return found.join(drawn, "row", "left").select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "op11")
