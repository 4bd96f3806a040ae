"""Token ids in binary files: canonical, length-limited Huffman codes built from the counts of all ids.

File format (a folder)
    codebook/   Parquet, one row: `lengths` binary, one byte for each id of the vocabulary: its code's bits, 0 if it
                never occurs. Codes are canonical: by length, then by id. No code is longer than MAX_BITS, so one look
                into a table of 2^MAX_BITS entries decodes an id.
    blocks/     Parquet, one row for each block: shard, block, before (ids of its shard that stand before it), first_doc,
                n_docs, n_ids and `payload` binary.
                Shards, and blocks in a shard, hold ascending doc_id. A block ends with a document and decodes alone:
                    magic "HTK2", uint32 n_docs, uint32 n_ids, uint32 n_checkpoints, uint32 n_null (how many of the first
                    documents have a null doc_id; they come before all others and stand as 0)
                    int64 doc_id[n_docs], uint32 n_tokens[n_docs], uint32 bit_offset[n_checkpoints], code bits
                There is a checkpoint every STEP ids; the decoder walks all stretches between checkpoints in step.
Everything is little-endian, code bits run from the highest bit of a byte down.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, fresh_path, table, texts, tidy, written
from .words import encoder, slices, tokenizer_path

MAX_BITS, STEP, BLOCK_IDS = 16, 256, 1 << 18
MAGIC = b"HTK2"
BLOCKS = "shard int, block int, before long, first_doc long, n_docs long, n_ids long, payload binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most max_bits (package-merge); 0 for ids that never occur."""
    live = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(live) == 0:
        return out
    if len(live) == 1:
        out[live] = 1
        return out
    if len(live) > 1 << max_bits:
        raise ValueError(f"{len(live)} ids do not fit codes of {max_bits} bits")
    order = live[np.argsort(counts[live], kind="stable")]
    w = counts[order].astype(np.float64)
    n = len(order)
    # Each level merges the coins of one denomination; `is_leaf` remembers which of a level's items are coins of their own.
    levels, level = [], w
    leaves = np.ones(n, bool)
    levels.append(leaves)
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([w, pairs])
        leaves = np.concatenate([np.ones(n, bool), np.zeros(len(pairs), bool)])
        o = np.argsort(both, kind="stable")
        level, leaves = both[o], leaves[o]
        levels.append(leaves)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for leaves in reversed(levels):
        own = int(leaves[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id as an integer; ids of length 0 have none."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        ls = lengths[order].astype(np.int64)
        top = int(ls.max())
        steps = np.left_shift(np.ones(len(ls), np.int64), top - ls)
        codes[order] = ((np.cumsum(steps) - steps) >> (top - ls)).astype(np.uint64)
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits, and the bit offset of every STEP-th id."""
    ls = lengths[ids].astype(np.int64)
    pos = np.cumsum(ls) - ls
    total = int(pos[-1] + ls[-1]) if len(ids) else 0
    word = pos >> 5
    v = codes[ids] << (64 - (pos & 31) - ls).astype(np.uint64)
    n = (total >> 5) + 2
    # The codes' bits do not overlap, so sums of 32-bit halves are exact in double precision.
    bits = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    return bits.astype(">u4").tobytes()[: (total + 7) // 8], pos[::STEP].astype("<u4")


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each value of the next max_bits bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = np.left_shift(1, max_bits - lengths[order].astype(np.int64))
    syms = np.zeros(1 << max_bits, np.uint32)
    lens = np.ones(1 << max_bits, np.int64)
    n = int(spans.sum())
    syms[:n] = np.repeat(order, spans)
    lens[:n] = np.repeat(lengths[order].astype(np.int64), spans)
    return syms, lens


def unpack_bits(data: bytes, n_ids: int, offsets: np.ndarray, tab: tuple[np.ndarray, np.ndarray], max_bits: int = MAX_BITS) -> np.ndarray:
    syms, lens = tab
    raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.uint32)
    win = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pos = offsets.astype(np.int64)
    lanes = len(pos)
    out = np.zeros((lanes, STEP), np.uint32)
    left = n_ids - (lanes - 1) * STEP if lanes else 0
    for i in range(min(STEP, n_ids)):
        if i == left and lanes > 1:
            pos = pos[:-1]
        look = ((win[pos >> 3] << (pos & 7).astype(np.uint32)) >> np.uint32(32 - max_bits)).astype(np.int64)
        out[: len(pos), i] = syms[look]
        pos = pos + lens[look]
    return out.reshape(-1)[:n_ids]


def pack_block(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, n_null: int = 0) -> bytes:
    bits, offsets = pack_bits(ids, lengths, codes)
    head = np.array([len(doc_ids), len(ids), len(offsets), n_null], "<u4").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), offsets.tobytes(), bits])


def unpack_block(payload: bytes, tab) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_id, n_tokens, all ids and n_null of a block; needs nothing but the block and the decoding table."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n_ids, n_off, n_null = (int(x) for x in np.frombuffer(payload, "<u4", 4, 4))
    at = 20
    docs = np.frombuffer(payload, "<i8", n_docs, at)
    counts = np.frombuffer(payload, "<u4", n_docs, at := at + 8 * n_docs)
    offsets = np.frombuffer(payload, "<u4", n_off, at := at + 4 * n_docs)
    return docs, counts, unpack_bits(payload[at + 4 * n_off :], n_ids, offsets, tab), n_null


def tokenized(docs: DataFrame, vocab_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and `ids` (little-endian, 2 bytes each where the vocabulary allows, else 4)."""

    def run(it):
        enc = encoder(vocab_path)
        kind = "<u2" if enc.vocab_size <= 1 << 16 else "<u4"
        for b in it:
            for lo, hi in slices(b.column(1)):
                ids, counts = enc.encode(b.column(1).slice(lo, hi - lo), end_id)
                cut = np.cumsum(counts)
                raw, size = ids.astype(kind).tobytes(), np.dtype(kind).itemsize
                blobs = [raw[(e - c) * size : e * size] for e, c in zip(cut.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame, vocab_size: int) -> np.ndarray:
    """How often each id occurs in all documents: counted in each task, summed by id. The result has vocab_size entries."""
    kind = "<u2" if vocab_size <= 1 << 16 else "<u4"

    def run(it):
        n = np.zeros(vocab_size, np.int64)
        for b in it:
            x = b.column(0)
            if len(x):
                at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
                n += np.bincount(np.frombuffer(x.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind), minlength=vocab_size)
        live = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array(n[live])], ["id", "n"])

    out = np.zeros(vocab_size, np.int64)
    got = tokens.select("ids").mapInArrow(tidy(run), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out[got.id.to_numpy()] = got.n.to_numpy()
    return out


def write_tokens(docs: DataFrame, path: str, vocab_path: str, end_id: int = 1, **cols) -> None:
    """Encode documents (null text: empty) and write them in the format above, in ascending doc_id order.

    Rows with a null doc_id come first. Repeated doc_ids are all kept, in the order of their ids; an empty table gives an
    empty folder of blocks.
    """
    spark = docs.sparkSession
    tokens = written(tokenized(docs, vocab_path, end_id, **cols), "tokens")
    vocab = encoder(vocab_path).vocab_size
    kind = "<u2" if vocab <= 1 << 16 else "<u4"
    lengths = code_lengths(id_counts(tokens, vocab))
    codes = canonical(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def run(it):
        from pyspark import TaskContext

        shard, block, before, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def row():
            d, n, x = (np.array([h[0] or 0 for h in held], np.int64), np.array([h[1] for h in held]), np.frombuffer(b"".join(h[2] for h in held), kind).astype(np.int64))
            nulls = sum(h[0] is None for h in held)
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "before": before, "first_doc": held[0][0], "n_docs": len(d), "n_ids": len(x), "payload": pack_block(d, n, x, lengths, codes, nulls)}], schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for b in it:
            for h in zip(*(c.to_pylist() for c in b.columns)):
                held.append(h)
                size += h[1]
                if size >= BLOCK_IDS:
                    yield row()
                    held, size, block, before = [], 0, block + 1, before + size
        if held:
            yield row()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
        .mapInArrow(tidy(run), BLOCKS)
        .write.parquet(f"{path}/blocks")
    )
    dropped(tokens)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and `ids` (array<int>) of every document, from the files alone."""
    return _decoded(spark, path, "ids array<int>", pa.list_(pa.int32()), lambda x: x.astype(np.int32))


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids, from the files alone."""
    return _decoded(spark, path, "ids_crc32 long", pa.int64(), lambda x: zlib.crc32(x.astype("<u4").tobytes()))


def _decoded(spark: SparkSession, path: str, column: str, kind, f) -> DataFrame:
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first()[0]), np.uint8)
    blocks = read_blocks(spark, path)
    # ids before each shard: one row for each shard, not for each document
    per = sorted((r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    base, n = {}, 0
    for shard, k in per:
        base[shard], n = n, n + k
    name = column.split()[0]

    def run(it):
        tab = decode_table(lengths)
        for b in it:
            for shard, before, payload in zip(*(c.to_pylist() for c in b.columns)):
                docs, counts, ids, nulls = unpack_block(payload, tab)
                ends = np.cumsum(counts.astype(np.int64))
                starts = ends - counts
                vals = [f(ids[a:e]) for a, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=np.arange(len(docs)) < nulls), pa.array(starts + base[shard] + before, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(vals, kind)], ["doc_id", "start", "n_tokens", name])

    return blocks.select("shard", "before", "payload").mapInArrow(tidy(run), f"doc_id long, start long, n_tokens long, {column}")


def op1_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return token_digest(spark, path)
