"""Packing documents into sequences by Karmarkar-Karp multiway differencing.

A document is cut into full sequences and a rest. The rests of a batch are spread over windows by differencing: each
starts as a partial partition of its own, and the two partitions with the largest spread are merged again and again,
the fullest window of one onto the emptiest of the other, which gives near-equal windows. The count of windows starts
at what the batch's ids need and rises while capacity is exceeded: without cutting (`cut=False`) by anything, else by
what would fill a window of its own. Less than that, less than one window in all, is cut off and moved to where there is room.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts
from .words import encoder, slices, tokenizer_path

CAPACITY, BATCH_WINDOWS = 2048, 96
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Item indices of k windows of near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    heap: list = []
    for i, s in enumerate(sizes.tolist()):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        heap.append((-s, i, sums, [[i]] + [[]] * (k - 1)))
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        _, _, a, pa_ = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        sums = a + b[::-1]  # both run from full to empty: opposing imbalances cancel
        parts = [x + y if x and y else x or y for x, y in zip(pa_, reversed(pb))]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), tie, sums, [parts[j] for j in order.tolist()]))
        tie += 1
    return heap[0][3] if heap else [[] for _ in range(k)]


def windows(sizes: np.ndarray, capacity: int = CAPACITY, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, first id, length), none over capacity. Sizes must be positive; without `cut`, at most capacity.

    With `cut`, what an item holds beyond whole windows is its rest; rests stay whole but for less than one window of ids.
    """
    full = sizes // capacity * capacity if cut else np.zeros_like(sizes)
    done = [[(i, a, capacity)] for i, n in enumerate(full.tolist()) for a in range(0, n, capacity)]
    items = np.flatnonzero(sizes > full)
    rests = (sizes - full)[items]
    total = int(rests.sum())
    k = max(1, -(-total // capacity))
    while len(items):
        out = [[(int(items[j]), int(full[items[j]]), int(rests[j])) for j in part] for part in difference(rests, k)]
        loads = [sum(x[2] for x in w) for w in out]
        excess = sum(max(0, n - capacity) for n in loads)
        if excess < (capacity if cut else 1):
            _level(out, loads, capacity)
            return done + [w for w in out if w]
        k += 1
    return done


def _level(out: list[list[tuple[int, int, int]]], loads: list[int], capacity: int) -> None:
    """Cut what stands over capacity off its windows' largest items, and put it where there is room."""
    over: list[tuple[int, int, int]] = []
    for j, w in enumerate(out):
        while (extra := loads[j] - capacity) > 0:
            big = max(range(len(w)), key=lambda i: w[i][2])
            i, a, n = w[big]
            m = min(extra, n)
            over.append((i, a + n - m, m))
            w[big : big + 1] = [(i, a, n - m)] if n > m else []
            loads[j] -= m
    for j in sorted(range(len(out)), key=lambda j: loads[j]):
        while over and loads[j] < capacity:
            i, a, n = over.pop()
            m = min(n, capacity - loads[j])
            out[j].append((i, a, m))
            loads[j] += m
            if n > m:
                over.append((i, a + m, n - m))


def packed(docs: DataFrame, vocab_path: str, end_id: int = 1, capacity: int = CAPACITY, batch_windows: int = BATCH_WINDOWS, with_ids: bool = False) -> DataFrame:
    """One row for each piece: which ids of which document stand where in which sequence; `ids` too if with_ids.

    Null texts count as empty (one piece: the end id). Each task packs its own documents, batch after batch; a batch is
    closed at a whole number of windows, its last document cut there; differencing keeps the other rests whole but for
    less than a window of ids. What is left at a task's end goes into sequences
    whose lengths are powers of two, which take no padding. Repeated doc_ids are packed row by row.
    sequence_id: the task's partition in the upper bits, a running number below.
    """
    kind = pa.list_(pa.int32())

    def run(it):
        from pyspark import TaskContext

        enc, part = encoder(vocab_path), TaskContext.get().partitionId()
        names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
        sequence, pool, held = part << 40, [], 0  # pool: (doc, first id, ids, doc's ids)
        out: list[tuple] = []

        def emit(sources, parts):
            nonlocal sequence
            offset = 0
            for i, a, n in sorted(parts):
                doc, first, ids, total = sources[i]
                x = ids[a : a + n]
                out.append((doc, first + a, n, zlib.crc32(x.tobytes()), total, sequence, offset) + ((x.astype(np.int32),) if with_ids else ()))
                offset += n
            sequence += 1

        def close(sources, cap=capacity):
            for w in windows(np.array([len(s[2]) for s in sources]), cap):
                emit(sources, w)

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array(c, kind if n == "ids" else pa.int64()) for n, c in zip(names, zip(*out))], names)
            out.clear()
            return rows

        for b in it:
            doc_ids = b.column(0).to_pylist()
            for lo, hi in slices(b.column(1)):
                ids, counts = enc.encode(b.column(1).slice(lo, hi - lo), end_id)
                ids, at = ids.astype("<u4"), 0
                for doc, n in zip(doc_ids[lo:hi], counts.tolist()):
                    mine = ids[at : at + n]
                    at += n
                    whole = n // capacity * capacity
                    for a in range(0, whole, capacity):
                        emit([(doc, 0, mine, n)], [(0, a, capacity)])
                    if n > whole:
                        pool.append((doc, whole, mine[whole:].copy(), n))
                        held += n - whole
                        if held >= batch_windows * capacity:
                            doc, first, x, total = pool.pop()
                            keep = len(x) - (held - batch_windows * capacity)
                            close([*pool, (doc, first, x[:keep], total)])
                            held -= batch_windows * capacity
                            pool = [(doc, first + keep, x[keep:], total)] if held else []
                if out:
                    yield flush()
        if pool:
            full = held // capacity * capacity
            pieces, rest, n = [], [], 0
            for doc, first, x, total in pool:
                a = max(0, min(len(x), full - n))
                n += len(x)
                pieces += [(doc, first, x[:a], total)] * (a > 0)
                rest += [(doc, first + a, x[a:], total)] * (a < len(x))
            if pieces:
                close(pieces)
            queue, left = [(i, 0, len(r[2])) for i, r in enumerate(rest)][::-1], held - full
            while left:
                room, parts = 1 << (left.bit_length() - 1), []
                left -= room
                while room:
                    i, a, n = queue.pop()
                    m = min(room, n)
                    parts.append((i, a, m))
                    room -= m
                    if n > m:
                        queue.append((i, a + m, n - m))
                emit(rest, parts)
            yield flush()

    return texts(docs).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def padding(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, ids, padded (ids that sequences lack to capacity, but for powers of two), pieces, documents, rests_cut
    (documents' rests in more than one piece)."""
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    seqs = per.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("n"), F.lit(0)).alias("ids"), F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("n"))), F.lit(0)).alias("padded"))
    docs = pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("doc_tokens").alias("t"), F.sum((F.col("length") < capacity).cast("int")).alias("parts"))
    return seqs.crossJoin(docs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"), F.count("*").alias("documents"), F.coalesce(F.sum((F.col("parts") > 1).cast("int")), F.lit(0)).alias("rests_cut")))  # one row each


def op3_karmarkar_karp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
