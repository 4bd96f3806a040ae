"""Near-duplicate embeddings by NN-descent, within labels.

Equal vectors are one from the start. The first neighbour graph comes from sorting the vectors of a label by the signs
of random projections and comparing each run of CHUNK neighbours in that order. Each round then compares, at every
vector, its neighbours and those it is a neighbour of with each other (neighbours of neighbours) and keeps the best.
A list full of links has no seat left for others, so once links have joined groups each vector keeps a second list, of
neighbours outside its group. It starts from the same orders of one vector of each group, and rounds in which only
vectors of different groups compare spread it; links found so join groups, until a turn finds none. The members of each
group are then compared exactly, tile by tile; only counts leave a tile.

The descent compares half-precision copies; what comes near the threshold is compared again in double precision, and
only that decides. A sample of vectors is compared with all vectors of their labels: AUDIT at first, four times as many
until AUDIT_LINKS links have been seen, at most AUDIT_MOST. While fewer than RECALL of these links join what the graph
joins, more turns follow, each from fresh orders; after MAX_ROUNDS rounds without it there is an error. How many orders
there are grows with the largest label.
"""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, dropped, finished, table, written

COSINE, LIST, CHUNK, ORDERS, ROUNDS, MAX_ROUNDS, SLACK, SHARE, RECALL, SEED = 0.98, 8, 24, 6, 2, 24, 0.004, 16, 0.99, 11
AUDIT, AUDIT_LINKS, AUDIT_MOST = 256, 200, 16_384
_log = logging.getLogger(__name__)
GRAPH = "u long, v long, s float"


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (key, vec_id), members (key, rep) of usable rows, and distinct vectors (label, dim, rep, first, n, x: unit, double; h: half).

    key: a number of the row's own, so repeated vec_ids stay apart; rep: the smallest key of equal vectors, first: their
    smallest vec_id. Usable: label and vector not null, all components finite, not all zero. Vectors of other lengths than a
    label's others never meet them: the length is part of what counts as a label here.
    """
    v = F.col("embedding").cast("array<double>")
    ok = F.expr("label is not null and v is not null and size(v) > 0 and not exists(v, a -> a is null or isnan(a) or abs(a) = double('infinity')) and exists(v, a -> a <> 0)")
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    given = plain.select(F.monotonically_increasing_id().alias("key"), "vec_id", "label", F.when(ok, F.col("v")).alias("v"))

    def run(it):
        for b in it:
            out_x, out_h = [], []
            for x in b.column(3).to_pylist():
                if x is None:
                    out_x.append(None)
                    out_h.append(None)
                    continue
                a = np.array(x, np.float64)
                a = a / np.abs(a).max()
                a /= np.sqrt((a * a).sum())
                out_x.append(a.tobytes())
                out_h.append(a.astype(np.float16).tobytes())
            dims = [None if x is None else len(x) // 8 for x in out_x]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(dims, pa.int32()), pa.array(out_x, pa.binary()), pa.array(out_h, pa.binary())], ["key", "vec_id", "label", "dim", "x", "h"])

    unit = written(given.mapInArrow(run, "key long, vec_id long, label string, dim int, x binary, h binary"), "unit-vectors")
    usable = unit.where("x is not null")
    reps = written(usable.groupBy("label", "dim", "x").agg(F.min("key").alias("rep"), F.min("vec_id").alias("first"), F.count("*").alias("n"), F.first("h").alias("h")), "distinct-vectors")
    return unit.select("key", "vec_id"), usable.join(reps.select("label", "x", "rep"), ["label", "x"]).select("key", "rep"), reps


def _top(s: np.ndarray, own: np.ndarray, k: int):
    """Row and column indices of the k best of each row among `own` pairs."""
    s = np.where(own, s, -2.0)
    k = min(k, s.shape[1])
    cols = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(len(s)), k)
    cols = cols.ravel()
    ok = s[rows, cols] > -1.5
    return rows[ok], cols[ok]


def first_graph(reps: DataFrame, k: int = LIST, chunk: int = CHUNK, orders: int = ORDERS, seed: int = SEED) -> DataFrame:
    """Neighbours within runs of vectors that are next to each other in several random orders."""
    spark, out = reps.sparkSession, None
    for o in range(orders):

        def signs(it, o=o):
            for b in it:
                codes = []
                for h in b.column(3).to_pylist():
                    x = np.frombuffer(h, np.float16).astype(np.float32)
                    p = np.random.default_rng(seed + o).normal(size=(len(x), 40)).astype(np.float32) if not codes or len(x) != len(p) else p
                    codes.append(int("".join("1" if y > 0 else "0" for y in x @ p), 2))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.int64())], ["label", "dim", "rep", "h", "code"])

        def compare(it):
            held: list = []

            def part(rows):
                rep = np.array([r[2] for r in rows], np.int64)
                x = np.stack([np.frombuffer(r[3], np.float16) for r in rows]).astype(np.float32)
                s = x @ x.T
                i, j = _top(s, ~np.eye(len(rows), dtype=bool), k)
                return rep[i], rep[j], s[i, j]

            def flush(groups):
                got = [part(g) for g in groups if len(g) > 1]
                if sum(len(g[0]) for g in got):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([g[c] for g in got]), t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float32()))], ["u", "v", "s"])

            for b in it:
                groups = []
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (held[0][:2] != row[:2] or len(held) == chunk):
                        groups.append(held)
                        # runs overlap by half, so neighbours are not parted by where a run begins
                        held = held[chunk // 2 :] if held[0][:2] == row[:2] else []
                    held.append(row)
                yield from flush(groups)
            yield from flush([held])

        coded = reps.select("label", "dim", "rep", "h").mapInArrow(signs, "label string, dim int, rep long, h binary, code long")
        near = coded.repartitionByRange("label", "dim", "code", "rep").sortWithinPartitions("label", "dim", "code", "rep").mapInArrow(compare, GRAPH)
        out = near if out is None else out.unionByName(near)
    return written(best(out, k), "graph")


def best(graph: DataFrame, k: int, groups: DataFrame | None = None) -> DataFrame:
    """The k best neighbours of each vector; with groups, the k best in its group and the k best outside."""
    one = graph.groupBy("u", "v").agg(F.max("s").alias("s"))
    if groups is not None:
        one = beside(one, groups)
    side = ["u"] if groups is None else ["u", "inside"]
    w = Window.partitionBy(*side).orderBy(F.desc("s"), "v")
    return one.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("u", "v", "s")


def beside(graph: DataFrame, groups: DataFrame) -> DataFrame:
    """The graph with `inside`: whether both ends are in one group."""
    g = groups.select("node", "component")
    both = graph.join(g.withColumnsRenamed({"node": "u", "component": "gu"}), "u", "left").join(g.withColumnsRenamed({"node": "v", "component": "gv"}), "v", "left")
    return both.withColumn("inside", F.coalesce(F.col("gu") == F.col("gv"), F.lit(False))).select("u", "v", "s", "inside")


def one_of_each_group(reps: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """A vector of each group, another with each turn, and all vectors without a group."""
    both = reps.select("rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.coalesce("component", "rep").alias("component"))
    some = both.groupBy("component").agg(F.min_by("rep", F.xxhash64(F.lit(turn), "rep")).alias("rep"))
    return reps.join(some.select("rep"), "rep", "left_semi")


def descended(graph: DataFrame, reps: DataFrame, turn: int, k: int = LIST, groups: DataFrame | None = None) -> DataFrame:
    """One round: at each vector, those in its list and (k of, by a hash that changes with the round) those that list it meet.

    With groups only vectors of different ones compare, and what betters the list of outside neighbours is told.
    """
    back = Window.partitionBy(*(["u"] if groups is None else ["u", "inside"])).orderBy(F.xxhash64(F.lit(turn), "v"))
    forth = graph.select(F.col("u").alias("c"), F.col("v").alias("m"))
    told = graph.withColumn("inside", F.lit(False)) if groups is None else beside(graph, groups)
    rev = told.select(F.col("v").alias("u"), F.col("u").alias("v"), "inside").withColumn("r", F.row_number().over(back)).where(F.col("r") <= k).select(F.col("u").alias("c"), F.col("v").alias("m"))
    own = graph.select(F.col("u").alias("c"), F.col("u").alias("m")).distinct()
    worst = told.where("not inside").groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(F.lit(-2.0)).cast("float").alias("least"))
    meet = forth.unionByName(rev).unionByName(own).distinct()
    seats = meet.join(reps.select(F.col("rep").alias("m"), "h"), "m").join(worst.withColumnRenamed("u", "m"), "m", "left")
    seats = seats.withColumn("group", F.col("m")) if groups is None else seats.join(groups.select(F.col("node").alias("m"), F.col("component").alias("group")), "m", "left")

    def run(it):
        held: list[np.ndarray] = []

        def flush(c, m, h, least, group):
            order_first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            size = np.diff(np.r_[order_first, len(c)])
            outs = []
            for n in np.unique(size[size > 1]):
                starts = order_first[size == n]
                for lo in range(0, len(starts), 2048):
                    at = starts[lo : lo + 2048, None] + np.arange(n)
                    x = h[at].astype(np.float32)
                    s = x @ x.transpose(0, 2, 1)
                    s[:, np.arange(n), np.arange(n)] = -2
                    own = group[at]
                    s[own[:, :, None] == own[:, None, :]] = -2
                    # only what betters a list is worth telling; the best few of each seat
                    s = np.where(s > least[at][:, :, None], s, -2)
                    some = min(k, n - 1)
                    cols = np.argpartition(-s, some - 1, axis=2)[:, :, :some]
                    val = np.take_along_axis(s, cols, 2)
                    g, i, j = np.nonzero(val > -1.5)
                    outs.append((m[at[g, i]], m[at[g, cols[g, i, j]]], val[g, i, j]))
            if outs:
                cols = [np.concatenate([o[q] for o in outs]) for q in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(cols, (pa.int64(), pa.int64(), pa.float32()))], ["u", "v", "s"])

        rest = None
        for b in it:
            if not len(b):
                continue
            cols = [b.column(q).to_numpy(zero_copy_only=False) for q in (0, 1)] + [np.array(b.column(2).to_pylist(), object), b.column(3).to_numpy(zero_copy_only=False).astype(np.float32), b.column(4).to_numpy(zero_copy_only=False)]
            cols = cols if rest is None else [np.concatenate([r, c]) for r, c in zip(rest, cols)]
            whole = int(np.searchsorted(cols[0], cols[0][-1]))  # the last centre may go on
            rest = [c[whole:] for c in cols]
            yield from ready([c[:whole] for c in cols], flush)
        if rest is not None:
            yield from ready(rest, flush)

    def ready(cols, flush):
        lengths = np.array([len(x) for x in cols[2]])
        for n in np.unique(lengths):  # vectors of one length at a time
            pick = lengths == n
            h = np.frombuffer(b"".join(cols[2][pick]), np.float16).reshape(-1, n // 2)
            yield from flush(cols[0][pick], cols[1][pick], h, cols[3][pick], cols[4][pick])

    seats = seats.select("c", "m", "h", F.coalesce("least", F.lit(-2.0)).cast("float").alias("least"), F.coalesce("group", "m").alias("group"))
    fresh = seats.repartition("c").sortWithinPartitions("c").mapInArrow(run, GRAPH)
    return best(graph.unionByName(fresh), k, groups)


def checked(pairs: DataFrame, reps: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b) of the pairs whose cosine in double precision reaches the threshold."""

    def run(it):
        for b in it:
            x, y = _matrix_or_rows(b.column(2)), _matrix_or_rows(b.column(3))
            keep = np.array([float(p @ q) >= cosine if len(p) == len(q) else False for p, q in zip(x, y)], bool)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep))

    x = reps.select(F.col("rep").alias("a"), F.col("x").alias("xa"))
    y = reps.select(F.col("rep").alias("b"), F.col("x").alias("xb"))
    return pairs.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct().join(x, "a").join(y, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _matrix_or_rows(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.float64) for x in column.to_pylist()]


def audited(reps: DataFrame, groups: DataFrame, cosine: float = COSINE, sample: int = AUDIT, most: int = AUDIT_MOST) -> float:
    """The share of links of a sample of vectors, found by comparing them with all, whose ends are in one group (1 if none)."""
    spark = reps.sparkSession
    some = [(r.rep, r.label, bytes(r.x)) for r in reps.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("rep", "label", "x").collect()]  # bounded by `sample`
    if not some:
        return 1.0
    by: dict = {}
    for rep, label, x in some:
        by.setdefault((label, len(x)), []).append((rep, np.frombuffer(x, np.float64)))
    sent = spark.sparkContext.broadcast({k: (np.array([r for r, _ in v]), np.stack([x for _, x in v])) for k, v in by.items()})

    def run(it):
        for b in it:
            a, c = [], []
            for label, rep, x in zip(*(col.to_pylist() for col in b.columns)):
                if (found := sent.value.get((label, len(x)))) is not None:
                    hit = found[0][(found[1] @ np.frombuffer(x, np.float64) >= cosine) & (found[0] != rep)]
                    a += [rep] * len(hit)
                    c += hit.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    true = reps.select("label", "rep", "x").mapInArrow(run, "a long, b long")
    g = groups.select("node", "component")
    both = true.join(g.withColumnsRenamed({"node": "a", "component": "ga"}), "a", "left").join(g.withColumnsRenamed({"node": "b", "component": "gb"}), "b", "left")
    n, ok = both.agg(F.count("*"), F.coalesce(F.sum(F.coalesce((F.col("ga") == F.col("gb")).cast("int"), F.lit(0))), F.lit(0))).first()
    if n < AUDIT_LINKS and len(some) == sample and sample * 4 <= most:
        return audited(reps, groups, cosine, sample * 4, most)
    _log.info("recall %s over %s links of %s vectors", ok / n if n else None, n, len(some))
    return ok / n if n else 1.0


def link_counts(reps: DataFrame, groups: DataFrame, cosine: float = COSINE, share: int = SHARE) -> DataFrame:
    """(rep, n_other): rows linked to each vector of a group, itself left out, by comparing all of the group in tiles.

    A group of g vectors is dealt by a hash into about sqrt(g / share) tiles, and each pair of tiles is a row group of its
    own: no group is ever in one place, copies of a vector grow with the root of its group only, and one count for each
    vector and pair of tiles leaves the comparison.
    """
    mine = groups.join(reps, groups.node == reps.rep).select("component", "rep", "n", "x")
    size = mine.groupBy("component").agg(F.count("*").alias("size"))
    dealt = mine.join(size, "component").withColumn("tiles", F.ceil(F.sqrt(F.col("size") / share)).cast("int")).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    # tile t goes to the pairs (t, j) and (j, t) for all j; `left` rows are counted, `right` rows are what they are counted against
    js = F.sequence(F.lit(0), F.col("tiles") - 1)
    left = dealt.select("component", F.col("t").alias("i"), F.explode(js).alias("j"), F.lit(True).alias("left"), "rep", "n", "x")
    right = dealt.select("component", F.explode(js).alias("i"), F.col("t").alias("j"), F.lit(False).alias("left"), "rep", "n", "x")

    def run(it):
        keep: list = []

        def flush(rows):
            l, r = [q for q in rows if q[3]], [q for q in rows if not q[3]]
            out = np.zeros(len(l), np.int64)
            for dim in {len(q[6]) for q in l}:
                li, ri = [k for k, q in enumerate(l) if len(q[6]) == dim], [k for k, q in enumerate(r) if len(q[6]) == dim]
                if ri:
                    y, n, yr = np.frombuffer(b"".join(r[k][6] for k in ri), np.float64).reshape(len(ri), -1), np.array([r[k][5] for k in ri]), np.array([r[k][4] for k in ri])
                    x, xr = np.frombuffer(b"".join(l[k][6] for k in li), np.float64).reshape(len(li), -1), np.array([l[k][4] for k in li])
                    for lo in range(0, len(li), 512):
                        some = slice(lo, lo + 512)
                        out[li[some]] = ((x[some] @ y.T >= cosine) & (xr[some, None] != yr)) @ n
            return [q[4] for q in l], out.tolist()

        for b in it:
            ids, counts = [], []
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if keep and keep[0][:3] != row[:3]:
                    a, c = flush(keep)
                    ids, counts, keep = ids + a, counts + c, []
                keep.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["rep", "n"])
        if keep:
            a, c = flush(keep)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["rep", "n"])

    both = left.unionByName(right).repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return both.mapInArrow(run, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n_other"))


def near_duplicates(rows: DataFrame, cosine: float = COSINE, k: int = LIST, rounds: int = ROUNDS, max_rounds: int = MAX_ROUNDS, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Rows that link with nothing (null label or vector, non-finite or zero vectors) stand alone and are kept. Equal vectors
    of a label link with each other. Repeated vec_ids count as vectors of their own with one id; null ones count as the
    largest.
    """
    every, members, reps = distinct_vectors(rows)
    largest = reps.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    orders = max(ORDERS, math.ceil(ORDERS + 1.3 * math.log10(largest / 20_000)))  # keeps the chance that near vectors share a run
    graph = first_graph(reps, k, orders=orders)
    for done in range(rounds):
        nxt = written(descended(graph, reps, done, k), "graph")
        dropped(graph)
        graph = nxt
    near = lambda: checked(graph.where(F.col("s") >= cosine - SLACK), reps, cosine)
    edges = written(near(), "links")
    groups = written(components(edges), "groups")
    done = rounds
    while True:
        # lists of neighbours outside the groups, until a turn joins no two of them
        seeds = first_graph(one_of_each_group(reps, groups, done), k, orders=orders // 2, seed=SEED + orders * (done + 1))
        for turn in range(rounds):
            nxt = written(descended(graph if turn else best(graph.unionByName(seeds), k, groups), reps, done, k, groups), "graph")
            dropped(graph)
            graph, done = nxt, done + 1
        dropped(seeds)
        new = written(beside(near().select(F.col("a").alias("u"), F.col("b").alias("v"), F.lit(0.0).alias("s")), groups).where("not inside").select(F.col("u").alias("a"), F.col("v").alias("b")), "links")
        if new.isEmpty():
            if audited(reps, groups, cosine) >= recall:
                break
            if done >= max_rounds:
                raise RuntimeError(f"fewer than {recall} of the audited links found in {done} rounds")
            continue
        edges = written(edges.unionByName(new), "links")
        groups = written(components(edges), "groups")
    found = link_counts(reps, groups, cosine)
    own = groups.select(F.col("node").alias("rep"), "component")
    first = reps.select("rep", "first").join(own, "rep").groupBy("component").agg(F.min("first").alias("least"))
    info = reps.select("rep", "first", "n").join(found, "rep", "left").join(own, "rep", "left").join(first, "component", "left")
    info = info.select("rep", (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    linked = members.join(info, "rep").select("key", "n_links", "component_id")
    out = every.join(linked, "key", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_nn_descent_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: near_duplicates(table(spark, sf_dir, "embeddings")), "op4")
