"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w[t] + sum over pairs of <v[s], v[t]>) over the terms of a text; the factors v let two
terms mean more together than each alone (an insult and the mention of a group). Terms are lower-cased runs of letters
and their beginnings of 4 to 6 letters (inflected insults share a stem), hashed to BUCKETS; a term counts once for each
text, so length does not add up. The machine is fitted to at most MAX_ROWS labelled documents, those smallest by a hash
of their id, texts of the same words once. Every hashed term of at least MIN_TEXTS of these texts takes part, in turn:
    1. terms whose own rates differ between the labels by more than CLEAR standard errors, and the machine over them;
    2. on what that leaves unexplained, factors of all terms: each is driven along the loss's gradient on one half of the
       texts, with a threshold that grows until it rests on at most SUPPORT terms, and tested on the other half (CLEAR
       standard errors again). So terms that say nothing alone but much in company are found; what fits one half only is
       not, nor what whole kinds of texts share, which rests on many terms;
    3. the machine over the terms of both kinds.
Everything is scored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, dropped, table, texts, tidy, written
from .words import parts

MAX_ROWS, BUCKETS, FACTORS, THRESHOLD, FOLDS, HELD = 20_000, 1 << 30, 4, 0.3, 4, 2
STEMS, CLEAR, MIN_TEXTS, SCREEN_FACTORS, SUPPORT = (4, 5, 6), 5.0, 3, 8, 64
#: what a factor's standing out must exceed, round by round; after that 1.3 times more each
SCREEN = (0, 0, 0, 0, 0, 0, 0.5, 1, 1.5, 2, 2.5, 3)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def buckets(word: str) -> list[int]:
    """The word's own bucket and those of its longer beginnings."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in [word] + [f"{word[:n]}-" for n in STEMS if len(word) >= n]]


class Machine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray, index: dict[int, int]):
        self.w0, self.w, self.v, self.index = w0, w, v, index
        self.cache: dict[str, tuple] = {}

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, get, index = np.empty(len(texts)), self.cache.get, self.index
        if len(self.cache) > 200_000:
            self.cache.clear()
        for k, t in enumerate(texts):
            at: list[int] = []
            for x in words(t):
                found = get(x)
                if found is None:
                    found = self.cache[x] = tuple(index[b] for b in buckets(x) if b in index)
                if found:
                    at += found
            at = np.unique(np.array(at, np.int64))  # in fixed order; a term counts once
            s = self.v[at].sum(0)
            z = self.w0 + self.w[at].sum() + 0.5 * ((s * s).sum() - (self.v[at] ** 2).sum())
            out[k] = probability(z)
        return out


class Cells:
    """The ones of a matrix of texts and terms: row and column of each."""

    def __init__(self, at: np.ndarray, col: np.ndarray, rows: int, terms: int):
        self.at, self.col, self.rows, self.terms = at.astype(np.int32), col.astype(np.int32), rows, terms

    def by_row(self, v: np.ndarray) -> np.ndarray:
        return self._summed(self.at, self.col, v, self.rows)

    def by_term(self, r: np.ndarray) -> np.ndarray:
        return self._summed(self.col, self.at, r, self.terms)

    @staticmethod
    def _summed(to: np.ndarray, of: np.ndarray, values: np.ndarray, n: int, chunk: int = 1 << 22) -> np.ndarray:
        out = np.zeros(n)
        for lo in range(0, len(to), chunk):
            out += np.bincount(to[lo : lo + chunk], values[of[lo : lo + chunk]], n)
        return out

    def some(self, terms: np.ndarray) -> Cells:
        mine = terms[self.col]
        return Cells(self.at[mine], (np.cumsum(terms) - 1)[self.col[mine]], self.rows, int(terms.sum()))

    def half(self, rows: np.ndarray) -> Cells:
        mine = rows[self.at]
        return Cells(self.at[mine], self.col[mine], self.rows, self.terms)


def odds(cells: Cells, w0: float, w: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = w0 + cells.by_row(w) - 0.5 * cells.by_row((v * v).sum(0))
    for f in v:
        out += 0.5 * cells.by_row(f) ** 2
    return out


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(cells: Cells, y: np.ndarray, factors: int = FACTORS, steps: int = 150, seed: int = 5) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w and v (factors x terms) by full-batch Adam on the logistic loss with L2; a factor at a time, so memory is a few times the cells."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    par = [np.array([base]), np.zeros(cells.terms), np.random.default_rng(seed).normal(0, 0.05, (factors, cells.terms))]
    l2, m, s = (0.0, 2e-4, 2e-3), [np.zeros_like(q) for q in par], [np.zeros_like(q) for q in par]
    for step in range(1, (steps if cells.terms else 0) + 1):
        w0, w, v = par
        g = (probability(odds(cells, w0[0], w, v)) - y) / len(y)
        gx = cells.by_term(g)
        gv = np.stack([cells.by_term(g * cells.by_row(f)) - gx * f for f in v])
        for k, d in enumerate((np.array([g.sum()]), gx + l2[1] * w, gv + l2[2] * v)):
            m[k] = 0.9 * m[k] + 0.1 * d
            s[k] = 0.999 * s[k] + 0.001 * d * d
            par[k] = par[k] - 0.05 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-9)
    return float(par[0][0]), par[1], par[2]


def clear_alone(cells: Cells, y: np.ndarray) -> np.ndarray:
    """Which terms' rates differ between the labels by more than CLEAR standard errors."""
    n, pos = len(y), y.sum()
    if not pos or pos == n:
        return np.zeros(cells.terms, bool)
    df, df1 = cells.by_term(np.ones(n)), cells.by_term(y)
    p = df / n
    se = np.sqrt(p * (1 - p) * (1 / pos + 1 / (n - pos)))
    return np.abs(df1 / pos - (df - df1) / (n - pos)) > CLEAR * np.maximum(se, 1e-12)


def clear_together(cells: Cells, rest: np.ndarray, seed: int = 5) -> np.ndarray:
    """Which terms interact: factors found on one half of the texts that explain `rest` (label less score) on the other.

    The gradient of the loss by a term's factor is a sum over its texts of rest times the other terms' factors; set again
    and again to what of it stands out, a factor grows along an interaction and vanishes elsewhere.
    """
    rng = np.random.default_rng(seed)
    half, keep = rng.permutation(cells.rows) % 2, np.zeros(cells.terms, bool)

    def part(k):
        return cells.half(half == k), np.where(half == k, rest, 0.0)

    def stands_out(on, r, v):
        s, r2 = on.by_row(v), r * r
        g = on.by_term(r * s) - on.by_term(r) * v  # without the term's own factor
        var = on.by_term(r2 * s * s) - 2 * v * on.by_term(r2 * s) + v * v * on.by_term(r2)
        return g / np.sqrt(np.maximum(var, 1e-12))

    for a, b in ((0, 1), (1, 0)):
        mine, factors = part(a), []
        for _ in range(SCREEN_FACTORS):
            v = rng.normal(size=cells.terms)
            for step in range(len(SCREEN) + 10):
                least = SCREEN[step] if step < len(SCREEN) else 1.3 * least
                z = stands_out(*mine, v)
                v = np.sign(z) * np.maximum(np.abs(z) - least, 0)
                v /= max(np.sqrt(v @ v), 1e-12)
                if step >= len(SCREEN) - 1 and np.count_nonzero(v) <= SUPPORT:
                    break
            if 0 < np.count_nonzero(v) <= SUPPORT:
                factors.append(v)
        mine = None  # one half at a time in memory
        mine = part(b)
        for v in factors:
            keep |= (np.abs(stands_out(*mine, v)) > CLEAR) & (v != 0)
        mine = None
    return keep


def trained(cells: Cells, y: np.ndarray, ids: np.ndarray) -> Machine:
    """The machine over the clear ones of all terms; ids: the hashed term of each column."""
    chosen = clear_alone(cells, y)
    own = cells.some(chosen)
    got = fit(own, y)
    if cells.terms and 0 < y.sum() < len(y):
        more = clear_together(cells, y - probability(odds(own, *got)))
        if (more & ~chosen).any():
            chosen = chosen | more
            got = fit(cells.some(chosen), y)
    w0, w, v = got
    index = {int(i): k for k, i in enumerate(ids[chosen])}
    return Machine(w0, w if index else np.zeros(1), v.T if index else np.zeros((1, FACTORS)), index)


def fitted(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Machine:
    """A machine from documents (doc_id, text) and labels (doc_id, toxic 0 or 1; other values are left out).

    Texts of the same words in the same order count once for each label, so copies make no term clear; of repeated
    doc_ids one text counts. Without labels of both kinds every text gets the same score. The driver holds max_rows
    labels and the hashed terms of as many texts.
    """
    l = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null")
    # at most max_rows ids and labels: small enough for every task, so no text has to move
    some = l.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)

    def run(it):
        known: dict[str, list[int]] = {}
        for b in (p for batch in it for p in parts(batch)):
            found, same = [], []
            for t in b.column(1).to_pylist():
                got: set[int] = set()
                run_of = _WORD.findall((t or "").lower())
                same.append(hashlib.blake2b(" ".join(run_of).encode("utf-8", "surrogatepass"), digest_size=16).digest())
                for x in set(run_of):
                    if (at := known.get(x)) is None:
                        if len(known) > 100_000:
                            known.clear()
                        at = known[x] = buckets(x)
                    got.update(at)
                found.append(sorted(got))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int32())), b.column(2), pa.array(same, pa.binary())], ["doc_id", "terms", "toxic", "same"])

    every = written(texts(docs).join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic").mapInArrow(tidy(run), "doc_id long, terms array<int>, toxic int, same binary"), "labelled")
    single = every.groupBy("doc_id", "toxic").agg(F.min(F.struct("same", "terms")).alias("one"))
    rows = written(single.groupBy("one.same", "toxic").agg(F.min(F.struct("doc_id", "one.terms")).alias("one")).select("one.doc_id", "one.terms", "toxic"), "labelled")
    per = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    ids = np.sort(per.where(F.col("n") >= MIN_TEXTS).select("term").toArrow()["term"].to_numpy().astype(np.int32))

    def common(it):
        for b in it:
            cells = [_places(ids, x) for x in b.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.list_(pa.int32())), b.column(2)], ["doc_id", "at", "toxic"])

    got = rows.select("doc_id", "terms", "toxic").mapInArrow(tidy(common), "doc_id long, at array<int>, toxic int").toArrow()
    dropped(every)
    dropped(rows)
    y, doc_ids = got["toxic"].to_numpy(), got["doc_id"].to_numpy()
    rank = np.empty(len(y), np.int32)
    rank[np.lexsort((y, doc_ids))] = np.arange(len(y), dtype=np.int32)  # one order, however the rows came
    chunks = list(got["at"].chunks)
    del got
    total = sum(len(c.flatten()) for c in chunks)
    at, col, rows_done, done = np.empty(total, np.int32), np.empty(total, np.int32), 0, 0
    for k, c in enumerate(chunks):  # filled in place, each batch let go when it is done
        values, sizes = c.flatten().to_numpy(), c.value_lengths().to_numpy(zero_copy_only=False)
        at[done : done + len(values)] = np.repeat(rank[rows_done : rows_done + len(c)], sizes)
        col[done : done + len(values)] = values
        rows_done, done, chunks[k] = rows_done + len(c), done + len(values), None
    c = values = None
    labels_of = np.empty(len(y))
    labels_of[rank] = y
    return trained(Cells(at, col, len(y), len(ids)), labels_of, ids)


def _places(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the members of ids (sorted) among x stand in it."""
    if not len(ids):
        return np.zeros(0, np.int32)
    at = np.searchsorted(ids, x)
    return at[ids[np.minimum(at, len(ids) - 1)] == x].astype(np.int32)


def scored(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row; null and empty texts get the score of a text without terms."""
    w0, w, v, index = machine.w0, machine.w, machine.v, machine.index

    def run(it):
        m = Machine(w0, w, v, index)
        for b in (p for batch in it for p in parts(batch)):
            s = m.score(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score stays under the threshold; nothing is shuffled."""
    w0, w, v, index, at = machine.w0, machine.w, machine.v, machine.index, docs.columns.index("text")
    bounded(docs.sparkSession)

    def run(it):
        m = Machine(w0, w, v, index)
        for b in (p for batch in it for p in parts(batch, at)):
            yield b.filter(pa.array(m.score(b.column("text").to_pylist()) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD)


def op9_factorization_machine_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = fitted(docs, training_labels(table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD
    return scored(docs, machine).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")
