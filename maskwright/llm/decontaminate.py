"""Benchmark decontamination: every passage of every document queries a BM25 index of the test items by block-max WAND.

Terms are pairs of neighbouring words. An item's impacts are divided by its score against itself, so a passage's score
for an item runs from 0 to 1 and one threshold fits items of any length. Items fall into classes of length, each twice as
long as the one before; a class has postings and passages of its own: windows that overlap by half and span twice the
longest item that the class may hold, so that a copied item lies whole in one of them, and a long item in the index does
not let short ones match words that lie far apart. A window whose terms' largest
impacts add up to less than the threshold can match nothing and is passed over (WAND's bound, taken for all windows of a
batch at once); the others are looked up by block-max WAND, and all items above the threshold are verified by the share
of the question's and of the answer's word pairs that the passage holds.

Items of fewer than MIN_WORDS words have too few pairs to score; a line that holds their words and no others repeats them.

The index goes to every task, so its size is bounded: items are dealt over as many indexes as keep each under
INDEX_BYTES of text, and the documents are read once for each of them. Item count, mean length and the items that hold a
pair are counted over all items before, so scores do not depend on how items are dealt.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, dropped, table, texts, tidy, written
from .words import parts

K1, B, BLOCK, WINDOW, MIN_WORDS = 1.2, 0.75, 16, 128, 4
SCORE, QUESTION, ANSWER, WHOLE = 0.4, 0.5, 0.5, 0.8
INDEX_BYTES = 4_000_000
MATCHES = "doc_id long, item_id long, score double, question double, answer double, passages long, first_word long"
_words = re.compile(r"\w+").findall


def normal_words(text: str | None) -> list[str]:
    return _words((text or "").lower())


def answer_words(text: str) -> int:
    """How many of the item's words belong to its answer: what follows an answer mark, else the last line, else the last sentence; 0 if that is all."""
    body = text.strip()
    for cut in (r"(?is)^.*\banswer\s*[:=]", r"(?s)^.*\n", r"(?s)^.*[.?!]\s+(?=\S)"):
        if (m := re.match(cut, body)) and normal_words(body[: m.end()]) and normal_words(body[m.end() :]):
            return len(normal_words(body[m.end() :]))
    return 0


class Statistics:
    """What BM25 takes from all items: how many there are, their mean pairs, and the items of each pair of words that is in more than
    one (`df`, by the pair's text)."""

    def __init__(self, items: int, mean: float, df: dict[str, int]):
        self.items, self.mean, self.df = items, mean, df

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = [w for w in map(normal_words, texts) if len(w) >= MIN_WORDS]
        df: dict[str, int] = defaultdict(int)
        for w in words:
            for pair in set(pair_texts(w)):
                df[pair] += 1
        return cls(len(words), sum(len(w) - 1 for w in words) / max(1, len(words)), {p: n for p, n in df.items() if n > 1})


def pair_texts(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def window_of(words: int) -> int:
    """The words of a passage for items of so many words: WINDOW, doubled until it spans twice the item."""
    window = WINDOW
    while window < 2 * words:
        window *= 2
    return window


class Index:
    """Items by class of length; build it on the driver, ship it to the tasks. Without statistics the items are all there are."""

    def __init__(self, items: list[tuple[int, str]], statistics: Statistics | None = None):
        every = [(i, t) for i, t in sorted(items) if normal_words(t)]
        items = [(i, t) for i, t in every if len(normal_words(t)) >= MIN_WORDS]
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        for i, t in every:
            if len(w := normal_words(t)) < MIN_WORDS:
                self.short[tuple(w)].append(i)
        self.short = dict(self.short)
        about = statistics or Statistics.of([t for _, t in items])
        words = [normal_words(t) for _, t in items]
        self.vocab = {w: k for k, w in enumerate(sorted({w for x in words for w in x}), 1)}
        self.base = len(self.vocab) + 1
        sizes = [window_of(len(x)) for x in words]
        self.classes = [Postings([(*one, x) for one, x, n in zip(items, words, sizes) if n == size], size, self.vocab, self.base, about) for size in sorted(set(sizes))]


class Postings:
    """Postings of items (id, text, words) of one class of length, whose passages are windows of so many words."""

    def __init__(self, items: list[tuple[int, str, list[str]]], window: int, vocab: dict[str, int], base: int, about: Statistics):
        self.window, self.ids = window, np.array([i for i, _, _ in items], np.int64)
        pairs = [[vocab[a] * base + vocab[b] for a, b in zip(x, x[1:])] for _, _, x in items]
        tail = [answer_words(t) for _, t, _ in items]
        self.question = [set(p[: len(p) - n]) if n else set(p) for p, n in zip(pairs, tail)]
        self.answer = [set(p[len(p) - n :]) if n else set(p) for p, n in zip(pairs, tail)]
        self.postings: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, (p, (_, _, x)) in enumerate(zip(pairs, items)):
            tf: dict[int, int] = defaultdict(int)
            df = {}
            for t, pair in zip(p, pair_texts(x)):
                tf[t] += 1
                df[t] = about.df.get(pair, 1)
            own = {t: np.log(1 + (about.items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(p) / about.mean)) for t, n in sorted(tf.items())}
            total = sum(own.values())
            for t, x in own.items():
                self.postings[t].append((i, float(x / total)))
        self.postings = dict(self.postings)
        self.blocks = {t: [(p[min(k + BLOCK, len(p)) - 1][0], max(x for _, x in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for t, p in self.postings.items()}
        self.codes = np.array(sorted(self.postings), np.int64)
        self.bounds = np.array([max(x for _, x in self.postings[t]) for t in self.codes.tolist()])

    def lookup(self, terms: list[int], threshold: float = SCORE) -> list[tuple[int, float]]:
        """Items (by position) whose score for the distinct terms reaches the threshold, by block-max WAND."""
        lists = [[self.postings[t], self.blocks[t], 0, max(m for _, m in self.blocks[t])] for t in sorted(set(terms)) if t in self.postings]
        out, eps = [], 1e-9
        while lists:
            lists.sort(key=lambda c: c[0][c[2]][0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(lists):
                bound += c[3]
                if bound >= threshold - eps:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = lists[pivot][0][lists[pivot][2]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][2]][0] == item:
                pivot += 1
            tight, ends = 0.0, []
            for c in lists[: pivot + 1]:  # the blocks in which the pivot item would lie
                end, most = next(((e, m) for e, m in c[1][c[2] // BLOCK :] if e >= item), (None, 0.0))
                tight += most
                if end is not None:
                    ends.append(end)
            if tight >= threshold - eps:
                if lists[0][0][lists[0][2]][0] == item:
                    score = sum(c[0][c[2]][1] for c in lists[: pivot + 1])
                    if score >= threshold - eps:
                        out.append((item, score))
                    to = item + 1
                else:
                    to = item
            else:  # no item up to the nearest block end can reach it
                to = min(ends) + 1
                if pivot + 1 < len(lists):
                    to = min(to, lists[pivot + 1][0][lists[pivot + 1][2]][0])
                to = max(to, item + 1)
            for c in lists[: pivot + 1]:
                while c[2] < len(c[0]) and c[0][c[2]][0] < to:
                    block = c[2] // BLOCK
                    c[2] = (block + 1) * BLOCK if c[1][block][0] < to else c[2] + 1
            lists = [c for c in lists if c[2] < len(c[0])]
        return out


def verified(index: Postings, item: int, held: set[int]) -> tuple[float, float] | None:
    q, a = index.question[item], index.answer[item]
    nq, na = len(q & held), len(a & held)
    both = len((q | a) & held) / len(q | a)
    question, answer = nq / len(q) if q else both, na / len(a)
    return (question, answer) if both >= WHOLE or question >= QUESTION and answer >= ANSWER else None


def matches(index: Index, texts: list[str | None], threshold: float = SCORE) -> list[tuple[int, int, float, float, float, int, int]]:
    """(text, item_id, best score, question and answer shares there, passages, first word) for each verified pair."""
    return _long_matches(index, texts, threshold) + (_short_matches(index, texts) if index.short else [])


def _short_matches(index: Index, texts: list[str | None]):
    """Lines that hold a short item's words and no others, as matches of score 1."""
    best: dict[tuple[int, int], list] = {}
    for k, t in enumerate(texts):
        at = 0
        for line in (t or "").split("\n"):
            words = normal_words(line)
            for item in index.short.get(tuple(words), ()) if 0 < len(words) < MIN_WORDS else ():
                best.setdefault((k, item), [1.0, 1.0, 1.0, 0, at])[3] += 1
            at += len(words)
    return [(d, i, *x) for (d, i), x in best.items()]


def _long_matches(index: Index, texts: list[str | None], threshold: float):
    words = [normal_words(t) for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    total = int(sizes.sum())
    if total < 2 or not index.classes:
        return []
    get = index.vocab.get
    ids = np.fromiter((get(w, 0) for x in words for w in x), np.int64, total)
    code = ids[:-1] * index.base + ids[1:]
    code[(ids[:-1] == 0) | (ids[1:] == 0)] = -1
    ends = np.cumsum(sizes)
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < total)] - 1
    code[inner] = -1  # no pair reaches from text to text
    return [row for postings in index.classes for row in _class_matches(postings, code, sizes, ends, threshold)]


def _class_matches(index: Postings, code: np.ndarray, sizes: np.ndarray, ends: np.ndarray, threshold: float):
    total = len(code) + 1
    at = np.minimum(np.searchsorted(index.codes, code), len(index.codes) - 1)
    hit = index.codes[at] == code
    upto = np.concatenate([[0.0], np.cumsum(np.where(hit, index.bounds[at], 0.0))])
    step = index.window // 2
    per = np.maximum(1, -(-(sizes - step) // step))
    doc = np.repeat(np.arange(len(sizes)), per)
    lo = (ends - sizes)[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * step
    hi = np.minimum(lo + index.window, ends[doc])  # words [lo, hi), pairs [lo, hi - 1)
    reach = upto[np.maximum(np.minimum(hi - 1, total - 1), lo.clip(max=total - 1))] - upto[np.minimum(lo, total - 1)]
    best: dict[tuple[int, int], list] = {}
    for k in np.flatnonzero(reach >= threshold - 1e-9).tolist():
        a, b = int(lo[k]), int(hi[k]) - 1
        held = set(code[a:b][hit[a:b]].tolist())
        for item, score in index.lookup(list(held), threshold):
            if (shares := verified(index, item, held)) is None:
                continue
            first = a - int(ends[doc[k]] - sizes[doc[k]])
            if (old := best.get((int(doc[k]), item))) is None:
                best[int(doc[k]), item] = [score, *shares, 1, first]
            else:
                old[3] += 1
                if score > old[0]:
                    old[:3] = [score, *shares]
    return [(d, int(index.ids[i]), *x) for (d, i), x in best.items()]


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> list:
    """Broadcast indexes, each over at most about index_bytes of item texts. Null items, and those without a word, are left out."""
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-size // index_bytes) or 1
    if shards == 1:
        return [spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.collect()]))]  # at most index_bytes

    def pairs(it):
        for b in it:
            words = [normal_words(t) for t in b.column(1).to_pylist()]
            rows = [(s, len(w) - 1, sorted(set(pair_texts(w)))) for s, w in zip(b.column(0).to_pylist(), words) if len(w) >= MIN_WORDS]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))], ["shard", "n", "pairs"])

    bounded(spark)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    held = written(dealt.select("shard", "text").mapInArrow(pairs, "shard long, n long, pairs array<string>"), "item-pairs")
    n, mean = held.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0))).first()
    one = held.select("shard", F.explode("pairs").alias("pair"))
    df = written(one.groupBy("pair").agg(F.count("*").alias("n")).where("n > 1").join(one.distinct(), "pair"), "item-df")
    out = []
    for k in range(shards):  # each at most about index_bytes of texts, and the counts of their pairs
        about = Statistics(n, mean, {r.pair: r.n for r in df.where(F.col("shard") == k).select("pair", "n").collect()})
        out.append(spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in dealt.where(F.col("shard") == k).collect()], about)))
    dropped(held)
    dropped(df)
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = SCORE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and test item that some passage of it repeats; none for clean documents.

    Null and empty texts match nothing; items with equal texts all match. Repeated rows of documents give rows each.
    """
    rows_of = texts(docs)

    def against(index):
        def run(it):
            for b in it:
                for some in parts(b):
                    if rows := matches(index.value, some.column(1).to_pylist(), threshold):
                        cols, ids = list(zip(*rows)), some.column(0)
                        kinds = [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.int64()] * 2
                        cols = [[ids[d].as_py() for d in cols[0]], list(cols[1]), *cols[2:]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in MATCHES.split(", ")])

        return rows_of.mapInArrow(tidy(run), MATCHES)

    out = None
    for index in indexes(items, index_bytes):
        one = against(index)
        out = one if out is None else out.unionByName(one)
    return out


def cleaned(docs: DataFrame, items: DataFrame, threshold: float = SCORE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs, all columns, that repeat no test item; nothing is shuffled."""

    bounded(docs.sparkSession)
    at = docs.columns.index("text")

    def without(docs, index):
        def run(it):
            for b in it:
                for some in parts(b, at):
                    keep = np.ones(len(some), bool)
                    keep[[row[0] for row in matches(index.value, some.column(at).to_pylist(), threshold)]] = False
                    yield some.filter(pa.array(keep))

        return docs.mapInArrow(tidy(run), docs.schema)

    for index in indexes(items, index_bytes):
        docs = without(docs, index)
    return docs


def op2_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
