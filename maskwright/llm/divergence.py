"""How far the sources of a language differ in their words, by sorted runs.

Every occurrence is a row (lang, term, source, document), sorted; runs of equal rows are counted by scanning: a run of
one document is its count of the term, a run of one term its document frequency and counts by source. This is done
twice: within a task over TASK_BYTES of texts at a time, whose runs alone go on, and then over those of all tasks, dealt
by (lang, term) and sorted by (lang, term, source, document). However common a term is, it is one row for each source
and TASK_BYTES of text there, so no key is hot; the scan streams and holds the sources of one term.

The kept terms are dealt out once more, by (lang, hash of the term), each share led by a row for each source of the
language. A scan turns every term's run into shares of the sources, adds the differences of each pair up, and holds the
foremost terms of each source; what a share sends on is one row a pair, and RANKS terms a source.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, finished, table, tidy, written
from .words import slices

LEAST_DOCUMENTS, SMOOTH, SCALE, RANKS = 30, 5, 1_000_000_000, 50
#: bytes of texts that are sorted together, and whose runs a task merges before they go on; cells of terms by sources, or of pairs, that a scan holds
PIECE_BYTES, TASK_BYTES, CELLS = 8_000_000, 64_000_000, 2_000_000
#: rows of an Arrow batch that are sorted together: twelve bits of a key name the row, twelve its group and the rest the term
ROWS = (1 << 12) - 1
#: rows that a scan looks at together, and kept rows that make a share worth while
SCAN_ROWS, SHARE_ROWS = 100_000, 20_000
RUNS = "lang string, term string, source string, document long, df long, n long"

#: letters and all that is not ASCII; other bytes are blanks
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def term_lists(text: bytes, most: int = PIECE_BYTES):
    """The terms of a text, A to Z in lower case, in lists of about `most` bytes."""
    plain = text.lower().translate(_TERM_BYTES)
    at = 0
    while at < len(plain):
        end = len(plain) if len(plain) - at <= most else plain.find(b" ", at + most)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def firsts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.ones(len(sorted_columns[0]), bool)
    if len(new):
        new[1:] = False
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Runs:
    """The runs of some texts: distinct (lang, source) groups and terms, and for each run of both the first document, how many
    documents hold it, and how often."""

    def __init__(self):
        self.terms, self.groups, self.held, self.found = pa.array([], pa.binary()), {}, 0, []

    def add(self, texts: list[bytes], groups: list[tuple[str, str]], documents: np.ndarray):
        """One sort for each PIECE_BYTES of text; a text may lie in several."""
        group = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        local, mine = np.unique(group, return_inverse=True)
        cells, words, sizes, size = [], [], [], 0

        def counted():
            coded = pa.array(words, pa.binary()).dictionary_encode()
            fresh = coded.dictionary.filter(pc.invert(pc.is_in(coded.dictionary, self.terms)))
            self.terms = pa.concat_arrays([self.terms, fresh])
            term = pc.index_in(coded.dictionary, self.terms).to_numpy().astype(np.int64)[coded.indices.to_numpy()]
            row = np.repeat(np.array([k for k, _ in sizes], np.int64), [n for _, n in sizes])
            key = np.sort((mine[row] << 51) + (term << 12) + row)
            at = firsts(key)
            cells.append((key[at], np.diff(np.append(at, len(key)))))
            words.clear()
            sizes.clear()

        for k, text in enumerate(texts):
            for some in term_lists(text):
                words.extend(some)
                sizes.append((k, len(some)))
                size += min(len(text), PIECE_BYTES)
                if size >= PIECE_BYTES and words:
                    counted()
                    size = 0
            self.held += len(text)
        if words:
            counted()
        if not cells:
            return
        key, n = merged(np.concatenate([c for c, _ in cells]), np.concatenate([c for _, c in cells]))  # a long text's parts meet here
        at = firsts(key >> 12)
        self.found.append((local[key[at] >> 51] << 40 | key[at] >> 12 & (1 << 39) - 1, documents[key[at] & ROWS], np.diff(np.append(at, len(key))), np.add.reduceat(n, at)))

    def batches(self, rows: int = 100_000):
        """The runs as Arrow batches of RUNS."""
        if self.found:
            key, document, df, n = (np.concatenate(x) for x in zip(*self.found))
            order = np.argsort(key, kind="stable")
            key, document, df, n = key[order], document[order], df[order], n[order]
            at = firsts(key)
            key, document, df, n = key[at], document[at], np.add.reduceat(df, at), np.add.reduceat(n, at)
            lang, source = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
            terms = self.terms.cast(pa.string())
            for lo in range(0, len(key), rows):
                some = slice(lo, lo + rows)
                group, term = pa.array(key[some] >> 40), pa.array(key[some] & (1 << 40) - 1)
                cols = [lang.take(group), terms.take(term), source.take(group), *(pa.array(x[some]) for x in (document, df, n))]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "term", "source", "document", "df", "n"])


def merged(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys once, in order, with the sums of their numbers."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = firsts(key)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def partial_runs(docs: DataFrame) -> DataFrame:
    """RUNS of each task's texts (of TASK_BYTES of them, if it has more): of each (lang, term, source) there the first document,
    how many hold it and how often."""
    bounded(docs.sparkSession)

    def work(it):
        runs = Runs()
        for b in it:
            for lo in range(0, len(b), ROWS):
                some = b.slice(lo, ROWS)
                raw = some.column(3).cast(pa.binary())
                for x, y in slices(raw, PIECE_BYTES):
                    lang, source, ids = (some.column(k).slice(x, y - x) for k in range(3))
                    runs.add(raw.slice(x, y - x).to_pylist(), list(zip(lang.to_pylist(), source.to_pylist())), ids.fill_null(-1).to_numpy())
                    if runs.held >= TASK_BYTES:
                        yield from runs.batches()
                        runs = Runs()
        yield from runs.batches()

    return docs.select("lang", "source", "document", "text").mapInArrow(tidy(work), RUNS)


def scanned(batches, least: int):
    """Of Arrow batches (lang, term, source, df, n), sorted, in which no (lang, term) goes on elsewhere: (lang, term, source, n) of the
    terms with at least `least` documents. Of a term that goes on in the next rows only the sums of its sources are held."""

    def starts(table, *names):
        new = np.ones(len(table), bool)
        for k, c in enumerate(names):
            differs = pc.not_equal(table[c].slice(1), table[c].slice(0, len(table) - 1)).combine_chunks().to_numpy(zero_copy_only=False)
            new[1:] = differs if k == 0 else new[1:] | differs
        return np.flatnonzero(new)

    def collapsed(table):
        """One row for each (lang, term, source)."""
        at = starts(table, "lang", "term", "source")
        df, n = (pa.array(np.add.reduceat(table[c].to_numpy(), at)) for c in ("df", "n"))
        return pa.table([*(table[c].take(pa.array(at)) for c in ("lang", "term", "source")), df, n], ["lang", "term", "source", "df", "n"])

    def done(table):
        at = starts(table, "lang", "term")
        kept = np.repeat(np.add.reduceat(table["df"].to_numpy(), at) >= least, np.diff(np.append(at, len(table))))
        return table.select(["lang", "term", "source", "n"]).filter(pa.array(kept)).combine_chunks().to_batches()

    held, size = [], 0
    for b in batches:
        if len(b):
            held.append(pa.table(b))
            size += len(b)
        if size >= SCAN_ROWS:
            now = collapsed(pa.concat_tables(held))
            last = int(starts(now, "lang", "term")[-1])
            if last:
                yield from done(now.slice(0, last))
            held, size = [now.slice(last)], 0
    if held:
        yield from done(collapsed(pa.concat_tables(held)))


def kept_terms(partial: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, source, n) of the terms that at least `least` documents of the language hold."""
    # the hash goes first in the order, as comparing it settles most comparisons; a term's rows still lie together
    order = ["hash", "lang", "term", "source", "document"]
    dealt = partial.repartition("lang", "term").withColumn("hash", F.xxhash64("lang", "term")).sortWithinPartitions(*order)
    return dealt.select("lang", "term", "source", "df", "n").mapInArrow(tidy(lambda it: scanned(it, least)), "lang string, term string, source string, n long")


def shares(count: np.ndarray, n: np.ndarray | int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (n + SMOOTH * v)), exact as long as n stays under 10 ** 13: one digit group after the other."""
    over, under = np.asarray(count, np.int64) + SMOOTH, np.asarray(n, np.int64) + SMOOTH * v
    high, rest = np.divmod(over * 10_000, under)
    return 1 + high * (SCALE // 10_000) + rest * (SCALE // 10_000) // under


class Share:
    """One (lang, tile): the sources come first, then runs of terms; pairs and terms are handed out at the end."""

    def __init__(self, ranks: int):
        self.sources, self.sizes, self.v, self.ranks = [], [], 0, ranks
        self.cells: list[tuple[int, int, int]] = []
        self.terms: list[str] = []
        self.foremost: list[list] = []
        self.sums = None

    def source(self, name: str, size: int, v: int):
        self.sources.append(name)
        self.sizes.append(size)
        self.v = v

    def ready(self):
        self.at = {s: k for k, s in enumerate(self.sources)}
        self.n = np.array(self.sizes, np.int64)
        self.absent = shares(np.zeros(len(self.n)), self.n, self.v) if self.v else np.ones(len(self.n), np.int64)
        self.foremost = [[] for _ in self.sources]
        self.done = 0

    def term(self, term: str, rows: list[tuple[str, int]]):
        k = len(self.terms)
        self.terms.append(term)
        self.cells += [(k, self.at[s], n) for s, n in rows]
        return len(self.terms) * len(self.sources) > CELLS

    def pairs(self):
        """(source, item, difference over the terms held), and forget them. Terms that neither of two sources has come last, by their number."""
        if not self.terms:
            return
        size, many = len(self.sources), len(self.terms)
        at, who, n = np.array(self.cells, np.int64).T
        p = np.tile(self.absent, (many, 1))
        p[at, who] = shares(n, self.n[who], self.v)
        here = np.zeros((many, size), bool)
        here[at, who] = True
        all_n = np.bincount(at, n, many).astype(np.int64)
        q = shares(all_n, int(self.n.sum()), self.v)
        for a in range(size):
            mine = np.flatnonzero(here[:, a])
            value = p[mine, a] - q[mine]
            some = [(-int(f), self.terms[k]) for f, k in zip(value, mine) if f > 0]
            self.foremost[a] = heapq.nsmallest(self.ranks, self.foremost[a] + some)
            # against sources that lack a term too, a pair's difference is that of the absent shares, which is added once for all
            base = np.abs(self.absent[a] - self.absent)
            more = np.abs(p[mine, a][:, None] - p[mine]) - base
            yield a, more.sum(0), (more * ~here[mine]).sum(0)
        self.done += many
        self.terms, self.cells = [], []


def compared(kept: DataFrame, groups: DataFrame, ranks: int = RANKS, tiles: int | None = None) -> DataFrame:
    """(lang, source, part, item, value): partial sums of pairs, and the foremost terms of each share. groups: (lang, source, size, v).

    A language has as many shares as the kept rows call for, and no more than there are shuffle partitions."""
    tiles = tiles or max(1, min(kept.count() // SHARE_ROWS, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lead = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"), F.lit("").alias("term"), "source", F.col("size").alias("n"), "v")
    runs = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(tiles)).cast("int").alias("tile"), "term", "source", "n", F.lit(0).cast("long").alias("v"))
    rows = lead.unionByName(runs).repartition("lang", "tile").sortWithinPartitions("lang", "tile", "term", "source")

    def work(it):
        out: list[tuple] = []

        def batch():
            cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["lang", "source", "part", "item", "value"])

        def flushed(lang, share):
            small = len(share.sources) ** 2 <= CELLS
            if small and share.sums is None:
                share.sums = np.zeros((len(share.sources),) * 2, np.int64)
            for a, row, column in share.pairs():
                if small:
                    share.sums[a] += row
                    share.sums[:, a] += column
                else:
                    for b, s in enumerate(share.sources):
                        if b != a:
                            out.extend(((lang, share.sources[a], "pair", s, int(row[b])), (lang, s, "pair", share.sources[a], int(column[b]))))
                    if len(out) > 50_000:
                        yield batch()

        def closed(lang, tile, share):
            yield from flushed(lang, share)
            for a, s in enumerate(share.sources):
                out.extend((lang, s, "term", t, -f) for f, t in share.foremost[a])
                if share.done or tile == 0:  # a language without kept terms still has its pairs
                    value = share.done * np.abs(share.absent[a] - share.absent) + (share.sums[a] if share.sums is not None else 0)
                    out.extend((lang, s, "pair", o, int(value[b])) for b, o in enumerate(share.sources) if b != a)
                if len(out) > 50_000:
                    yield batch()

        now, share, lead = None, None, True
        for lang, tile, term, rows in _tiled(it):
            if (lang, tile) != now:
                if share is not None:
                    yield from closed(*now, share)
                now, share, lead = (lang, tile), Share(ranks), True
            if term == "":
                for s, n, v in rows:
                    share.source(s, n, v)
                share.ready()
            elif share.term(term, [(s, n) for s, n, _ in rows]):
                yield from flushed(lang, share)
        if share is not None:
            yield from closed(*now, share)
        yield batch()

    return rows.mapInArrow(tidy(work), "lang string, source string, part string, item string, value long")


def _tiled(it):
    """(lang, tile, term, rows) by runs of (lang, tile, term)."""
    def keyed():
        for b in it:
            both = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            yield both, [c.to_pylist() for c in b.columns[2:]]

    key, rows = None, []
    for both, (terms, *rest) in keyed():
        for pair, term, *row in zip(both, terms, *rest):
            if (pair, term) != key:
                if key is not None:
                    yield *key[0], key[1], rows
                key, rows = (pair, term), []
            rows.append(tuple(row))
    if key is not None:
        yield *key[0], key[1], rows


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", tiles: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): of every (lang, source) of docs how it differs from the language's other sources
    (part pair, all of them) and by which terms most (part term, up to `ranks`).

    Null text, lang and source count as ''. Terms are runs of letters and of all that is not ASCII; a language keeps the terms
    of at least `least` documents, rows that is: repeated and null doc_ids are documents of their own. Groups without a kept term
    have pairs too, by smoothing alone, and value 0 if the language keeps none. An empty table gives no rows; other columns are
    not looked at.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), F.col(id_col).cast("long").alias("document"), text(text_col).alias("text"))
    kept = written(kept_terms(partial_runs(rows), least), "kept-terms")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    many = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("v"))
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("rows")).join(sizes, ["lang", "source"], "left").join(many, "lang", "left")
    groups = written(groups.select("lang", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("v", F.lit(0)).cast("long").alias("v")), "groups")
    found = compared(kept, groups, ranks, tiles).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item").asc())
    return found.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= ranks))


ORACLE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT i) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term HAVING sum(df) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS size FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS size FROM g LEFT JOIN (SELECT c.* FROM c JOIN k USING (lang, term)) c USING (lang, source) GROUP BY ALL),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.size + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.size + 5 * l.v) AS q
  FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y USING (lang, term) WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""


def op13_sorted_run_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: audit(table(spark, sf_dir, "documents")), "op13")
