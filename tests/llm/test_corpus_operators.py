"""Importance resampling, exact dedup and the source audit against plain Python, on rows with the awkward cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.llm import catalog, divergence, exact_dedup, importance

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, "a", "  a  b\n\n\tc ", " a b c ", "A b C\x00d É éß x-1 ２", "same text", "same\ttext", "same text", " ", "\x85  x", "word " * 9000, "İ ﬁ a̸ \U0001f600\U0001f468‍\U0001f469 Ab"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- importance resampling


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def bucket(x):
    return zlib.crc32(x.encode()) % 10000


def plain_resampling(docs, target):
    """[(doc_id, n_features, weight, score)] and {place in docs: rank}."""
    each = [features(t) for _, t in docs]
    s, t = Counter(bucket(x) for _, f in each for x in f), Counter(bucket(x) for x in target for x in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[k] + 1) * (big_s + 10000) / ((s[k] + 1) * (big_t + 10000)))) for k in range(10000)]
    rows = []
    for (i, _), (_, f) in zip(docs, each):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(x)] for x in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = [k for k in range(len(docs)) if each[k][0] >= 20]
    order = sorted(able, key=lambda k: (-rows[k][3], rows[k][0] is None, rows[k][0] or 0))[: 5 * len(able) // 100]
    return rows, {k: r for r, k in enumerate(order, 1)}


def test_resampling_equals_plain_python_on_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows, ranks = plain_resampling(docs, target)
    got = {r.doc_id: tuple(r) for r in importance.op11_importance_resampling(spark, SMALL).collect()}
    assert got == {r[0]: (*r, ranks.get(k)) for k, r in enumerate(rows)}
    assert len(ranks) == 5 * sum(features(t)[0] >= 20 for _, t in docs) // 100 > 0


def test_resampling_of_odd_rows_nulls_and_repeated_ids(spark):
    rng = random.Random(3)
    docs = [(i, t) for i, t in enumerate(ODD)] + [(7, "w " * 25), (7, "w " * 25), (None, "w " * 25), (None, None)]
    docs += [(100 + k, " ".join(rng.choice("abcdefgh") for _ in range(30))) for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "rank", "score", "words", "part", "bucket")})
    target = spark.createDataFrame([(1, "a b c"), (2, None), (3, "")], "item_id long, text string")
    rows, ranks = plain_resampling(docs, ["a b c"])
    got = importance.resampled(df.repartition(3), target).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(rows)
    assert sorted((r.rank, r.score) for r in got if r.rank) == [(n, rows[k][3]) for k, n in sorted(ranks.items(), key=lambda x: x[1])]
    assert [c for c, _ in importance.resampled(df, target).dtypes] == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resampled(none, some).count() == 0
    assert [(r.doc_id, r.n_features, r.weight) for r in importance.resampled(some, none).orderBy("doc_id").collect()] == [(i, n, w) for i, n, w, _ in plain_resampling([(1, "a b"), (2, None)], [])[0]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abAB 1.\n-éß２")), max_size=40), min_size=1, max_size=6), st.integers(4, 60))
def test_blocks_hold_the_counts_of_every_run(rows, most):
    words, starts, where, counts = importance.block_of([t.encode() for t in rows], most=most)  # lists as short as a few bytes
    for k, t in enumerate(rows):
        n, f = features(t)
        assert words[k] == n
        assert dict(zip(where[starts[k] : starts[k + 1]], counts[starts[k] : starts[k + 1]])) == Counter(map(bucket, f))


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=20), st.integers(0, 100_000))
def test_crcs_move_over_appended_bytes(head, n):
    shift = importance.Shifts()
    tail = bytes(n)
    assert int(shift(np.array([zlib.crc32(head)], np.uint32), np.array([n]))[0]) ^ zlib.crc32(tail) == zlib.crc32(head + tail)


# ---- exact dedup


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_classes(docs):
    """Of each (id, text): (id, keep_id, size, sha); and how many rows of each text stay (one)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[plain(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return Counter((i, keep[plain(t)], len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in docs)


COPIES = [(i, t) for i, t in enumerate(ODD)] + [(50, "same text"), (6, "same text"), (6, "same  text"), (None, "same text"), (None, "only nulls"), (None, "only nulls")] + [(1000 + k, "hot") for k in range(300)]


@pytest.mark.parametrize("share", [exact_dedup.SHARE, 4, 1])
@pytest.mark.parametrize("bits", [None, 1])
def test_classes_equal_plain_python(spark, share, bits):
    """Hot groups by broadcast and by the join, and a digest of 16 values, which most texts share with others."""
    digest = exact_dedup.sha256 if bits is None else lambda t: F.substring(F.sha2(t, 256), 1, bits)
    docs = spark.createDataFrame(COPIES, "doc_id long, text string").repartition(7).withColumns({c: F.lit("z") for c in ("digest", "salt", "n", "own", "place", "kept")})
    got = exact_dedup.classes(docs, digest=digest, salts=3, share=share).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain_classes(COPIES)
    kept = [r for r in got if r.kept]
    assert Counter(r.text_sha256 for r in kept) == Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in {plain(t) for _, t in COPIES}})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_deduplicated_keeps_whole_rows(spark):
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(COPIES)], "doc_id long, text string, key long").repartition(5)
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({plain(t) for _, t in COPIES}) == len({plain(r.text) for r in rows})
    assert all((r.doc_id, r.text) == COPIES[r.key] for r in rows)
    assert exact_dedup.classes(docs.limit(0)).count() == exact_dedup.deduplicated(docs.limit(0)).count() == 0


def test_dedup_stays_in_the_jvm(spark):
    """Neither Python nor Arrow, and no sort of texts: the aggregates hash."""
    docs = spark.createDataFrame(COPIES, "doc_id long, text string")
    rows = docs.select(exact_dedup.sha256(exact_dedup.normalized(F.col("text"))).alias("digest"), "text", "doc_id")
    plan = exact_dedup.combined(rows)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|SortAggregate", plan)
    assert plan.count("HashAggregate") == 4


# ---- source divergence


def plain_audit(docs, least=30, ranks=50):
    c, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        g = (lang or "", source or "")
        groups.add(g)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        c[g].update(terms)
        df[g[0]].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for l, s in groups if l == lang]
        n = {s: sum(c[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (c[lang, s][t] + 5) // (n[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(c[lang, s][t] for s in sources) + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        pairs = [(s, sum(abs(p[source][t] - p[s][t]) for t in kept)) for s in sources if s != source]
        terms = [(t, p[source][t] - q[t]) for t in kept if c[lang, source][t] > 0 and p[source][t] > q[t]]
        for part, rows, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            out |= {(lang, source, part, i, v, k) for k, (i, v) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0].encode()))[:most], 1)}
    return out


def _texts(rng, n):
    words = ["ab", "Ab", "cd", "é", "ß", "zz", "İx", "日本", "q1w", "rare"] + [f"t{chr(97 + k)}" for k in range(20)]
    return " ".join(rng.choice(words) for _ in range(n))


def _corpus():
    rng = random.Random(5)
    docs = [(rng.choice(["en", "en", "EN", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None, "", "é"]), _texts(rng, rng.choice([0, 1, 3, 12]))) for _ in range(400)]
    return docs + [("en", "s3", None), ("xx", "a", "ab"), ("xx", "b", ""), ("xx", "a", None), ("en", "s9", "ab " * 5000)]


@pytest.mark.parametrize("least", [30, 1, 10_000])
def test_audit_equals_plain_python(spark, least):
    docs = _corpus()
    df = spark.createDataFrame([(k % 7 or None, *d) for k, d in enumerate(docs)], "doc_id long, lang string, source string, text string").repartition(5).withColumns({c: F.lit(1) for c in ("document", "term", "df", "n", "tile", "rank")})
    got = divergence.audit(df, least=least, ranks=4)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_audit(docs, least, 4)
    assert dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"


def test_audit_with_little_room(spark, monkeypatch):
    """Scans that hold few cells hand pairs out as they go, and parts of texts and of ranges meet again."""
    for name, n in (("CELLS", 5), ("PIECE_BYTES", 50), ("SCAN_ROWS", 3)):
        monkeypatch.setattr(divergence, name, n)
    runs = divergence.Runs()
    runs.add([b"ab cd ab", b"", b"x " * 90 + b"ab"], [("l", "s"), ("l", "t"), ("l", "s")], np.array([7, 8, 9]))
    runs.add([b"cd x"], [("l", "t")], np.array([3]))
    found = [r for b in runs.batches(2) for r in b.to_pylist()]
    assert sorted(tuple(r.values()) for r in found) == [("l", "ab", "s", 7, 2, 3), ("l", "cd", "s", 7, 1, 1), ("l", "cd", "t", 3, 1, 1), ("l", "x", "s", 9, 1, 90), ("l", "x", "t", 3, 1, 1)]
    rows = [("l", "ab", "s", 1, 5), ("l", "ab", "s", 1, 1), ("l", "ab", "s", 1, 1), ("l", "ab", "t", 1, 2), ("l", "b", "s", 3, 3), ("m", "b", "s", 2, 9), ("m", "b", "t", 2, 1)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("lang", "term", "source", "df", "n"), r))]) for r in rows]
    assert [tuple(r.values()) for b in divergence.scanned(batches, 4) for r in b.to_pylist()] == [("l", "ab", "s", 7), ("l", "ab", "t", 2), ("m", "b", "s", 9), ("m", "b", "t", 1)]
    share = divergence.Share(2)
    for s, n in (("a", 4), ("b", 6), ("c", 0)):
        share.source(s, n, 3)
    share.ready()
    assert [share.term(*x) for x in (("t", [("a", 1)]), ("u", [("a", 3), ("b", 2)]), ("v", [("b", 4)]))] == [False, True, True]
    sums = np.zeros((3, 3), np.int64)
    for a, row, column in share.pairs():
        sums[a] += row
        sums[:, a] += column
    sums += 3 * np.abs(share.absent[:, None] - share.absent)
    p = [[1 + 10**9 * (c + 5) // (n + 15) for c in row] for row, n in (((1, 3, 0), 4), ((0, 2, 4), 6), ((0, 0, 0), 0))]
    assert sums.tolist() == [[sum(abs(x - y) for x, y in zip(a, b)) for b in p] for a in p]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**12), st.integers(0, 10**12), st.integers(1, 10**6))
def test_shares_are_exact(count, more, v):
    assert int(divergence.shares(np.array([count]), count + more, v)[0]) == 1 + 10**9 * (count + 5) // (count + more + 5 * v)


def test_audit_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "doc_id long, lang string, source string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op12_salted_exact_dedup", "op13_sorted_run_divergence"])
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    want = duckdb.connect().sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'; " + catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SMALL)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
