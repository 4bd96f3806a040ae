"""Secret scans in DataFrame expressions only: fixed patterns, and a battery of randomness tests with FDR control.

Patterns (kinds assign, access, hex) give the base spans. The battery looks at every other run of at least MIN_CHARS
characters of the usual encodings, and at what is left of a run beside a base span, infers its encoding, and tests it
three ways against its alphabet of k symbols. A run that no encoding fits is tested by parts (see `pieces`). The tests:
    chi-squared   uniformity of the symbols,
    runs          of symbols in the lower and upper half of the alphabet (Wald-Wolfowitz),
    serial        correlation of neighbouring symbols' places in the alphabet.
What is sought are strings that ARE random, so each test's null hypothesis is a departure at least as large as text or
counters show (DEPARTURE for chi-squared as a share of n, EFFECT for the other two); a string is random by a test if the
departure is significantly smaller. Short strings cannot show that, long ones can: the length decides how strong the
evidence is. The three are combined by their largest p-value (all must hold). Benjamini-Hochberg at rate FDR sets a cut for
each class of lengths (from 2^c to under 2^(c+1) characters) over the candidates of all documents, so the many short ones
neither drown nor carry the long ones. For it p-values are rounded up, to a multiple of 1/BINS or a power of
10**(1/DECADE), whichever is nearer: small ones keep their strength, and the histogram has a bounded number of rows,
whatever the corpus.

Arrays grow by copying, so whatever walks along a text's matches does it in blocks of the root of their number (`folded`),
and texts are cut out of chunks: some tens of thousands of secrets in a text of megabytes take seconds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import finished, table, written

ASSIGN = (
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
CODE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
MIN_CHARS, BINS, FDR, EFFECT = 20, 10_000, 0.05, 0.5
#: Steps of a decade for small p-values, and the z-score beyond which nothing counts as stronger (p about 1e-89).
DECADE, FAR = 100, 20.0
#: code points of a chunk of text to splice from
CHUNK = 1024
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: name, what the whole string must match, alphabet in order, departure of ordinary strings (chi-squared / n)
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", DIGITS + "abcdef", 0.6),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", DIGITS + "ABCDEF", 0.6),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", UPPER + "234567", 1.0),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", DIGITS + LOWER, 1.0),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", DIGITS + UPPER, 1.0),
    ("letters", r"^(?=.*[a-z])(?=.*[A-Z])[A-Za-z]+$", UPPER + LOWER, 1.5),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9]+$", DIGITS + UPPER + LOWER, 1.5),
    ("base64", r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/", 1.5),
    ("base64url", r"^(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_", 1.5),
)
SPAN = "struct<start:bigint,kind:int,end:bigint>"


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution: a logistic curve (within 0.0002), below -2 Sampford's bound (above the true value by at most 0.3 %)."""
    z = F.greatest(F.least(z, F.lit(8.0)), F.lit(-FAR))
    curve = lambda z: 1 / (1 + F.exp(-(1.5976 * z + 0.070566 * z * z * z)))
    tail = 4 / math.sqrt(2 * math.pi) * F.exp(-z * z / 2) / (F.sqrt(z * z + 8) - 3 * z)
    return F.when(z < -2, F.least(tail, curve(F.lit(-2.0)))).otherwise(curve(z))


def rounded_up(p: Column) -> Column:
    """p as the Benjamini-Hochberg histogram holds it."""
    return F.least(F.ceil(p * BINS) / BINS, F.pow(F.lit(10.0), F.ceil(F.log10(p) * DECADE) / DECADE))


def let(value: Column, body) -> Column:
    """`value` worked out once and used in body."""
    return F.transform(F.array(value), body)[0]


def folded(items: Column, state: Column, kind: str, step) -> Column:
    """All that step(state, item), a pair of the next state and an array<kind>, gives along the items, one after another."""
    none = F.array().cast(f"array<{kind}>")

    def one(acc, x):
        after, got = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["got"], got).alias("got"))

    def block(acc, some):
        mine = F.aggregate(some, F.struct(acc["state"].alias("state"), none.alias("got")), one)
        return let(mine, lambda m: F.struct(m["state"].alias("state"), F.concat(acc["got"], m["got"]).alias("got")))

    def over(items):
        size = F.ceil(F.sqrt(F.size(items))).cast("int")
        blocks = F.transform(F.sequence(F.lit(1), F.size(items), size), lambda k: F.slice(items, k, size))
        return F.when(F.size(items) > 0, F.aggregate(blocks, F.struct(state.alias("state"), none.alias("got")), block, lambda a: a["got"])).otherwise(none)

    return let(items, over)


def found(text: Column, pattern: str, group: int | None = None) -> Column:
    """All matches as (start, end, value, group) in code points, from the matches and the stretches between them."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    rows = let(hits, lambda h: F.arrays_zip(h.alias("hit"), F.slice(gaps, 1, F.size(h)).alias("gap"), (inner if group else h).alias("inner")))

    def step(at, x):
        a = at + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return b, F.array(F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("value"), x["inner"].alias("part")))

    return folded(rows, F.lit(0).cast("bigint"), "struct<start:bigint,end:bigint,value:string,part:string>", step)


def randomness(value: Column) -> Column:
    """The combined p-value of a string, small if it is random; null if no encoding fits."""
    which = None
    for _, shape, alphabet, departure in ENCODINGS:
        one = F.struct(F.lit(alphabet).alias("alphabet"), F.lit(len(alphabet)).alias("k"), F.lit(departure).alias("departure"))
        which = F.when(value.rlike(shape), one) if which is None else which.when(value.rlike(shape), one)
    places = lambda e: F.transform(F.split(value, ""), lambda c: F.instr(e["alphabet"], c) - 1)
    return let(which, lambda e: F.when(e.isNotNull(), _battery(places(e), e["k"], e["departure"])))


def fits(value: Column) -> Column:
    out = F.lit(False)
    for _, shape, *_ in ENCODINGS:
        out = out | value.rlike(shape)
    return out


ITEM = "struct<start:bigint,end:bigint,value:string>"


def _at(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))


def beside(runs: Column, base: Column) -> Column:
    """What is left of the runs (start, end, value) beside the base spans (start, kind, end), where long enough; one walk along both."""
    item = lambda x, kind, value: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), value.alias("value"))
    last = F.struct(*(F.lit(2**62).cast("bigint").alias(c) if c != "kind" else F.lit(0).alias(c) for c in ("start", "kind", "end")), F.lit("").alias("value"))
    both = F.array_sort(F.concat(F.transform(base, lambda b: item(b, 0, F.lit(""))), F.transform(runs, lambda r: item(r, 1, r["value"])), F.array(last)))
    none = F.array().cast(f"array<{ITEM}>")
    zero = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("cover", "first", "at", "end")), F.lit("").alias("value"))

    def step(s, x):
        """The open run is left from `at` to `end`; a base span or the next run takes what lies before it."""
        upto = F.least(x["start"], s["end"])
        piece = F.array(_at(s["at"], upto, F.substring(s["value"], (s["at"] - s["first"] + 1).cast("int"), (upto - s["at"]).cast("int"))))
        cover = F.greatest(s["cover"], x["end"])
        after = F.when(x["kind"] == 0, F.struct(cover.alias("cover"), s["first"].alias("first"), F.greatest(s["at"], x["end"]).alias("at"), s["end"].alias("end"), s["value"].alias("value")))
        after = after.otherwise(F.struct(s["cover"].alias("cover"), x["start"].alias("first"), F.greatest(x["start"], s["cover"]).alias("at"), x["end"].alias("end"), x["value"].alias("value")))
        return after, F.when(upto - s["at"] >= MIN_CHARS, piece).otherwise(none)

    return F.when(F.size(runs) > 0, folded(both, zero, ITEM, step)).otherwise(none)


def pieces(run: Column) -> Column:
    """What of a run is tested: all of it where an encoding fits.

    Otherwise its stretches between '/' and '+', between '-' and '_', and between any of the four that an encoding fits, and
    each stretch between '/' and '+' that yields none without its separators (UUIDs, keys in groups), or so the whole run.
    """
    none = F.array().cast(f"array<{ITEM}>")

    def moved(of, pattern):
        return F.transform(found(of["value"], pattern), lambda m: _at(of["start"] + m["start"], of["start"] + m["end"], m["value"]))

    def joined(of):
        return _at(of["start"], of["end"], F.regexp_replace(of["value"], "[-_/+]", ""))

    def usable(items):
        return F.filter(items, lambda p: (F.length(p["value"]) >= MIN_CHARS) & fits(p["value"]))

    def segment(of):
        parts = usable(moved(of, "[A-Za-z0-9]{%d,}" % MIN_CHARS))
        tried = F.when(fits(of["value"]), F.array(of)).when(F.size(parts) > 0, parts)
        return tried.otherwise(usable(F.array(joined(of))))

    by_slash = F.flatten(F.transform(moved(run, "[A-Za-z0-9_-]{%d,}" % MIN_CHARS), segment))
    by_dash = usable(moved(run, "[A-Za-z0-9+/]{%d,}" % MIN_CHARS))
    some = F.transform(F.array(F.array_distinct(F.concat(by_slash, by_dash))), lambda s: F.when(F.size(s) > 0, s).otherwise(usable(F.array(joined(run)))))[0]
    return F.when(fits(run["value"]), F.array(_at(run["start"], run["end"], run["value"]))).otherwise(F.coalesce(some, none))


def _battery(x: Column, k: Column, departure: Column) -> Column:
    half = F.floor(k / 2)

    def whole(x):
        n = F.size(x).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(x, lambda y: y == c)), F.lit(2.0)))
        chi = k / n * squares - n
        p_chi = normal_cdf((chi - (k - 1) - n * departure) / F.sqrt(2.0 * (k - 1) + 4.0 * n * departure))
        start = F.struct(*(F.lit(0.0).alias(c) for c in ("high", "runs", "s", "ss", "sxy")), F.lit(-1).alias("prev"))

        def step(a, c):
            high, before = (c >= half).cast("double"), (a["prev"] >= half).cast("double")
            new = ((a["prev"] < 0) | (high != before)).cast("double")
            v = c.cast("double")
            pair = F.when(a["prev"] < 0, 0.0).otherwise(v * a["prev"])
            return F.struct((a["high"] + high).alias("high"), (a["runs"] + new).alias("runs"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), (a["sxy"] + pair).alias("sxy"), c.alias("prev"))

        def rest(a):
            low = n - a["high"]
            mean = 2 * a["high"] * low / n + 1
            var = (mean - 1) * (mean - 2) / (n - 1)
            z_runs = F.when(var > 1e-9, F.abs((a["runs"] - mean) / F.sqrt(var))).otherwise(F.lit(8.0))
            first, last = x[0].cast("double"), a["prev"].cast("double")
            m = a["s"] / n
            spread = a["ss"] - n * m * m
            r = F.when(spread > 1e-9, (a["sxy"] - m * (2 * a["s"] - first - last) + (n - 1) * m * m) / spread).otherwise(F.lit(1.0))
            p_runs = normal_cdf(z_runs - EFFECT * F.sqrt(n))
            p_serial = normal_cdf((F.abs(r) - EFFECT) * F.sqrt(n))
            return F.greatest(p_chi, p_runs, p_serial)

        return F.aggregate(x, start, step, rest)

    return let(x, whole)


def scanned(docs: DataFrame, carry: bool = False) -> DataFrame:
    """The rows of docs (doc_id, text) with `base` spans and `tried`: candidates and their p-values. Null texts are empty.

    With carry each has its whole row of docs in `row`.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,part:string>>")
    has_assign = text.rlike(ASSIGN)

    def spans(kind, matches):
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    assign = F.filter(F.when(has_assign, found(text, ASSIGN, 2)).otherwise(none), lambda m: F.length(m["part"]) >= 8)
    access = F.when(text.contains("AKIA"), found(text, ACCESS.replace("+", "{12,}"))).otherwise(none)
    hexes = F.when(text.rlike("[0-9a-f]{32}"), found(text, HEX.replace("+", "{32,}"))).otherwise(none)
    codes = F.when(text.rlike(CODE), found(text, CODE)).otherwise(none)
    keep = ["doc_id", "row"] if carry else ["doc_id"]
    base = docs.select("doc_id", *([F.struct(*docs.columns).alias("row")] if carry else []), F.concat(spans(0, assign), spans(1, access), spans(2, hexes)).alias("base"), codes.alias("__codes"))
    # what overlaps a base span is reported already
    fresh = F.flatten(F.transform(beside(F.col("__codes"), F.col("base")), pieces))
    tried = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), randomness(c["value"]).alias("p")))
    return base.select(*keep, "base", F.filter(tried, lambda t: t["p"].isNotNull()).alias("tried"))


def length_class(t: Column) -> Column:
    return F.floor(F.log2(t["end"] - t["start"])).cast("int")


def cuts(tried: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """For each class of lengths the largest p-value that Benjamini-Hochberg lets pass over all its candidates, if any."""
    per = tried.select(F.explode("tried").alias("t")).groupBy(length_class(F.col("t")).alias("class"), rounded_up(F.col("t.p")).alias("bin")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("class").orderBy("bin"))  # at most BINS + 89 * DECADE rows a class
    total = F.sum("n").over(Window.partitionBy("class"))
    got = per.select("class", "bin", upto.alias("upto"), total.alias("total")).where(F.col("bin") * F.col("total") <= fdr * F.col("upto"))
    return {r["class"]: r.most for r in got.groupBy("class").agg(F.max("bin").alias("most")).collect()}


def secret_spans(docs: DataFrame, fdr: float = FDR, carry: bool = False) -> DataFrame:
    """doc_id, `base` and `spans` (start, kind's place in KINDS, end; by start, then kind) of every row; with carry also the row.

    Null texts have none; null and repeated doc_ids are rows like any others.
    """
    seen = written(scanned(docs, carry), "secrets")
    limits = sorted(cuts(seen, fdr).items())

    def passes(t):
        most = F.lit(0.0)
        for c, p in limits:
            most = F.when(length_class(t) == c, p).otherwise(most)
        return rounded_up(t["p"]) <= most

    more = F.transform(F.filter("tried", passes), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return seen.select("doc_id", *(["row"] if carry else []), F.array_sort("base").alias("base"), F.array_sort(F.concat("base", more)).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return spans.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redacted(docs: DataFrame, mark: str = "[secret]", fdr: float = FDR) -> DataFrame:
    """The documents with every span, overlapping ones joined, replaced by the mark, and n_chars set anew.

    Documents without a span stay as they are. Rows keep their spans with them, so null and repeated doc_ids do no harm.
    """
    rows, old = secret_spans(docs, fdr, carry=True), F.col("row.text")

    def spliced(chunks):
        def piece(a, b):
            """Code points a to b, from the chunks they lie in."""
            i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
            of = lambda k, lo, n: F.substring(F.get(chunks, k), lo.cast("int"), n.cast("int"))
            far = F.concat(of(i, a - i * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, j - i - 1), ""), of(j, F.lit(1), b - j * CHUNK))
            return F.when(b <= a, "").when(i == j, of(i, a - i * CHUNK + 1, b - a)).otherwise(far)

        def step(at, s):
            new = F.when(s["kind"] < 0, F.array(piece(at, s["start"]))).otherwise(F.array(piece(at, s["start"]), F.lit(mark)))
            return F.greatest(at, s["end"]), F.when(s["start"] < at, F.array().cast("array<string>")).otherwise(new)

        end = F.length(old).cast("bigint")
        last = F.struct(end.alias("start"), F.lit(-1).alias("kind"), end.alias("end"))
        return F.array_join(folded(F.concat("spans", F.array(last)), F.lit(0).cast("bigint"), "string", step), "")

    text = let(F.regexp_extract_all(old, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), spliced)
    plain = F.size("spans") == 0
    done = rows.select("row", F.when(plain, old).otherwise(text).alias("__text"), plain.alias("__plain"))
    out = done.select("row.*", "__text", "__plain").withColumn("text", F.col("__text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__plain"), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op10_randomness_battery_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(spark, lambda: digest(secret_spans(table(spark, sf_dir, "documents"))), "op10")
