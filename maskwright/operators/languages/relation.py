"""Sources as rows of tokens: (row, place, start, len, kind, text, line, depth), by one pattern of a language's lexemes; all else is windows.

The lexemes of a language cover every character, so splitting a text by their alternation is the whole lexer: what begins
first ends first, and a quote within a comment is no quote. Kinds, lines, depths, blocks and problems follow from running
sums and last values over a text's rows. Depth counts parentheses, level braces; neither counts in comments or literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.sanitize import ROW
from maskwright.sources.shared import by_key, written

#: what q-quotes are closed by; any other character closes itself
BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">"}
_SPACE, _NUMBER, _REST = r"[ \t\r\n\f\x0B]+", r"[0-9][0-9A-Za-z_.]*", r"(?s:.)"
_BLOCK = r"(?s:/\*.*?(?:\*/|\z))"
_SQL_LITERAL = r"[nN]?'(?:[^']++|'')*+(?:'|\z)"
_DOUBLE_QUOTED = r'"(?:[^"]++|"")*+(?:"|\z)'


def _q_quote() -> str:
    def one(a: str) -> str:
        return rf"\x{ord(a):02X}(?s:.*?)(?:\x{ord(BRACKETS.get(a, a)):02X}'|\z)"

    return "[nN]?[qQ]'(?:" + "|".join(one(chr(k)) for k in range(33, 127) if chr(k) not in "'])}>") + ")"


#: patterns in the order in which they are tried
LEXEMES = {
    "tsql": (r"--[^\n]*", _BLOCK, _SQL_LITERAL, _DOUBLE_QUOTED, r"\[[^\]\n]+\]", r"[\p{L}_@#][\p{L}\p{N}_@#$]*", _NUMBER, _SPACE, _REST),
    "db2sql": (r"--[^\n]*", _BLOCK, _SQL_LITERAL, _DOUBLE_QUOTED, r"[\p{L}_@#][\p{L}\p{N}_@#$]*", _NUMBER, _SPACE, _REST),
    "oraclesql": (r"--[^\n]*", _BLOCK, _q_quote(), _SQL_LITERAL, _DOUBLE_QUOTED, r"[\p{L}_][\p{L}\p{N}_#$]*", _NUMBER, _SPACE, _REST),
    "csharp": (r"//[^\n]*", _BLOCK, r'\$*"""(?s:.*?)(?:"""+|\z)', r'(?:@\$|\$@|@)"(?:[^"]++|"")*+(?:"|\z)', r'\$?"(?:[^"\\\n]++|\\.)*+"?', r"'(?:[^'\\\n]++|\\.)*+'?", r"@?[\p{L}_][\p{L}\p{N}_]*", _NUMBER, _SPACE, _REST),
    "vbnet": (r"'[^\n]*", r"(?i:rem)(?:[ \t][^\n]*|(?m:$))", r'"(?:[^"\n]++|"")*+"?', r"[\p{L}_][\p{L}\p{N}_]*", _NUMBER, r"[ \t]+_[ \t]*\r?\n", r"[ \t\r\f\x0B]+", _REST),
}
LEXEMES["vbscript"] = LEXEMES["vbnet"]
SQL, BASIC = ("tsql", "db2sql", "oraclesql"), ("vbnet", "vbscript")


def pattern(language: str, possessive: bool = True) -> str:
    """The alternation of the lexemes. Possessive repeats cannot be told from greedy ones by what they match here, but in Java only
    they loop without recursion, so that no text is too long; dialects without them (RE2) take the other form."""
    out = "|".join(LEXEMES[language])
    return out if possessive else out.replace("*+", "*").replace("++", "+")


def kind_of(text: Column, language: str) -> Column:
    first = F.substring(text, 1, 1)
    if language in SQL:
        hint = (F.startswith(text, F.lit("/*+")) | F.startswith(text, F.lit("--+"))) & F.lit(language == "oraclesql")
        out = F.when(hint, "hint").when(F.startswith(text, F.lit("--")) | F.startswith(text, F.lit("/*")), "comment")
        out = out.when((first == "'") | text.rlike(r"^(?:[nN]|[nN]?[qQ])'"), "literal").when(first.isin('"', "[") & (F.length(text) > 1), "quoted")
    elif language == "csharp":
        out = F.when(F.startswith(text, F.lit("//")) | F.startswith(text, F.lit("/*")), "comment").when(text.rlike(r"^[@$]*[\"']"), "literal")
    else:
        out = F.when((first == "'") | text.rlike(r"(?i)^rem(?:[ \t]|$)"), "comment").when(first == '"', "literal").when(text.rlike(r"^[ \t]+_[ \t]*\r?\n$"), "continued")
    return out.when(text.rlike(r"^[@#]*[\p{L}_@#]") & ~((first == "@") & (F.length(text) == 1)), "word").when(first.between("0", "9"), "number").when(text.rlike(r"^[ \t\r\n\f\x0B]"), "space").otherwise("mark")


def _by_place():
    return Window.partitionBy(ROW).orderBy("place")


def _so_far(column: Column) -> Column:
    return F.sum(column).over(_by_place().rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")


def _before(column: Column) -> Column:
    return F.coalesce(F.sum(column).over(_by_place().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")


#: characters of sources whose tokens one task sorts in memory, a hundred bytes or so for each three characters
DEALT = 4 << 20


def dealt(docs: DataFrame, most: int = DEALT) -> DataFrame:
    """docs by ROW, over as many partitions as their texts call for."""
    chars = docs.agg(F.sum(F.length("content").cast("long"))).first()[0] or 0
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-chars // most)), ROW)


def tokens(docs: DataFrame, language: str) -> DataFrame:
    """docs: (ROW, content). (ROW, place, start, len, kind, text, line, depth, level); null and empty contents have no rows.

    A parenthesis or brace that opens stands at the depth within it, one that closes too. In Basic a comment word counts only
    where a statement begins, and a line that goes on has one number.

    Texts are dealt by ROW before they are split, and the windows and groups over ROW take the tokens where they lie: a text is
    shuffled once, its tokens, which take many times its room, never. They are sorted while they are narrow.
    """
    found = F.posexplode(F.regexp_extract_all("content", F.lit(pattern(language)), F.lit(0))).alias("place", "text")
    parts = dealt(docs.select(ROW, "content")).select(ROW, found).where("text <> ''").sortWithinPartitions(ROW, "place")
    rows = parts.withColumn("kind", kind_of(F.col("text"), language)).withColumn("len", F.length("text"))
    code = F.col("kind") == "mark"
    ends = (F.col("text") == "\n").cast("int") if language in BASIC else F.length("text") - F.length(F.replace("text", F.lit("\n")))
    opens = {n: F.when(code & (F.col("text") == a), 1).when(code & (F.col("text") == b), -1).otherwise(0) for n, a, b in (("depth", "(", ")"), ("level", "{", "}"))}
    closes = {n: F.when(code & (F.col("text") == b), 1).otherwise(0) for n, b in (("depth", ")"), ("level", "}"))}
    return rows.withColumns({"start": _before(F.col("len")), "line": _before(ends) + 1} | {n: _so_far(opens[n]) + closes[n] for n in opens}).select(ROW, "place", "start", "len", "kind", "text", "line", "depth", "level")


def closed(text: Column, kind: Column) -> Column:
    """Whether a comment, literal or quoted name of an SQL dialect ends."""
    body = F.regexp_replace(text, r"^[nN]?[qQ]?(?=')", "")
    special = text.rlike(r"^[nN]?[qQ]'")
    delimiter = F.substring(body, 2, 1)
    closing = F.translate(delimiter, "".join(BRACKETS), "".join(BRACKETS.values()))
    quotes = lambda q: (F.length(text) - F.length(F.replace(text, F.lit(q)))) % 2 == 0
    block = ~F.startswith(text, F.lit("/*")) | (F.endswith(text, F.lit("*/")) & (F.length(text) >= 4))
    literal = F.when(special, F.endswith(body, F.concat(closing, F.lit("'"))) & (F.length(body) >= 4)).otherwise(quotes("'"))
    return F.when(kind.isin("comment", "hint"), block).when(kind == "literal", literal).when(kind == "quoted", F.startswith(text, F.lit("[")) | quotes('"')).otherwise(F.lit(True))


def blanked(rows: DataFrame) -> DataFrame:
    """(ROW, masked): each text with its comments and literals as blanks, line ends kept."""
    shown = F.when(F.col("kind").isin("comment", "literal"), F.regexp_replace("text", r"[^\n]", " ")).otherwise(F.col("text"))
    return rows.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("shown")))).alias("all")).select(ROW, F.array_join(F.col("all.shown"), "").alias("masked"))


# Words that follow BEGIN where it opens nothing that END closes, and END where BEGIN or CASE is not what it closes.
NO_BLOCK, OTHER_ENDS = ("tran", "transaction", "distributed", "dialog", "conversation"), ("if", "loop", "while", "repeat", "for", "conversation")


def sql_problems(rows: DataFrame) -> DataFrame:
    """(ROW, problem) of the tokens of SQL sources: parentheses, literals, comments and quoted names that do not close, BEGIN or CASE without END."""
    low, is_word = F.lower("text"), F.col("kind") == "word"
    so_far = _by_place().rowsBetween(Window.unboundedPreceding, -1)

    def step(word: Column, after: Column) -> Column:
        low, before = word["low"], F.coalesce(word["before"], F.lit(""))
        return F.when((low == "begin") & ~after.isin(*NO_BLOCK), 1).when((low == "case") & (before != "end"), 1).when((low == "end") & ~after.isin(*OTHER_ENDS), -1).otherwise(0)

    # what a word opens or closes is known at the next word, and of the last word at the end
    word = F.when(is_word, F.struct(low.alias("low"), "before"))
    rows = rows.withColumn("before", F.last(F.when(is_word, low), ignorenulls=True).over(so_far))
    rows = rows.withColumn("last", F.last(word, ignorenulls=True).over(so_far))
    blocks = F.sum(F.when(is_word, step(F.col("last"), low))).alias("blocks")
    final = F.max_by(word, F.when(is_word, F.col("place"))).alias("final")
    opens = F.col("kind").isin("comment", "hint", "literal", "quoted") & ~closed(F.col("text"), F.col("kind"))
    what = F.when(F.col("kind").isin("comment", "hint"), "comment").when(F.col("kind") == "literal", "string").otherwise("name")
    # a parenthesis that closes stands at the depth within it: 0 if none was open
    below = (F.col("kind") == "mark") & (F.col("text") == ")") & (F.col("depth") <= 0)
    net = F.when((F.col("kind") == "mark") & (F.col("text") == "("), 1).when((F.col("kind") == "mark") & (F.col("text") == ")"), -1).otherwise(0)
    per = rows.groupBy(ROW).agg(F.bool_or(below).alias("below"), F.sum(net).alias("net"), F.max(F.when(opens, what)).alias("open"), blocks, final)
    found = F.array(
        F.when(F.col("below"), F.lit("unexpected )")).when(F.col("net") > 0, F.lit("missing )")),
        F.when(F.col("open").isNotNull(), F.concat("open", F.lit(" does not end"))),
        F.when(F.col("blocks") + step(F.col("final"), F.lit("")) > 0, F.lit("BEGIN or CASE without END")),
    )
    return per.select(ROW, F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def matched(steps: DataFrame) -> DataFrame:
    """steps: (ROW, place, turn, word), turn 1 where a block opens and -1 where it closes, word what must agree.
    (ROW, place, word, turn, open, opened): of each row its block's level, and for one that closes the place and word of what it
    closes, the last at its level that opened; null if there is none."""
    level = _so_far(F.col("turn"))
    leveled = steps.withColumn("level", level + F.when(F.col("turn") == -1, 1).otherwise(0))
    w = Window.partitionBy(ROW, "level").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.struct("place", "turn", "word")).over(w)
    opener = F.when((F.col("turn") == -1) & (last["turn"] == 1), last)
    return leveled.withColumns({"open": opener["place"], "opened": opener["word"]})


# What opens a Basic block and the word that names it, and what closes it.
_MODIFIERS = r"(?:(?:public|private|friend|protected|shared|static|overridable|overrides|mustinherit|notinheritable|partial|default|readonly|writeonly|async|iterator|shadows|overloads)\s+)*"
BASIC_OPENERS = (
    (rf"^{_MODIFIERS}(sub|function|property|class|module|type|enum|structure|namespace|interface)\b", None), (r"^if\b.*\bthen\s*$", "if"), (r"^select\s+case\b", "select"), (r"^(with|try)\b", None), (r"^for\b", "for"), (r"^do\b", "do"), (r"^while\b", "while"),
)
BASIC_CLOSERS = ((r"^end\s*(sub|function|property|class|module|type|enum|structure|namespace|interface|if|select|with|try|while)\b", None), (r"^next\b", "for"), (r"^loop\b", "do"), (r"^wend\b", "while"))


def _named(line: Column, cases) -> Column:
    out = F.lit(None).cast("string")
    for p, word in reversed(cases):
        out = F.when(line.rlike(p), F.lit(word) if word else F.regexp_extract(line, p, 1)).otherwise(out)
    return out


def basic_statements(rows: DataFrame) -> DataFrame:
    """(ROW, place, code): a Basic source's lines without comments, in lower case, literals empty; lines that go on are one."""
    code = rows.where("kind <> 'comment' and text <> '\\n'").withColumn("shown", F.when(F.col("kind") == "literal", '""').when(F.col("kind").isin("space", "continued"), " ").otherwise(F.lower("text")))
    per = code.groupBy(ROW, "line").agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("all"))
    return per.select(ROW, F.col("line").alias("place"), F.trim(F.array_join(F.col("all.shown"), "")).alias("code"))


def basic_problems(rows: DataFrame) -> DataFrame:
    """(ROW, problem) of the tokens of Basic sources: the first block that ends out of turn, else all that do not end; parentheses and literals."""
    lines = basic_statements(rows)
    closer, opener = _named(F.col("code"), BASIC_CLOSERS), _named(F.col("code"), BASIC_OPENERS)
    steps = lines.withColumns({"closer": closer, "opener": opener}).where("closer is not null or opener is not null").where(~F.col("code").rlike(r"^(?:exit|declare|end\s*$)\b"))
    steps = steps.withColumns({"turn": F.when(F.col("closer").isNotNull(), -1).otherwise(1), "word": F.coalesce("closer", "opener")}).select(ROW, "place", "turn", "word", "code")
    pairs = matched(steps)
    wrong = pairs.where((F.col("turn") == -1) & ~F.coalesce(F.col("opened") == F.col("word"), F.lit(False)))
    first = wrong.groupBy(ROW).agg(F.min_by(F.regexp_extract("code", r"^(\w+)", 1), "place").alias("word"))
    shut = pairs.where("turn = -1").select(ROW, F.col("open").alias("place"))
    left = pairs.where("turn = 1").join(shut, [ROW, "place"], "left_anti").join(first.select(ROW), ROW, "left_anti")
    net = F.sum(F.when((F.col("kind") == "mark") & (F.col("text") == "("), 1).when((F.col("kind") == "mark") & (F.col("text") == ")"), -1).otherwise(0))
    below = F.bool_or((F.col("kind") == "mark") & (F.col("text") == ")") & (F.col("depth") <= 0))
    ragged = F.bool_or((F.col("kind") == "literal") & ((F.length("text") - F.length(F.replace("text", F.lit('"')))) % 2 == 1))
    per = rows.groupBy(ROW).agg(below.alias("below"), net.alias("net"), ragged.alias("ragged"))
    some = F.array(F.when(F.col("below"), F.lit("unexpected )")).when(F.col("net") > 0, F.lit("missing )")), F.when(F.col("ragged"), F.lit("string does not end")))
    return (
        first.select(ROW, F.concat(F.lit("unexpected "), "word").alias("problem"))
        .unionByName(left.select(ROW, F.concat("word", F.lit(" does not end")).alias("problem")))
        .unionByName(per.select(ROW, F.explode(F.filter(some, lambda p: p.isNotNull())).alias("problem")))
    )


# ---- blocks and scopes


def brace_blocks(rows: DataFrame, place: str = "place") -> DataFrame:
    """(ROW, block, from, to, level) of a brace language's tokens: a block reaches from its header, which begins after the last ; or brace
    outside parentheses, to its closing brace. One that does not close reaches to the end. block is the place of its brace; the
    whole source is block -1. Places are numbers of tokens, or offsets if `place` is start."""
    rows = rows.withColumn("place", F.col(place))
    marks = rows.where("kind = 'mark' and text in ('{', '}', ';') and (depth <= 0 or text <> ';')")
    header = F.coalesce(F.lag(F.col("place") + 1).over(_by_place()), F.lit(0))
    marks = marks.withColumn("from", header)
    w = Window.partitionBy(ROW, "level").orderBy("place")
    braces = marks.where("text <> ';'")
    whole = rows.groupBy(ROW).agg(F.max("place").alias("end"))
    to = F.when(F.lead("text").over(w) == "}", F.lead("place").over(w))
    inner = braces.withColumn("to", to).where("text = '{'").join(by_key(whole), ROW).select(ROW, F.col("place").alias("block"), "from", F.coalesce("to", "end").alias("to"), "level")
    return inner.unionByName(whole.select(ROW, F.lit(-1).alias("block"), F.lit(0).alias("from"), F.col("end").alias("to"), F.lit(0).alias("level")))


#: places of a source that share a bucket
BUCKET = 64


def innermost(points: DataFrame, spans: DataFrame, keys: list[str], bucket: int = BUCKET) -> DataFrame:
    """points (keys, place and more) with `block`, that of the innermost of spans (keys, block, from, to) around them; those that lie in none go.

    Both sides meet by their keys and a bucket of places, equality all of it. A span that covers buckets wholly is kept as few rows:
    the dyadic pieces of its range of buckets, of which any range has two a size at most, and a point asks for the piece of each
    size around it. So neither a long span nor a crowd of points is multiplied by more than the logarithm of a text's length.
    """
    spans = written(spans.select(*keys, "block", "from", "to"), "intervals")
    sizes = range(((spans.agg(F.max("to")).first()[0] or 0) // bucket + 1).bit_length())  # as the longest text calls for
    a, b = F.floor(F.col("from") / bucket).cast("long"), F.floor(F.col("to") / bucket).cast("long")
    # pieces of size 2 ** s: the first and last of each size that the range's halving leaves over
    pieces = []
    for s in sizes:
        lo, hi = F.shiftright(F.col("__a") + (1 << s) - 1, s), F.shiftright(F.col("__b") + 1, s)
        odd_lo, odd_hi = (lo < hi) & (lo % 2 == 1), (lo < hi) & (hi % 2 == 1) & ~((hi - 1 == lo) & (lo % 2 == 1))
        pieces += [F.when(odd_lo, F.struct(F.lit(s).alias("size"), lo.alias("piece"))), F.when(odd_hi, F.struct(F.lit(s).alias("size"), (hi - 1).alias("piece")))]
    parts = spans.withColumns({"__a": a, "__b": b}).withColumn("__p", F.explode(F.filter(F.array(*pieces), lambda p: p.isNotNull())))
    parts = parts.select(*keys, "block", F.col("from").alias("__from"), F.col("to").alias("__to"), F.col("__p.size").alias("__size"), F.col("__p.piece").alias("__piece"))
    at = F.floor(F.col("place") / bucket).cast("long")
    asked = points.withColumn("__id", F.struct(*keys, "place")).withColumn("__at", at)
    asked = asked.withColumn("__s", F.explode(F.array(*(F.struct(F.lit(s).alias("size"), F.shiftright("__at", s).alias("piece")) for s in sizes))))
    asked = asked.select(*keys, "place", F.col("__s.size").alias("__size"), F.col("__s.piece").alias("__piece"))
    met = asked.join(by_key(parts), [*keys, "__size", "__piece"]).where((F.col("place") >= F.col("__from")) & (F.col("place") <= F.col("__to")))
    best = met.groupBy(*keys, "place").agg(F.max_by("block", F.struct("__from", "block")).alias("block"))
    return points.join(by_key(best), [*keys, "place"])


def bound_uses(declared: DataFrame, uses: DataFrame, blocks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(ROW, place, value, block): of uses (ROW, place, value) those that some declaration (ROW, place, value) is visible to, with the
    block that it stands in: the innermost around the use of those that declare the name."""
    home = innermost(declared.select(ROW, "place", "value").distinct(), blocks, [ROW], bucket)
    names = home.select(ROW, "value", "block").distinct().join(by_key(blocks), [ROW, "block"]).select(ROW, "value", "block", "from", "to")
    return innermost(uses.select(ROW, "place", "value").distinct(), names, [ROW, "value"], bucket)
