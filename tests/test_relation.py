"""The token relation against a plain scanner, blocks and scopes against brute force, and what level 2 makes of both."""

import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators import audit
from maskwright.operators.languages import relation, rewrite, tokens
from maskwright.operators.restore import restored
from maskwright.operators.rules import BUILT_IN
from maskwright.operators.sanitize import ROW
from maskwright.plans import engine
from maskwright.sources.files import read_corpus


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), f"{ROW} long, content string")


def random_texts(language, n=150):
    rng = random.Random(language)
    parts = ["'", "''", '"', '""', "--", "/*", "*/", "//", "(", ")", "{", "}", "\n", " ", "a", "N'", "q'[", "]'", "q'!", "!'", "Rem x", "remark", "[a b]", "[", "é1", "@p", "#t", "12.5", "\\", '"""', "_\n", ";", "$\"", "@\"", "İ", "\t"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["", None, "a" * 5000, "'" + "''" * 20_000, "/*" + "*x" * 20_000, '"' + "\\\"" * 20_000 + '"']


def taken(rows):
    """Comments and literals as (row, start, text)."""
    return {(r[ROW], r.start, r.text) for r in rows if r.kind in ("comment", "literal")}


@pytest.mark.parametrize("language", ["tsql", "oraclesql", "csharp", "vbnet"])
def test_tokens_cover_the_text_and_equal_a_plain_scanner(spark, language):
    texts = random_texts(language)
    got = relation.tokens(frame(spark, texts), language).orderBy(ROW, "place").collect()
    whole, lang = {}, tokens.LANGUAGES[language]
    for r in got:
        assert r.start == len(whole.setdefault(r[ROW], "")) and r.len == len(r.text)
        whole[r[ROW]] += r.text
    assert whole == {k: t for k, t in enumerate(texts) if t}
    if language in ("tsql", "oraclesql"):  # C# and Basic differ in what does not end, which the scanner cuts at a line's end
        want = set()
        for k, t in enumerate(texts):
            for a, b, kind in tokens.lexed(t or "", lang)[1]:
                want.add((k, a, b))
        names = {(r[ROW], r.start) for r in got if r.kind == "quoted"}
        mine = {(k, a + (len(x) - len(x.lstrip("nN")) if x[:1] in "nN" else 0), a + len(x)) for k, a, x in taken(got)}
        # the scanner knows no quoted names: texts without them must agree
        plain = {k for k, t in enumerate(texts) if t and '"' not in t and "[" not in t.replace("q'[", "")} - {k for k, _ in names}
        assert {x for x in mine if x[0] in plain} == {x for x in want if x[0] in plain} and len(plain) >= 15


def test_depth_level_and_lines(spark):
    rows = relation.tokens(frame(spark, ["a(b(')')c)\n{ d /* { \n */ }"]), "csharp").collect()
    assert [(r.depth, r.level, r.line) for r in rows if r.kind == "word"] == [(0, 0, 1), (1, 0, 1), (1, 0, 1), (0, 1, 2)]
    assert [(r.text, r.level, r.line) for r in rows if r.text in "{}"] == [("{", 1, 2), ("}", 1, 3)]


PROBLEMS = [
    ("a.sql", "SELECT (1", ["missing )"]), ("b.sql", "a ')' /* ( */", []), ("c.pks", "begin x end", []), ("d.sql", "select 'abc", ["string does not end"]), ("e.pks", "select q'[it's]' from x where a = nq'!a'b!' or b = q'(x)'", []),
    ("f.pks", "select q'[it's' from x", ["string does not end"]), ("g.sql", "begin tran; select case when 1=1 then 2 end commit", []), ("h.sql", "if 1=1 begin select 1", ["BEGIN or CASE without END"]), ("i.sql", 'select "a b" /* x', ["comment does not end"]),
    ("j.vbs", "Public Sub A()\nIf x Then\ny = 1\nEnd If\nFor i = 1 To 2\nNext\nEnd Sub", []), ("k.vbs", "Function F()\nDo\nEnd Function", ["unexpected end"]), ("l.vb", "Sub A()\nIf x Then y = 1\nExit Sub\n", ["sub does not end"]),
    ("m.vb", 'x = "say ""hi"" now" \' c (\nRem ((\ny = (1 + _\n 2)', []), ("n.sql", ") (", ["unexpected )"]), ("o.pks", "begin loop null; end loop; if a then b; end if; end;", []), ("p.vb", "Class A\nSub B()\nEnd Class\nEnd Sub", ["unexpected end"]),
    ("q.js", "f('a", ["missing )", "string does not end"]), ("r.sql", None, []), ("s.db2", 'select "a', ["name does not end"]), ("t.vb", 'Sub A()\n x = "End Sub', ["string does not end", "sub does not end"]), ("u.pks", "/*+ full(t) */ begin null; end;", []),
]


def test_problems_of_every_kind(spark):
    docs = spark.createDataFrame([(k % 3 or None, p, t) for k, (p, t, _) in enumerate(PROBLEMS)], "doc_id long, path string, content string")
    got = {}
    for r in engine.verify(docs).collect():
        got.setdefault(r.path, []).append(r.problem)
    assert {p: sorted(x) for p, x in got.items()} == {p: sorted(x) for p, _, x in PROBLEMS if x}


@pytest.mark.parametrize("bucket", [1, 4, 64])
def test_innermost_equals_brute_force(spark, bucket):
    rng = random.Random(bucket)
    spans, points = set(), set()
    for row in range(4):
        for _ in range(60):
            a = rng.randrange(400)
            spans.add((row, rng.choice("xy"), rng.randrange(10**6), a, min(999, a + rng.choice([0, 1, 3, 60, 900]))))
        points |= {(row, rng.choice("xyz"), p) for p in rng.sample(range(1000), 150)}
    got = relation.innermost(spark.createDataFrame(list(points), f"{ROW} long, value string, place int"), spark.createDataFrame(list(spans), f"{ROW} long, value string, block int, from int, to int"), [ROW, "value"], bucket)
    want = {}
    for r, v, p in points:
        if around := [(a, b) for s, w, b, a, z in spans if s == r and w == v and a <= p <= z]:
            want[r, v, p] = max(around)[1]
    assert {(r[ROW], r.value, r.place): r.block for r in got.collect()} == want
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_a_local_counts_where_a_block_declares_it(spark):
    code = 'namespace N { class A { void One(string city) { var rows = 1; rows++; if (city == "x1") { var deep = rows; } deep(); } void Two() { var rows = 2; city.Go(rows); } } }'
    rows = relation.tokens(frame(spark, [code]), "csharp")
    at = {"decl": [(0, code.index("rows = 1")), (0, code.index("rows = 2")), (0, code.index("city)")), (0, code.index("deep = "))]}
    names = ["rows", "rows", "city", "deep"]
    uses = [(0, k, n) for n in set(names) for k in range(len(code)) if code.startswith(n, k) and not code[k - 1].isalnum()]
    declared = spark.createDataFrame([(r, p, n) for (r, p), n in zip(at["decl"], names)], f"{ROW} long, place int, value string")
    bound = relation.bound_uses(declared, spark.createDataFrame(uses, f"{ROW} long, place int, value string"), relation.brace_blocks(rows, "start")).collect()
    blocks = {n: {r.block for r in bound if r.value == n} for n in set(names)}
    assert len(blocks["rows"]) == 2 and len(blocks["city"]) == 1 and len(blocks["deep"]) == 1
    loose = {(p, n) for _, p, n in uses} - {(r.place, r.value) for r in bound}
    assert loose == {(code.index("deep()"), "deep"), (code.index("city.Go"), "city")}
    out, _ = rewrite.obfuscated(spark.createDataFrame([(1, "a.cs", code)], "doc_id long, path string, content string"))
    text = out.first().content
    assert " deep();" in text and "city.Go(" in text and "rows" not in text and text.count("city") == 1


LEVEL_2 = [
    ("a.sql", "SELECT x FROM t WHERE s = N'it''s west' -- boss Meyer\nAND z = '12.5'"), ("b.vb", 'Dim said = "say ""hi"" now"\nRem boss is Meyer\nsaid = 1 : rem Meyer'), ("c.fs", 'let note = """say "Meyer owes" now"""'),
    ("d.sql", 'SELECT "Order Details".Id FROM "Order Details"'), ("e.pks", "MERGE INTO pay p USING src s ON (p.id = s.id) WHEN MATCHED THEN UPDATE SET p.total = s.total, p.note = q'!Meyer's!'"), ("f.cs", 'class Quiz { string said = """Meyer "owes" much"""; }'),
    ("g.bas", "10 PRINT Meyer"), ("h.bas", "Option Explicit\nDim meyer"), ("i.sql", "SELECT /* Meyer ' */ 'a' + 'Meyer''s' FROM t WHERE \"Meyer col\" = 'open"),
]


def test_level_2_hides_and_brings_back_what_quotes_hold(spark):
    docs = spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(LEVEL_2)], "doc_id long, path string, content string")
    out, names = engine.sanitize(docs, list(BUILT_IN))
    got = {r.path: r.content for r in out.collect()}
    assert got["g.bas"] == "10 PRINT Meyer"
    assert not [p for p, t in got.items() if "meyer" in t.lower() and p != "g.bas"]
    assert 'FROM "TBL_' in got["d.sql"] and "N'STR_" in got["a.sql"] and "'12.5'" in got["a.sql"] and "Rem [Comment removed]" in got["b.vb"] and got["i.sql"].endswith("'open")
    assert {r.value: r.alias for r in names.collect() if r.value in ("src", "pay")}.keys() == {"src", "pay"} and all(r.alias.startswith("TBL_") for r in names.collect() if r.value in ("src", "pay"))
    back = {r.path: r.content for r in restored(out.select("doc_id", "path", "content"), names).collect()}
    for path, text in LEVEL_2:
        if "boss" not in text and "/*" not in text:
            assert back[path] == text
    assert back["a.sql"] == LEVEL_2[0][1].replace("boss Meyer", "[Comment removed]")


def test_leak_search_finds_values_of_any_shape_in_other_documents(spark):
    names = spark.createDataFrame([(v,) for v in ("ann@corp.local", "C:\\data\\f1", "Order Details", "total", "ab", "...", "\\Ex\\Qy", "a.b", "grand total", "nowhere else")], "value string")
    texts = ["mail ann@corp.local, joann@corp.locals", "see C:\\data\\f1 or C:\\data\\f12", "the Order Details", "Order  Details", "totals", "(total)", "\\Ex\\Qy", "ab", "xa.b", None, "", "a.b.c grand total", "ann@corp.local total"]
    docs = spark.createDataFrame([(k % 4 or None, t) for k, t in enumerate(texts)], "doc_id long, content string")
    got = audit.leak_search(docs, names)
    want = [(0, "ann@corp.local"), (1, "C:\\data\\f1"), (2, "Order Details"), (5, "total"), (6, "\\Ex\\Qy"), (11, "a.b"), (11, "grand total"), (11, "total"), (12, "ann@corp.local"), (12, "total")]
    assert sorted((r.doc_id or 0, r.value) for r in got.collect()) == sorted((k % 4, v) for k, v in want)
    assert "Cartesian" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_bytes_that_are_no_utf8_are_kept(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff\xc3 Server=SEG1xDB \xe9")
    (tmp_path / "b.txt").write_text("fïne")
    rows = {r.path: r for r in read_corpus(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].content.startswith("ok \ufffd") and rows["a.txt"].content.endswith("\ufffd") and bytes(rows["a.txt"].bytes) == b"ok \xff\xc3 Server=SEG1xDB \xe9"
    assert rows["b.txt"].content == "fïne" and rows["b.txt"].bytes is None


@pytest.mark.parametrize("level", [1, 2])
def test_columns_with_the_engines_names_come_through(spark, level):
    docs = spark.createDataFrame([(1, "a.cs", "class Payroll { } // 10.0.0.1", "m", "s", "p", 7, "w")], "doc_id long, path string, content string, matches string, spans string, processor string, prefix int, `my col` string")
    out, _ = engine.sanitize(docs, list(BUILT_IN), level=level)
    r = out.first().asDict()
    assert r["input_matches"] == "m" and r["spans"] == "s" and r["prefix"] == 7 and r["my col"] == "w" and (r["input_processor"] if level == 2 else r["processor"]) == "p"
    if level == 2:
        r = engine.run(docs, list(BUILT_IN)).documents.first().asDict()
        assert r["input_matches"] == "m" and r["input_processor"] == "p" and r["path"] == "CLS_0.cs"


def test_cross_reference_lines_are_one_line_each(spark):
    names = spark.createDataFrame([("a\n\tb", "STR_0"), ("C:\\sss\\x|y", "PATH_0")], "value string, alias string")
    result = spark.createDataFrame([], "doc_id long, matches array<struct<start:int,len:int,value:string,alias:string,rule_id:string,line:int>>")
    lines = [r.line for r in audit.xref_lines(names, result).collect()]
    assert "| STR_0 | a b | 0 |" in lines and "| PATH_0 | C:\\sss\\x\\|y | 0 |" in lines
