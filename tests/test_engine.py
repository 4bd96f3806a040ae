"""The engine against a sequential model of what it has to compute, and each part on small fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import audit, paths, rules as R, sanitize, scope
from maskwright.operators.languages import cards, lines, tokens
from maskwright.operators.restore import restored
from maskwright.plans import engine

RULES = list(R.BUILT_IN)
TEXTS = [
    (1, "Server=OrdersDB1;ip 10.0.0.1 mail a.b@corp.local\nusers_x and OrdersDB1"),
    (2, None), (3, ""), (4, "nothing here"), (5, "10.0.0.1 10.0.0.12 C:\\data\\x PAYROLL.PROD.FILE app.internal ünïcode_prod é@x.org"), (6, "OrdersDB1 OrdersDB1 192.168.1.1"),
    (7, "host=a;host=b;\n\n172.16.1.1 'ACME.DATA.SET(MEM)' \\\\srv\\share\\f customers"), (8, "x" * 20000 + " sales_prod " + "y" * 20000),
]


def model(docs, rules):
    names, counters, out = {}, {}, {}
    for doc, text in docs:
        spans = []
        for order, r in enumerate(rules):
            for m in re.finditer(r.pattern, text or ""):
                if m[0].lower() in {e.lower() for e in r.exceptions}:
                    continue
                if m[0] not in names:
                    names[m[0]] = f"{r.prefix}_{counters.get(r.prefix, 0)}"
                    counters[r.prefix] = counters.get(r.prefix, 0) + 1
                spans.append((m.start(), -len(m[0]), order, m[0]))
        new, at = "", 0
        for start, neg, _, value in sorted(spans):
            if start >= at:
                new, at = new + (text or "")[at:start] + names[value], start - neg
        out[doc] = None if text is None else new + text[at:]
    return names, out


def corpus(spark, rows=TEXTS):
    return spark.createDataFrame(rows, "doc_id long, content string").withColumn("clash", F.lit(1))


@pytest.mark.parametrize("native", [False, True])
def test_sanitize_equals_the_sequential_model(spark, native):
    found = sanitize.detected(corpus(spark), RULES, native)
    names = sanitize.dictionary(found)
    want_names, want = model(TEXTS, RULES)
    assert {r.value: r.alias for r in names.collect()} == want_names
    got = {r.doc_id: r for r in sanitize.applied(found, names).collect()}
    assert {k: r.content for k, r in got.items()} == want
    assert got[2].was_sanitized is False and got[2].matches == [] and got[2].clash == 1
    assert got[1].matches[0].line == 1 and got[1].matches[-1].line == 2


def test_numbers_go_on_and_aliases_are_one_to_one(spark):
    first = sanitize.dictionary(sanitize.detected(corpus(spark, TEXTS[:5]), RULES))
    more = sanitize.extended(sanitize.detected(corpus(spark), RULES), first).collect()
    assert len({r.alias for r in more}) == len(more) == len({r.value for r in more})
    assert {(r.value, r.alias) for r in first.collect()} <= {(r.value, r.alias) for r in more}


def test_round_trip_and_safety_of_restore(spark):
    result, names = sanitize.sanitized(corpus(spark), RULES)
    back = {r.doc_id: r for r in restored(result.select("doc_id", "content"), names).collect()}
    assert {k: r.content for k, r in back.items()} == dict(TEXTS)
    names = spark.createDataFrame([("a$1\\b", "IP", 1, "IP_1"), ("see IP_1", "X", 2, "X_2")], "value string, prefix string, n long, alias string")
    docs = spark.createDataFrame([(1, "IP_1 IP_10 xIP_1 X_2"), (2, "")], "doc_id long, content string")
    got = {r.doc_id: r for r in restored(docs, names).collect()}
    assert got[1].content == "a$1\\b IP_10 xIP_1 see a$1\\b" and got[1].unmatched == ["IP_10"] and got[2].was_restored is False


def test_reports(spark):
    result, names = sanitize.sanitized(corpus(spark), RULES)
    s = audit.stats(result, names).first()
    assert (s.total_files, s.processed_files + s.skipped_files) == (8, 8) and s.unique_values == names.count()
    assert audit.leaks(result, corpus(spark), names).count() == 0
    assert audit.xref(names, result).agg(F.sum("occurrences")).first()[0] == s.total_replacements
    assert audit.status(names).count() == 10


def test_rules_merge_and_custom_files(spark, tmp_path):
    f = tmp_path / "r.json"
    (tmp_path / "p.regex").write_text("# note\n\nfoo\nbar\n")
    f.write_text('{"Rules": [{"ruleId": "EMAIL_addresses", "pattern": "zz", "prefix": "E", "order": 1}, {"ruleId": "off", "pattern": "q", "prefix": "Q", "enabled": false}, {"RULEID": "fromfile", "type": "RegexFile", "patternFile": "p.regex", "prefix": "F"}]}')
    got = engine.active_rules(spark, [str(f)])
    by = {r.rule_id: r for r in got}
    assert got[0].rule_id == "EMAIL_addresses" and by["fromfile"].pattern == "(foo|bar)" and "off" not in by and len(got) == 15
    assert R.from_json(spark, str(tmp_path / "none.json")).count() == 0
    assert R.active(R.switched(R.frame(spark, RULES), "server_names", False)).count() == 13


@pytest.mark.parametrize("rule_id, text, hit", [
    ("server_names", "ProductionDB", True), ("server_names", "productiondb", False), ("prod_databases", "sales_prod", True), ("private_ip_10", "10.1.2.3", True), ("private_ip_10", "110.1.2.3", False), ("private_ip_172", "172.32.0.1", False),
    ("internal_hostname", "db.internal", True), ("email_addresses", "a.b+c@d.org", True), ("mvs_dataset_bare", "PROD.DATA.X1", True), ("unc_path", r"\\srv\share", True), ("table_names_users", "users_archive", True),
])
def test_rule_cases(rule_id, text, hit):
    assert bool(re.search(next(r.pattern for r in RULES if r.rule_id == rule_id), text)) is hit


def test_paths(spark):
    got = spark.range(1).select(
        paths.normalized(F.lit("a/./b/../c\\d")).alias("a"), paths.normalized(F.lit("../../x")).alias("b"), paths.relative(F.lit("src/app"), F.lit("SRC/lib/x.js")).alias("c"), paths.relative(F.lit(""), F.lit("x")).alias("d"),
        paths.should_ignore(F.lit("a/Build/x.cs")).alias("e"), paths.should_ignore(F.lit("build.cs"), F.lit(1)).alias("f"), paths.should_ignore(F.lit("x.cs"), F.lit(11 << 20)).alias("g"), paths.should_process(F.lit("A.CS")).alias("h"),
    ).first()
    assert tuple(got) == ("a/c/d", "../../x", "../lib/x.js", "x", True, False, True, True)
    files = spark.createDataFrame([("Acme/App.csproj",), ("Acme/Order.cs",), ("acme/other.cs",), ("src/x.md",)], "path string")
    types = spark.createDataFrame([("Acme/Order.cs", "Order", "CLS_3", "Class"), ("Acme/Order.cs", "Zed", "CLS_1", "Class")], "path string, value string, alias string, category string")
    m = {r.path: r.new_path for r in paths.path_aliases(files, types).collect()}
    assert m == {"Acme/App.csproj": "DIR_0/PROJ_0.csproj", "Acme/Order.cs": "DIR_0/CLS_3.cs", "acme/other.cs": "DIR_0/FILE_0.cs", "src/x.md": "src/FILE_1.md"}


def test_imports_are_resolved_and_patched(spark):
    docs = spark.createDataFrame([("src/a.js", "import x from './b'; const c = require('../lib');"), ("src/b.ts", ""), ("lib/index.js", "")], "path string, content string")
    mapping = spark.createDataFrame([("src/a.js", "src/F1.js"), ("src/b.ts", "src/F2.ts"), ("lib/index.js", "out/F3.js")], "path string, new_path string")
    got = paths.resolved_imports(paths.imports(docs), mapping)
    assert {r.reference: r.new_reference for r in got.collect()} == {"./b": "./F2", "../lib": "../out"}
    new = {r.path: r.content for r in paths.patched(docs, got).collect()}
    assert new["src/a.js"] == "import x from './F2'; const c = require('../out');"
    back = paths.renamed(paths.renamed(docs, mapping), mapping, back=True)
    assert {r.path for r in back.collect()} == {"src/a.js", "src/b.ts", "lib/index.js"}


def test_scope_and_dispatch(spark):
    assert scope.parsed_scope(" Database ,jcl") == {"tsql", "db2sql", "oraclesql", "jcl"} and scope.parsed_scope("") is None
    with pytest.raises(ValueError):
        scope.parsed_scope("nope")
    rows = [("q.sql", "SELECT NVL(a, 1) FROM dual"), ("x", "//A JOB\n//B EXEC PGM=X"), ("y", "free text"), ("z.xyz", ""), ("p.prc", "")]
    df = spark.createDataFrame(rows, "path string, content string")
    who = lambda **k: [r[0] for r in df.select(scope.processor_of(F.col("path"), F.col("content"), **k)).collect()]
    assert who() == ["tsql", "jcl", "mainframe-utility", None, "jcl"] and who(by_content=True)[0] == "oraclesql"


def test_level_2_rewrites_code_and_restores_names(spark):
    sql = "CREATE PROC sales.Load @id INT AS\n-- secret\nSELECT o.Total FROM sales.Orders o WHERE o.City = 'Paris' AND o.N = '12' AND @id > 0 AND o.Mail = 'x@y.org'"
    docs = spark.createDataFrame([(1, "a.sql", sql), (2, "b.cs", 'class Ledger { int total; void Post(string city) { total = city.Length; } } // note'), (3, "n.md", "10.0.0.1"), (4, "e.sql", "")], "doc_id long, path string, content string")
    out, names = engine.sanitize(docs, RULES, level=2)
    got = {r.doc_id: r.content for r in out.collect()}
    for word in ("Orders", "Paris", "secret", "Total"):
        assert word not in got[1]
    assert "'12'" in got[1] and "@PRM_0" in got[1] and "[Comment removed]" in got[1] and "Ledger" not in got[2] and ".Length" in got[2] and got[3] == "IP_0" and got[4] == ""
    back = {r.doc_id: r.content for r in restored(out.select("doc_id", "content"), names).collect()}
    assert back[1] == sql.replace("-- secret", "-- [Comment removed]")
    only, _ = engine.sanitize(docs, RULES, level=2, scope="web")
    assert {r.doc_id: r.content for r in only.collect()} == {r.doc_id: r.content for r in docs.collect()}


def test_lexers_and_balance():
    assert tokens.lexed("(* a (* b *) c *) let x = 1", tokens.LANGUAGES["fsharp"])[0].strip() == "let x = 1"
    assert any(s[2] == "Orders" for s in tokens.code_spans('var q = "SELECT a FROM Orders";', "csharp"))


def test_cobol_jcl_and_cards(spark):
    src = "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. PAY1.\n000300 DATA DIVISION.\n000310 FD  IN-FILE.\n000400 01  IN-REC.\n000500     05  FILLER PIC X.\n000600     88  IS-OK VALUE 1.\n000700 PROCEDURE DIVISION.\n000800 MAIN-P.\n000900     EXEC SQL\n001000      SELECT 1 INTO :HV-A\n001100     END-EXEC.\n001200     CALL 'SUB1'."
    docs = spark.createDataFrame([(1, src), (2, ""), (3, None)], "doc_id long, content string")
    got = {(r.value, r.category) for r in lines.cobol_names(docs).collect()}
    assert got == {("PAY1", "Program"), ("IN-FILE", "CobolFile"), ("IN-REC", "CobolRecord"), ("IS-OK", "Condition"), ("MAIN-P", "Paragraph"), ("HV-A", "HostVariable"), ("SUB1", "Program")}
    jcl = "//J1 JOB A\n//S EXEC PGM=DSNTEP2\n//SYSIN DD *\nSELECT 1\n/*\n//D DD DSN=A.B,\n//   DISP=SHR"
    rows = lines.jcl_lines(spark.createDataFrame([(1, jcl)], "doc_id long, content string")).orderBy("line_no").collect()
    assert [r.line_type for r in rows] == ["Job", "Exec", "Dd", "Instream", "Delimiter", "Dd", "Continuation"] and rows[3].instream_sql
    assert spark.range(1).select(cards.card_type(F.lit("  REPRO INFILE(A)"))).first()[0] == "Idcams"


def test_interpolated_and_prefixed_literals():
    def put(text, processor):
        out, at = [], 0
        for a, n, v, c, head, tail in sorted(tokens.code_spans(text, processor), key=lambda s: (s[0], -s[1])):
            if a >= at:
                out += [text[at:a], head + (f"<{v}>" if c != "Comment" else "") + tail]
                at = a + n
        return "".join(out) + text[at:]

    assert put("class Ledger { void Post(string city) { var a = $\"Hello {city} you\"; char c = 'x'; var p = @\"C:\\dir\\\"; } }", "csharp") == "class <Ledger> { void <Post>(string <city>) { var a = $\"<Hello> {<city>} <you>\"; char c = 'x'; var p = @\"<C:\\dir\\>\"; } }"
    assert put("var q = $\"SELECT a FROM Orders WHERE b = {0}\";", "csharp") == "var q = $\"SELECT <a> FROM <Orders> WHERE <b> = {0}\";"
    assert put("const userName = 1; const s = `Dear ${userName}!`;", "javascript") == "const <userName> = 1; const s = `<Dear> ${<userName>}!`;"
    assert put("update t set x = N'it''s'", "tsql") == "update <t> set <x> = N'<it''s>'"


COBOL = "\n".join([
    "000100 IDENTIFICATION DIVISION.", "000200 PROGRAM-ID. PAY1.", "000250* who pays", "000300 DATA DIVISION.", "000310 FD  IN-FILE.", f"{'000400 01  IN-REC.':72}PAY00001", "000500     05  FILLER PIC X.", "000550     05  AMOUNT PIC S9(5)V99 COMP-3 VALUE 0.",
    "000600     88  IS-OK VALUE 'YESYES'.", "000700 PROCEDURE DIVISION.", "000800 MAIN-P.", "000900     EXEC SQL", "001000      SELECT CITY INTO :HV-A, :REC-A.FLD-B FROM PAYROLL", "001060      WHERE NAME = 'Paris' AND N = '12'", "001100     END-EXEC.",
    "001200     CALL 'SUB1' USING AMOUNT.", "001300     MOVE AMOUNT TO WS-TOTAL OF DCLSPAY SHARED.", "001400     EXEC CICS LINK PROGRAM('PGMX') COMMAREA(WS-COMM) END-EXEC.",
])
JCL = "\n".join([
    "//PAYJOB JOB (ACCT1),'J SMITH',CLASS=A", "//* secret", "//  SET HLQ=ACME", "//S1 EXEC PGM=PAY1,PARM='RUN1'", "//INPUT1 DD DSN=&HLQ..PAY.DATA(MEM1),", "//   DISP=SHR", "//SYSPRINT DD SYSOUT=*", "//OUT1 DD DSN=ACME.PAY.OUT(+1),DISP=(NEW,CATLG),DCB=*.S1.INPUT1",
    "//SYSIN DD *", " RUN PROGRAM(PG1) PLAN(PL1) LIB('ACME.LOAD')", "/*", "//S2 EXEC PGM=DSNTEP2", "//SYSIN DD *", "SELECT CITY FROM PAYROLL", "/*",
])


def test_mainframe_sources_are_rewritten_and_restored(spark):
    rows = [(1, "a.cbl", COBOL), (2, "b.jcl", JCL), (3, "c.cpy", "000100 01  SHARED PIC X."), (4, "FTPCARD", "ftp.acme.com\nhunter2\ncd /data/in\nget FILE1 'ACME.PAY.DATA'\nquit"), (5, "e.cbl", ""), (6, "f.cbl", None), (7, "g.jcl", "no card\n//\n// \n//X")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, content string")
    out, names = engine.sanitize(docs, [], level=2)
    got, alias = {r.doc_id: r.content for r in out.collect()}, {r.value: r.alias for r in names.collect()}
    for word in "PAY1 IN-FILE IN-REC AMOUNT IS-OK YESYES MAIN-P CITY HV-A REC-A FLD-B PAYROLL Paris SUB1 WS-TOTAL DCLSPAY SHARED PGMX WS-COMM".split() + ["who pays"]:
        assert word not in got[1], word
    for word in ("FILLER PIC X", "PIC S9(5)V99 COMP-3 VALUE 0", "EXEC SQL", "END-EXEC", "'12'", "MOVE", "LINK PROGRAM("):
        assert word in got[1], word
    for word in "PAYJOB ACCT1 SMITH secret HLQ PAY1 RUN1 INPUT1 PAY.DATA MEM1 PG1 PL1 ACME.LOAD CITY PAYROLL".split():
        assert word not in got[2], word
    assert "//SYSPRINT DD SYSOUT=*" in got[2] and f"(+1),DISP=(NEW,CATLG),DCB=*.{alias['S1']}.{alias['INPUT1']}" in got[2] and f"DSN=&{alias['HLQ']}..{alias['PAY.DATA']}({alias['MEM1']})," in got[2]
    assert alias["PAYROLL"] == "TBL_0" and alias["CITY"] == "COL_0"
    assert alias["PAY1"] in got[1] and alias["PAY1"] in got[2] and alias["SHARED"] in got[3] and alias["CITY"] in got[2]
    assert got[4].split("\n") == [alias["ftp.acme.com"], alias["hunter2"], f"cd {alias['/data/in']}", f"get {alias['FILE1']} '{alias['ACME.PAY.DATA']}'", "quit"]
    assert (got[5], got[6], got[7]) == ("", None, "no card\n//\n// \n//X")
    back = {r.doc_id: r.content for r in restored(out.select("doc_id", "content"), names).collect()}
    assert back[1] == COBOL.replace("* who pays", "* [Comment removed]") and back[2] == JCL.replace("//* secret", "//* [Comment removed]") and [back[k] for k in (3, 4, 5, 6, 7)] == [r[2] for r in rows[2:]]


def test_embedded_sql_alone_where_only_databases_are_in_scope(spark):
    docs = spark.createDataFrame([(1, "a.cbl", COBOL), (2, "b.jcl", JCL)], "doc_id long, path string, content string")
    got = {r.doc_id: r.content for r in engine.sanitize(docs, RULES, level=2, scope="database")[0].collect()}
    assert "PAYROLL" not in got[1] and "PAYROLL" not in got[2] and "AMOUNT" in got[1] and "who pays" in got[1] and "PAYJOB" in got[2] and "secret" in got[2]


def test_fixed_columns():
    from maskwright.operators.languages import mainframe as M

    old = f"{'000100     MOVE A TO B':72}ID000001"
    assert M.refitted(old, old.replace(" A ", " VAR_1234 "), "cobol") == f"{'000100     MOVE VAR_1234 TO B':72}ID000001"
    long = "000100     MOVE " + " ".join(f"VAR_{k}" for k in range(100, 120)) + " TO 'a b'"
    lines_of = M.refitted("000100     MOVE A", long, "cobol").split("\n")
    assert len(lines_of) > 1 and all(len(x) <= 72 for x in lines_of) and " ".join(x[7:].strip() for x in lines_of) == long[7:].strip()
    card = "//D DD " + ",".join(f"DSN=DSN_{k}" for k in range(20))
    cards_of = M.refitted("//D DD DSN=A", card, "jcl").split("\n")
    assert all(len(x) <= 71 for x in cards_of) and cards_of[0] + "".join(x[2:].strip() for x in cards_of[1:]) == card
    assert M.refitted("a", "b", "tsql") == "b" and len(M.refitted("x" * 80, "y" * 90, "jcl")) == 80
    assert M.problems(JCL, "jcl") == [] and M.problems("x", "jcl") == ["no JOB or PROC card"] and "no PROCEDURE DIVISION" in M.problems("y" * 81, "cobol")


@pytest.mark.parametrize("kind, text, values", [
    ("Smtp", "HELO mail.acme.com\nMAIL FROM:<a@b.org>\nSubject: Pay run\nDATA\nThe Acme batch WS-1\n* Note *", {"mail.acme.com", "a@b.org", "Pay run", "Acme", "WS-1", "Note"}),
    ("Parameter", "* remark\nRUNDATE=2024 ACME.PAY.DATA x@y.org ABC", {"RUNDATE", "ACME.PAY.DATA", "x@y.org"}),
    ("Mfs", "FLD MFLD (CUSTNAME,LTH=5)\n DFLD 'Name of'", {"FLD", "CUSTNAME", "Name of"}),
    ("Sort", " SORT FIELDS=(1,5,CH,A)   by account\n* x", {"by account"}),
    ("Idcams", " DEFINE CLUSTER (NAME(ACME.VSAM) VOLUMES(VOL001))", {"ACME.VSAM", "VOL001"}),
])
def test_cards_are_rewritten(kind, text, values):
    from maskwright.operators.languages import mainframe as M

    got = M.spans(text, f"mainframe-utility:{kind}")
    assert {s[2] for s in got if s[3] not in ("Comment", M.KNOWN)} == values and all(s[3] == "Comment" or text[s[0] : s[0] + s[1]] == s[2] for s in got)


def test_text_functions(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    assert f(X.literal_inner(F.lit("N'it''s'"))) == "it's" and f(X.is_numeric_or_date(F.lit("1,234.5"))) and f(X.is_numeric_or_date(F.lit("2024-01-02 x"))) and not f(X.is_numeric_or_date(F.lit("abc")))
    assert f(X.looks_like_sql(F.lit("  select * from t"))) and not f(X.looks_like_sql(F.lit("SELECT 1")))


def test_files_manifest_and_stream(spark, tmp_path):
    from maskwright.sources.files import find_rule_file, read_corpus, read_manifest, write_files
    from maskwright.streaming.files import sanitize_stream, text_files

    src = tmp_path / "src"
    (src / "bin").mkdir(parents=True)
    (src / "a.txt").write_text("10.0.0.1")
    (src / "bin" / "b.txt").write_text("10.0.0.2")
    (src / "c.png").write_text("x")
    docs = read_corpus(spark, str(src))
    assert [(r.path, r.content) for r in docs.collect()] == [("a.txt", "10.0.0.1")] and read_corpus(spark, str(tmp_path / "no")).count() == 0
    out, names = engine.sanitize(docs, RULES, level=1)
    engine.save(out, names, str(tmp_path / "out"), 1)
    assert read_manifest(spark, str(tmp_path / "out")).first().total_replacements == 1 and engine.restore(spark, str(tmp_path / "out")).first().content == "10.0.0.1"
    with pytest.raises(ValueError):
        engine.restore(spark, str(tmp_path / "nothing"))
    write_files(out, str(tmp_path / "back"))
    assert (tmp_path / "back" / "a.txt").read_text() == "IP_0" and find_rule_file(str(src)) is None
    q = sanitize_stream(text_files(spark, str(src / "bin")), RULES, str(tmp_path / "st"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r.content for r in spark.read.parquet(str(tmp_path / "st/documents")).collect()] == ["IP_0"]


def test_rows_with_null_and_repeated_ids_keep_their_texts(spark):
    rows = [(1, "10.0.0.1 tail"), (1, "some other words 10.0.0.2 end"), (None, "10.0.0.1"), (None, None)]
    out, names = sanitize.sanitized(spark.createDataFrame(rows, "doc_id long, content string"), RULES)
    assert sorted((r.content or "") for r in out.collect()) == ["", "IP_0", "IP_0 tail", "some other words IP_1 end"]
    back = restored(out.select("doc_id", "content"), names)
    assert sorted(str(tuple(r)) for r in back.select("doc_id", "content").collect()) == sorted(str(r) for r in rows)


def test_chains_of_aliases_are_followed_to_their_end(spark):
    schema = "value string, prefix string, n long, alias string"
    chain = [(f"X_{i + 1} x" if i < 50 else "done", "X", i, f"X_{i}") for i in range(51)]
    got = restored(spark.createDataFrame([(1, "X_0"), (2, "no")], "doc_id long, content string"), spark.createDataFrame(chain, schema)).orderBy("doc_id").collect()
    assert got[0].content == "done" + " x" * 50 and got[0].replacements == 51 and got[0].unmatched == [] and got[1].content == "no"
    ring = [("Y_1", "Y", 0, "Y_0"), ("Y_0", "Y", 1, "Y_1")]
    with pytest.raises(ValueError):
        restored(spark.createDataFrame([(1, "Y_0")], "doc_id long, content string"), spark.createDataFrame(ring, schema))


def test_names_that_another_file_declares(spark):
    docs = spark.createDataFrame([
        (1, "a.cs", "namespace Acme { public class PayrollService { public void Settle(int month) { } } }"), (2, "b.cs", "class Job { void Go() { var run = new PayrollService(); run.Settle(3); month(); } }"),
        (3, "c.vb", "Class Other\nSub Work()\nDim p As New PayrollService\nEnd Sub\nEnd Class"), (4, "d.js", "let other = new PayrollService();"), (5, "e.vbs", "Dim alpha, _\n beta\nalpha = beta"),
    ], "doc_id long, path string, content string")
    out, names = engine.sanitize(docs, RULES)
    got = {r.doc_id: r.content for r in out.collect()}
    assert "PayrollService" not in got[2] + got[3] and "Settle" not in got[2] and "month()" in got[2] and "PayrollService" in got[4]
    assert got[5] == "Dim VAR_0, _\n VAR_1\nVAR_0 = VAR_1".replace("VAR_0", next(r.alias for r in names.collect() if r.value == "alpha")).replace("VAR_1", next(r.alias for r in names.collect() if r.value == "beta"))
    assert audit.leaked_names(out.where("doc_id < 4"), names.where("category is null or category not in ('Parameter')") if "category" in names.columns else names.where("value <> 'month'")).count() == 0
    s = audit.stats(out, names).first()
    assert s.total_replacements == out.agg(F.sum("replacements")).first()[0] > 10 and s.processed_files == 5
    assert audit.source_map(out).where("value = 'PayrollService'").first().n == 3 and audit.locations(out).where("value = 'PayrollService'").count() == 3


def test_oracle_literals_and_own_names():
    text = "SELECT q'[it's here]', v.x FROM v$session v, orders o; dbms_output.put_line(nq'(so)'); y := 'never ends"
    got = {(s[2], s[3]) for s in tokens.code_spans(text, "oraclesql")}
    assert ("it's here", "StringLiteral") in got and ("so", "StringLiteral") in got and ("orders", "Table") in got and not any("$" in v or v.startswith("dbms") or "never" in v for v, _ in got)
    put = "".join(text[a:s[0]] + s[4] + s[2] + s[5] for a, s in zip([0, *(x[0] + x[1] for x in sorted(tokens.code_spans(text, "oraclesql")))], sorted(tokens.code_spans(text, "oraclesql"))))
    assert text.startswith(put)  # what is put back is what stood there
    assert {s[2] for s in tokens.code_spans("create procedure pay_all(p_id in number, p_to varchar2) is begin null; end;", "oraclesql") if s[3] == "Parameter"} == {"p_id", "p_to"}


def test_script_names():
    js = "const {aa, b: cc, ...rest} = obj; const [x1, y1] = z; function go(first, second = 2) { return (pp, qq) => pp + qq; }\nimport Def, {one as two} from './m'; export {go as start};"
    got = {s[2]: s[3] for s in tokens.code_spans(js, "javascript")}
    assert got == {"aa": "Variable", "cc": "Variable", "rest": "Variable", "x1": "Variable", "y1": "Variable", "go": "Function", "first": "Parameter", "second": "Parameter", "pp": "Parameter", "qq": "Parameter", "Def": "ImportBinding", "two": "ImportBinding", "start": "ExportBinding"}
    vb = {s[2]: s[3] for s in tokens.code_spans("Private mTotal As Long, mName\nPublic Sub Go(ByVal num As Long, other)\nDim aa, bb(10) As Long\nEnd Sub", "vbscript")}
    assert vb == {"mTotal": "Field", "mName": "Field", "Go": "Method", "num": "Parameter", "other": "Parameter", "aa": "Variable", "bb": "Variable"}


def test_level_2_run_renames_patches_and_comes_back(spark, tmp_path):
    tree = "Folder PATH listing\n+---src\n|   |   app.js\n|   |   Ledger.cs"
    rows = [(1, "src/app.js", "import {pay} from './lib/pay.js';\nlet total = pay(2);"), (2, "src/lib/pay.js", "export function pay(amount) { return amount; }"), (3, "src/Ledger.cs", "class Ledger { void Post() { } }"), (4, "src/P.csproj", '<Compile Include="Ledger.cs" />'), (5, "tree.txt", tree)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, content string")
    run = engine.run(docs, RULES)
    got = {r.doc_id: r for r in run.documents.collect()}
    assert "pay.js" not in got[1].content and "Ledger" not in got[3].path and got[3].path.rsplit("/", 1)[-1].removesuffix(".cs") in got[4].content and "app.js" not in got[5].content and "Ledger" not in got[5].content
    engine.save(run, path=str(tmp_path / "out"), level=2)
    back = {r.doc_id: (r.path, r.content) for r in engine.restore(spark, str(tmp_path / "out")).collect()}
    assert back == {d: (p, c) for d, p, c in rows}
    from maskwright.sources.files import clean_empty_folders, copy_untouched, read_manifest, write_xref

    assert read_manifest(spark, str(tmp_path / "out")).first().restored_at is not None and spark.read.parquet(str(tmp_path / "out/files")).count() == 5
    write_xref(audit.xref_lines(run.names, run.documents), str(tmp_path / "xref"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "xref")).collect()]
    assert "| Alias | Original | Occurrences |" in lines and any("| Ledger |" in x for x in lines)
    assert engine.verify(run.documents).count() == 0 and engine.verify(spark.createDataFrame([(1, "a.cs", "class A { void B( }")], "doc_id long, path string, content string")).count() == 1
    (tmp_path / "in" / "img").mkdir(parents=True)
    (tmp_path / "in" / "img" / "x.png").write_bytes(b"x")
    (tmp_path / "in" / "a.txt").write_text("t")
    assert copy_untouched(spark, str(tmp_path / "in"), str(tmp_path / "to")) == 1 and (tmp_path / "to/img/x.png").read_bytes() == b"x"
    (tmp_path / "to" / "e" / "f").mkdir(parents=True)
    assert clean_empty_folders(str(tmp_path / "to")) == 2 and (tmp_path / "to/img/x.png").exists()
