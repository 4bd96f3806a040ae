"""Directory listings by whole paths, project files as XML, imports, and COBOL words against the plain scanner."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import paths
from maskwright.operators.languages import cobol, links, mainframe
from maskwright.operators.sanitize import ROW

TREE = """Folder PATH listing for volume X
C:.
|   readme.md
|
+---Sales
|   |   Job.cs
|   |   Run.cs
|   |
|   \\---Lib
|           Job.cs
|
\\---Pay
    |   Job.cs
    \\---Lib
            Job.cs
            unknown.cs"""


def test_listings_keep_equal_names_of_two_folders_apart(spark):
    new = {"Sales/Job.cs": "DIR_1/CLS_0.cs", "Sales/Run.cs": "DIR_1/CLS_1.cs", "Sales/Lib/Job.cs": "DIR_1/lib/CLS_2.cs", "Pay/Job.cs": "DIR_0/CLS_3.cs", "Pay/Lib/Job.cs": "DIR_0/lib/CLS_4.cs", "readme.md": "FILE_0.md"}
    mapping = spark.createDataFrame(list(new.items()), "path string, new_path string")
    docs = spark.createDataFrame([("tree.txt", TREE), ("plain.txt", "Sales Job.cs"), ("again.txt", TREE.upper()), ("none.txt", None)], "path string, content string")
    got = {r.path: r.content for r in paths.relisted(docs, mapping).collect()}
    want = ["Folder PATH listing for volume X", "C:.", "|   FILE_0.md", "|", "+---DIR_1", "|   |   CLS_0.cs", "|   |   CLS_1.cs", "|   |", "|   \\---Lib", "|           CLS_2.cs", "|", "\\---DIR_0", "    |   CLS_3.cs", "    \\---Lib", "            CLS_4.cs", "            unknown.cs"]
    assert got["tree.txt"].split("\n") == want
    assert got["plain.txt"] == "Sales Job.cs" and got["none.txt"] is None
    back = paths.relisted(spark.createDataFrame([("tree.txt", got["tree.txt"])], "path string, content string"), mapping, back=True)
    assert back.first().content == TREE


PROJECT = """<Project xmlns="http://schemas.microsoft.com/developer/msbuild/2003">
  <!-- <Compile Include="Old.cs" /> -->
  <Compile Include='A &amp; B.cs' />
  <Compile
     Include="sub\\C.cs" Link="x" />
  <ProjectReference Include = "..\\Other\\O.csproj"/>
  <PackageReference Include="Some.Package" Version="1" />
</Project>"""
SOLUTION = 'Microsoft Visual Studio Solution File\nProject("{F-1}") = "App", "App\\App.csproj", "{G-1}"\nEndProject\nProject("{F-2}") = "folder", "folder", "{G-2}"\nEndProject'
SLNX = "<Solution><Folder Name='/x/'><Project Path='App/App.csproj' /></Folder><!-- <Project Path=\"Other/O.csproj\" /> --></Solution>"


def test_project_files_are_read_as_xml(spark):
    docs = spark.createDataFrame([("App/App.csproj", PROJECT), ("All.sln", SOLUTION), ("All.slnx", SLNX), ("x.csproj", "<Broken Include='a"), ("n.csproj", None)], "path string, content string")
    new = {"App/App.csproj": "DIR_0/PROJ_0.csproj", "App/A & B.cs": "DIR_0/A<1>.cs", "App/Old.cs": "DIR_0/CLS_9.cs", "App/sub/C.cs": "DIR_0/DIR_1/CLS_1.cs", "Other/O.csproj": "DIR_2/PROJ_1.csproj", "All.sln": "PROJ_2.sln", "All.slnx": "PROJ_3.slnx", "x.csproj": "x.csproj"}
    mapping = spark.createDataFrame(list(new.items()), "path string, new_path string")
    refs = paths.resolved_entries(paths.project_references(docs), mapping)
    got = {(r.path, r.reference): r.new_reference for r in refs.collect()}
    assert got == {("App/App.csproj", "A &amp; B.cs"): "A&lt;1&gt;.cs", ("App/App.csproj", "sub\\C.cs"): "DIR_1\\CLS_1.cs", ("App/App.csproj", "..\\Other\\O.csproj"): "..\\DIR_2\\PROJ_1.csproj", ("All.sln", "App\\App.csproj"): "DIR_0\\PROJ_0.csproj", ("All.slnx", "App/App.csproj"): "DIR_0/PROJ_0.csproj"}
    done = {r.path: r.content for r in paths.patched(docs, refs).collect()}
    assert "Include='A&lt;1&gt;.cs'" in done["App/App.csproj"] and 'Include="Old.cs"' in done["App/App.csproj"] and "Path='DIR_0/PROJ_0.csproj'" in done["All.slnx"] and 'Path="Other/O.csproj"' in done["All.slnx"]
    back = paths.patched(spark.createDataFrame([(p, t) for p, t in done.items()], "path string, content string"), refs.select("path", F.col("new_reference").alias("reference"), F.col("reference").alias("new_reference")))
    assert {r.path: r.content for r in back.collect()} == {r.path: r.content for r in docs.collect()}


def test_imports_of_every_form(spark):
    text = "import a, {b} from './a';\nimport './side.js'\nexport * from \"../up\"\nconst c = require('./c')\nawait import(\"./d.mjs\")\nimport x from 'package'\nimport {\n  q\n} from './q'"
    got = paths.imports(spark.createDataFrame([("src/m.js", text), ("src/m.py", text)], "path string, content string")).collect()
    assert sorted(r.reference for r in got) == ["../up", "./a", "./c", "./d.mjs", "./q", "./side.js"] and {r.path for r in got} == {"src/m.js"}


COBOL = [
    "000100 IDENTIFICATION DIVISION.", "000200 PROGRAM-ID. 'PAY1'.", "000250* who pays", "000260/", "000300 DATA DIVISION.", "000310 FD  IN-FILE.", f"{'000400 01  IN-REC.':72}PAY00001", "000500     05  FILLER PIC X.", "000550     05  Amount PIC S9(5)V99 COMP-3 VALUE 0.",
    "000560     88  IS-OK VALUE 'YES IT IS'.", "000570     05  STATUS PICTURE  IS X(3).", "000700 PROCEDURE DIVISION.", "000800 MAIN-P.", "000900     MOVE AMOUNT TO CPY-TOTAL OF IN-REC.", "000950     DISPLAY \"Dear Meyer\" AMOUNT \"ok\" 'VAR_1 VAR_2'.", "001000     EXEC SQL",
    "001100      SELECT CITY INTO :HV-A FROM PROD.CLIENTS WHERE NAME = 'Meyer'", "001200     END-EXEC.", "001300     CALL 'SUB1' USING IN-REC(1:3).", "001400     EXEC CICS LINK PROGRAM('SUB2') COMMAREA(WS-AREA1) END-EXEC.", "001500     COPY 'CPY9'.", "", "001600-    'more'.", "001700 PARA-2 SECTION.",
]


def test_cobol_words_equal_the_plain_scanner(spark):
    texts = ["\n".join(COBOL), "\r\n".join(COBOL), "", None, "\n".join(COBOL[10:] + COBOL[:9]), "x", "000100 A.\n" * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), f"{ROW} long, content string")
    got = {}
    for r in cobol.spans(docs).collect():
        got.setdefault(r[ROW], set()).add((r.start, r.len, r.value, r.category))
    for k, t in enumerate(texts[:2]):
        sql = {s[:4] for s in mainframe.cobol_spans(t, True)}
        want = {s[:4] for s in mainframe.cobol_spans(t)} - sql
        assert {s for s in got[k] if s not in sql} == want
    for k, t in enumerate(texts):
        for start, n, value, category in got.get(k, ()):
            assert category == "Comment" or t[start : start + n].upper() == value.upper()


def test_a_full_table_of_reserved_words_makes_every_other_word_a_name(spark):
    docs = spark.createDataFrame([(0, "000700 PROCEDURE DIVISION.\n000800     MOVE TOTAL TO GRAND."), (1, "000700 PROCEDURE DIVISION.\n000800     MOVE TOTAL TO MOVE.")], f"{ROW} long, content string")
    full = spark.createDataFrame([("MOVE", False), ("TO", False), ("PROCEDURE", False), ("DIVISION", False)], "word string, plain boolean")
    assert {(r.value, r.category) for r in cobol.spans(docs, full).collect()} == {("TOTAL", "Variable"), ("GRAND", "Variable")}
    assert {r.category for r in cobol.spans(docs).collect()} == {"Known"}


def test_symbols_as_of_their_place(spark):
    job = "//J JOB A\n// SET A=1,B='X,Y'\n// SET C=&A.Z\n//D1 DD DSN=&A..&B,X=&C,Y=&N\n// SET A=$2\\q\n//D2 DD DSN=&A&C.&AB\n// SET A=&A.&A,D=&C&A\n//* &A\n//D3 DD DSN=&A.(&D)"
    docs = spark.createDataFrame([(1, job), (None, job.replace("=1", "=9")), (None, None), (1, "//X JOB &A"), (2, "")], "doc_id long, content string")
    got = {}
    for r in links.jcl_resolved(docs).collect():
        got.setdefault((r.doc_id, r.line_no), []).append(r.resolved)
    assert got[1, 4] == ["DSN=1.X,Y,X=1Z,Y=&N"] and got[None, 4] == ["DSN=9.X,Y,X=9Z,Y=&N"]
    assert got[1, 6] == ["DSN=$2\\q1Z&AB"] and got[1, 7] == ["A=$2\\q$2\\q,D=1Z$2\\q"] and got[1, 9] == ["DSN=$2\\q$2\\q(1Z$2\\q)"] and sorted(got[1, 1]) == ["&A", "A"]


def test_edges_and_what_they_reach(spark):
    program = "000100 IDENTIFICATION DIVISION.\n000200 PROGRAM-ID. PAY.\n000300 PROCEDURE DIVISION.\n000400     CALL 'TAX'.\n000500     CALL 'tax'.\n000600     COPY REC."
    docs = [(1, "a/pay.cbl", program), (1, "b/tax.cob", program.replace("PAY", "TAX").replace("'TAX'", "'PAY'")), (None, "c/rec.cpy", "000100     COPY SUB."), (None, "d/sub.CPY", "000100     COPY REC."), (5, "e/j.jcl", "//J JOB A\n//S EXEC PGM=PAY\n//T EXEC PGM=NONE"), (6, "f/tax.cbl", program.replace("PAY", "TAX")), (7, "g.txt", "COPY REC"), (8, "h.cbl", None)]
    edges = links.file_edges(spark.createDataFrame(docs, "doc_id long, path string, content string"))
    got = {tuple(r) for r in edges.collect()}
    assert got == {
        ("a/pay.cbl", "calls", "TAX", "b/tax.cob"), ("a/pay.cbl", "calls", "TAX", "f/tax.cbl"), ("a/pay.cbl", "copies", "REC", "c/rec.cpy"), ("b/tax.cob", "copies", "REC", "c/rec.cpy"), ("b/tax.cob", "calls", "PAY", "a/pay.cbl"), ("b/tax.cob", "calls", "TAX", "b/tax.cob"), ("b/tax.cob", "calls", "TAX", "f/tax.cbl"),
        ("c/rec.cpy", "copies", "SUB", "d/sub.CPY"), ("d/sub.CPY", "copies", "REC", "c/rec.cpy"), ("e/j.jcl", "runs", "PAY", "a/pay.cbl"), ("e/j.jcl", "runs", "NONE", None), ("f/tax.cbl", "copies", "REC", "c/rec.cpy"), ("f/tax.cbl", "calls", "TAX", "b/tax.cob"), ("f/tax.cbl", "calls", "TAX", "f/tax.cbl"),
    }
    far = {(r.source, r.target): (r.steps, r.cycle) for r in links.reached(edges).collect()}
    steps = {}
    pairs = {(a, b) for a, _, _, b in got if b}
    for a in {a for a, _ in pairs}:  # breadth first
        at, k = {a}, 0
        while at:
            at, k = {b for x, b in pairs if x in at and (a, b) not in steps}, k + 1
            steps.update({(a, b): k for b in at})
    assert far == {(a, b): (k, a == b) for (a, b), k in steps.items()}
    with pytest.raises(ValueError):
        links.reached(spark.createDataFrame([(str(i), str(i + 1)) for i in range(5)], "source string, target string"), rounds=3)
