"""Source texts of each language, made by the same SQL in both engines, and what level 2 must make of them, written out by hand.

Every supplier gives two files, one that declares names and one that uses them. {m} is the supplier's number modulo 3, so
names repeat over the corpus; {c} is the number of its alias by order of appearance.
"""

from __future__ import annotations

#: language: (extension, aliases' numbers for {m} = 0, 1, 2, first file, second file, first expected, second expected)
SOURCES = {
    "csharp": (
        ".cs", (0, 2, 3),
        'namespace Acme.Pay {\n  // pay run\n  public class Payroll{m} {\n    private int total;\n    public void Post(string city) { total = city.Length; }\n  }\n}',
        'class Job { void Go() { var run = new Payroll{m}(); run.Post("north west"); var note = """say "Meyer owes" now"""; } }',
        'namespace NS_0.NS_1 {\n  // [Comment removed]\n  public class CLS_{c} {\n    private int FLD_0;\n    public void MTD_0(string PRM_0) { FLD_0 = PRM_0.Length; }\n  }\n}',
        'class CLS_1 { void MTD_1() { var VAR_0 = new CLS_{c}(); VAR_0.MTD_0("STR_0"); var VAR_1 = """STR_1"""; } }',
    ),
    "vb": (
        ".vb", (0, 2, 3),
        "Public Class Payroll{m}\n  Private total As Integer\n  Public Sub Post(ByVal city As String)\n    total = city.Length ' pay run\n    Rem pay run\n  End Sub\nEnd Class",
        'Class Job\n  Sub Go()\n    Dim run As New Payroll{m}\n    run.Post("north west")\n  End Sub\nEnd Class',
        "Public Class CLS_{c}\n  Private FLD_0 As Integer\n  Public Sub MTD_0(ByVal PRM_0 As String)\n    FLD_0 = PRM_0.Length ' [Comment removed]\n    Rem [Comment removed]\n  End Sub\nEnd Class",
        'Class CLS_1\n  Sub MTD_1()\n    Dim VAR_0 As New CLS_{c}\n    VAR_0.MTD_0("STR_0")\n  End Sub\nEnd Class',
    ),
    "fsharp": (
        ".fs", (0, 1, 2),
        "module Ledger\n// pay run\ntype Payroll{m}() =\n  member this.Post(city: string) = city",
        'module Job\nlet run = Payroll{m}()\nlet sent = run.Post("north west")\nlet note = """say "Meyer owes" now"""',
        "module MOD_0\n// [Comment removed]\ntype CLS_{c}() =\n  member this.MTD_0(PRM_0: string) = PRM_0",
        'module MOD_1\nlet VAR_0 = CLS_{c}()\nlet VAR_1 = VAR_0.MTD_0("STR_0")\nlet VAR_2 = """STR_1"""',
    ),
    "js": (
        ".js", (0, 1, 2),
        "// pay run\nexport class Payroll{m} {\n  post(city, month) { return city + month; }\n}",
        "import {Payroll{m}} from './pay';\nconst {total, list: rows} = new Payroll{m}();\nconst send = (first, second) => 'north west' + first + second;",
        "// [Comment removed]\nexport class CLS_{c} {\n  MTD_0(PRM_0, PRM_1) { return PRM_0 + PRM_1; }\n}",
        "import {CLS_{c}} from './pay';\nconst {VAR_0, list: VAR_1} = new CLS_{c}();\nconst VAR_2 = (PRM_2, PRM_3) => 'STR_0' + PRM_2 + PRM_3;",
    ),
    "vbs": (
        ".vbs", (0, 2, 3),
        "Function Payroll{m}(city)\n  ' pay run\n  Payroll{m} = city\nEnd Function",
        'Sub Job()\n  Dim total, _\n    rows(10)\n  total = Payroll{m}("north west")\n  rows = "say ""hi"" now"\nEnd Sub',
        "Function MTD_{c}(PRM_0)\n  ' [Comment removed]\n  MTD_{c} = PRM_0\nEnd Function",
        'Sub MTD_1()\n  Dim VAR_0, _\n    VAR_1(10)\n  VAR_0 = MTD_{c}("STR_0")\n  VAR_1 = "STR_1"\nEnd Sub',
    ),
    "tsql": (
        ".sql", (0, 1, 2),
        "CREATE PROCEDURE sales.Load{m} @id INT AS\n-- pay run\nSELECT o.Total FROM sales.Orders o WHERE o.Id = @id AND o.City = 'north west' OPTION (RECOMPILE)",
        "EXEC sales.Load{m} @id = 7\nINSERT INTO sales.Orders (Total, City) VALUES (N'it''s west', 'south')\nSELECT \"Order Details\".Id FROM \"Order Details\"",
        "CREATE PROCEDURE SCH_0.SP_{c} @PRM_0 INT AS\n-- [Comment removed]\nSELECT VAR_0.COL_0 FROM SCH_0.TBL_0 VAR_0 WHERE VAR_0.COL_1 = @PRM_0 AND VAR_0.COL_2 = 'STR_0' OPTION (RECOMPILE)",
        "EXEC SCH_0.SP_{c} @PRM_0 = 7\nINSERT INTO SCH_0.TBL_0 (COL_0, COL_2) VALUES (N'STR_1', 'STR_2')\nSELECT \"TBL_1\".COL_1 FROM \"TBL_1\"",
    ),
    "db2": (
        ".db2", (0, 1, 2),
        "CREATE TABLE PROD.PAY{m} (ID INTEGER, CITY CHAR(10)) IN PAYDB.PAYTS\n-- pay run",
        "SELECT p.CITY FROM PROD.PAY{m} p WHERE p.ID = :HVID AND p.CITY = 'north west' WITH UR",
        "CREATE TABLE SCH_0.TBL_{c} (COL_0 INTEGER, COL_1 CHAR(10)) IN DB_0.TS_0\n-- [Comment removed]",
        "SELECT VAR_0.COL_1 FROM SCH_0.TBL_{c} VAR_0 WHERE VAR_0.COL_0 = :HV_0 AND VAR_0.COL_1 = 'STR_0' WITH UR",
    ),
    "oracle": (
        ".pks", (0, 1, 2),
        "CREATE OR REPLACE PROCEDURE pay{m} (p_city IN VARCHAR2) IS\nBEGIN\n  -- pay run\n  DBMS_OUTPUT.PUT_LINE(p_city);\nEND;",
        "SELECT o.total, c.name FROM orders o, clients c, v$session s WHERE o.city = q'[it's west]' AND c.id = o.id",
        "CREATE OR REPLACE PROCEDURE SP_{c} (PRM_0 IN VARCHAR2) IS\nBEGIN\n  -- [Comment removed]\n  DBMS_OUTPUT.PUT_LINE(PRM_0);\nEND;",
        "SELECT VAR_0.COL_0, VAR_1.COL_1 FROM TBL_0 VAR_0, TBL_1 VAR_1, v$session VAR_2 WHERE VAR_0.COL_2 = q'[STR_0]' AND VAR_1.COL_3 = VAR_0.COL_3",
    ),
}


def quoted(text: str) -> str:
    """A text as an SQL expression in both dialects: no backslashes, line feeds by chr(10)."""
    return " || chr(10) || ".join("'" + line.replace("'", "''") + "'" for line in text.split("\n"))


def made_sql(language: str) -> str:
    """doc_id, path and content of the two files of every supplier."""
    ext, _, first, second, *_ = SOURCES[language]
    number = "CAST(s_suppkey % 3 AS STRING)"
    texts = [f"replace({quoted(t)}, '{{m}}', {number})" for t in (first, second)]
    return " UNION ALL ".join(f"SELECT s_suppkey * 2 + {k} AS doc_id, 'src/f' || CAST(s_suppkey * 2 + {k} AS STRING) || '{ext}' AS path, {t} AS content FROM supplier" for k, t in enumerate(texts))


def expected_sql(language: str) -> str:
    """doc_id and content that level 2 must give."""
    _, (zero, one, two), _, _, first, second = SOURCES[language]
    number = f"CASE s_suppkey % 3 WHEN 1 THEN '{one}' WHEN 2 THEN '{two}' ELSE '{zero}' END"
    return " UNION ALL ".join(f"SELECT s_suppkey * 2 + {k} AS doc_id, replace({quoted(t)}, '{{c}}', {number}) AS content FROM supplier" for k, t in enumerate((first, second)))
