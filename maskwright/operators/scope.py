"""Scopes (which processors rewrite) and dispatch (which processor a document goes to), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright.functions.naming import GROUPS, PROCESSORS
from maskwright.operators.languages.cards import is_text

# Extensions of each processor, in the order in which processors are asked.
EXTENSIONS = (
    ("tsql", (".sql",)),
    ("db2sql", (".db2", ".sql")),
    ("csharp", (".cs", ".csx")),
    ("vbnet", (".vb",)),
    ("javascript", (".js", ".jsx", ".mjs", ".cjs")),
    ("cobol", (".cbl", ".cob", ".cpy")),
    ("jcl", (".jcl", ".prc")),
    ("vbscript", (".vbs", ".bas", ".cls", ".frm")),
    ("oraclesql", (".pls", ".plb", ".pks", ".pkb", ".fnc", ".trg", ".prc")),
    ("fsharp", (".fs", ".fsx", ".fsi")),
    ("mainframe-utility", ()),
)
ORACLE_SIGNS = r"(?i)\b(CREATE\s+OR\s+REPLACE\s+PACKAGE|VARCHAR2|NVL|SYSDATE|DBMS_\w+|UTL_\w+|ROWNUM|CONNECT\s+BY|PRAGMA|%ROWTYPE|%TYPE|EXCEPTION\s+WHEN)\b"
VBA_SIGNS = r"(?i)\b(?:(?:Sub|Function|Dim)\s+\w|Option\s+(?:Explicit|Base|Compare|Private)|Property\s+(?:Get|Let|Set)\s+\w|(?:Public|Private)\s+(?:Sub|Function|Property|Const|Enum|Type)\b|Attribute\s+VB_)"
DB2_SIGNS = r"(?i)\b(TABLESPACE|BUFFERPOOL|STOGROUP|BIND\s+PACKAGE|WITH\s+UR|FETCH\s+FIRST\s+\d+\s+ROWS?\s+ONLY|EXEC\s+SQL)\b"


def parsed_scope(spec: str | None) -> set[str] | None:
    """Processor ids of a comma-separated list of groups and ids, in any case; None for no restriction; ValueError for unknown names."""
    if spec is None or not spec.strip():
        return None
    out: set[str] = set()
    for name in (x.strip().lower() for x in spec.split(",")):
        if not name:
            continue
        if name not in GROUPS and name not in PROCESSORS:
            raise ValueError(f"unknown scope: {name}; known are {', '.join([*GROUPS, *PROCESSORS])}")
        out.update(GROUPS.get(name, (name,)))
    return out or None


def in_scope(processor: Column, scope: set[str] | None) -> Column:
    return F.lit(True) if scope is None else F.coalesce(processor.isin(sorted(scope)), F.lit(False))


def delegation_only(processor: Column, scope: set[str] | None) -> Column:
    """Out of scope, but texts of other languages in it may still be rewritten."""
    return F.lit(False) if scope is None else F.coalesce(~processor.isin(sorted(scope)), F.lit(False))


def extension(path: Column) -> Column:
    """With its dot, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def looks_like_jcl(content: Column) -> Column:
    return F.size(F.filter(F.slice(F.split(content, "\n"), 1, 5), lambda x: x.startswith("//"))) >= 2


def looks_like_cobol(content: Column) -> Column:
    return content.rlike(r"(?im)^.{6}[ ].*\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b") | content.rlike(r"(?m)^.{6} +(01|05|10|77|88) +[A-Z0-9-]+.*\b(PIC|VALUE)\b")


def processor_of(path: Column, content: Column, by_content: bool = False) -> Column:
    """The processor id, null for none. Without an extension the content decides; a .bas file without a sign of VBA has none. A .sql file is T-SQL's and a .prc file JCL's;
    by_content lets a .sql or .prc file's content give it to DB2 or Oracle."""
    ext = extension(path)
    out = F.when(ext == "", F.when(looks_like_cobol(content), "cobol").when(looks_like_jcl(content), "jcl").when(is_text(content), "mainframe-utility"))
    if by_content:
        out = out.when(ext.isin(".sql", ".prc") & content.rlike(ORACLE_SIGNS), "oraclesql").when((ext == ".sql") & content.rlike(DB2_SIGNS), "db2sql")
    out = out.when((ext == ".bas") & ~F.coalesce(content.rlike(VBA_SIGNS), F.lit(False)), F.lit(None))
    for processor, exts in EXTENSIONS:
        if exts:
            out = out.when(ext.isin(*exts), processor)
    return out
