"""Alias prefixes of semantic categories, processor ids and their groups. Fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = {
    "Namespace": "NS", "Class": "CLS", "Interface": "INTF", "Method": "MTD", "Property": "PROP", "Field": "FLD", "Variable": "VAR", "Parameter": "PRM",
    "Event": "EVT", "Delegate": "DEL", "Enum": "ENM", "EnumMember": "ENMV", "TypeParameter": "TP", "Module": "MOD", "Record": "REC", "UnionCase": "UC",
    "ImportBinding": "IMP", "ExportBinding": "EXP",
    "UserDefinedType": "UDT",
    "Table": "TBL", "Column": "COL", "Schema": "SCH", "Database": "DB", "StoredProc": "SP", "Function": "FN", "CTE": "CTE", "TempTable": "TMP", "Cursor": "CUR", "SqlPackage": "SPKG", "Sequence": "SEQ",
    "OraclePackage": "PKG", "OraclePackageBody": "PKGB", "MaterializedView": "MV", "Synonym": "SYN",
    "Tablespace": "TS", "Plan": "PLN", "Db2Package": "DPKG", "Collection": "COLL", "StorageGroup": "STOG", "BufferPool": "BP",
    "Program": "PGM", "Paragraph": "PARA", "Section": "SEC", "Copybook": "CPY", "CobolFile": "FIL", "CobolRecord": "CREC", "Condition": "CND",
    "Job": "JOB", "Step": "STP", "DDName": "DD", "Proc": "PRC", "Dataset": "DSN", "Symbol": "SYM", "Include": "INC",
    "SourceFile": "FILE", "Directory": "DIR", "ProjectFile": "PROJ",
    "Email": "EMAIL", "MvsDataset": "DSN", "VolumeSerial": "VOL", "ScreenLabel": "LABEL", "MfsMap": "MFSMAP", "Db2System": "SYS", "FtpCredential": "CRED", "UnixPath": "UPATH",
    "StringLiteral": "STR", "Comment": "CMT", "HostVariable": "HV",
    "Server": "SERVER", "IpAddress": "IP", "Path": "PATH", "Hostname": "HOST", "ConnectionString": "CONNSTR", "Generic": "GEN",
}
UNKNOWN_PREFIX = "GEN"

GROUPS = {
    "database": ("tsql", "db2sql", "oraclesql"),
    "mainframe": ("cobol", "jcl", "mainframe-utility"),
    "dotnet": ("csharp", "vbnet", "fsharp"),
    "web": ("javascript",),
    "scripting": ("vbscript",),
}
PROCESSORS = tuple(p for group in GROUPS.values() for p in group)


def prefix_of(category: Column) -> Column:
    pairs = [x for c, p in PREFIXES.items() for x in (F.lit(c), F.lit(p))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), F.lit(UNKNOWN_PREFIX))


def alias_of(prefix: Column, n: Column) -> Column:
    return F.concat_ws("_", prefix, n.cast("string"))
