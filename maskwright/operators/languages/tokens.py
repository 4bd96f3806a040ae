"""Source code by lexers: comments, literals and names of SQL dialects, .NET languages, JavaScript and VBScript as spans.

A lexer blanks comments and strings (lengths kept), so patterns on what is left find names only. Declarations give names
their categories; every later use of a declared name gets a span. In SQL dialects other identifiers that are no keyword,
function or type count as columns. This follows the languages' usual forms, not their full grammars; what is missed stays
as it is.
"""

from __future__ import annotations

import re

REMOVED = "[Comment removed]"
#: category of a mere use: rewritten only if a file of the same family of languages declares the name
KNOWN_BY_FAMILY = "KnownByFamily"

# Words that are never names.
SQL_WORDS = frozenset(
    """add all alter and any as asc authorization backup begin between break browse bulk by cascade case check checkpoint close clustered coalesce collate column commit constraint
    contains continue convert create cross current current_date current_time current_timestamp cursor database deallocate declare default delete deny desc distinct drop else end
    escape except exec execute exists exit external fetch file for foreign from full function go goto grant group having identity if in index inner insert intersect into is join
    key left like limit merge next no nocount not null nullif of off offset on open option or order out outer output over partition percent pivot primary print proc procedure
    public raiserror read references replace return returns revert revoke right rollback row rows rowcount schema select set some table then throw to top tran transaction
    trigger truncate try catch union unique unpivot update use using values varying view when where while with within xml""".split()
)
SQL_TYPES = frozenset("bigint binary bit char clob blob date datetime datetime2 datetimeoffset decimal float image int integer money nchar ntext number numeric nvarchar real smalldatetime smallint smallmoney sysname text time timestamp tinyint uniqueidentifier varbinary varchar varchar2 nvarchar2 raw long boolean pls_integer rowid max".split())
SQL_FUNCTIONS = frozenset("abs avg cast ceiling charindex concat count datalength dateadd datediff datename datepart day dense_rank floor format getdate getutcdate iif isnull lag lead len lower ltrim max min month newid ntile nvl decode patindex power rand rank round row_number rtrim scope_identity sign sqrt stuff substr substring sum sysdate systimestamp to_char to_date to_number trim trunc try_cast try_convert upper year instr length greatest least listagg".split())
SQL_WORDS |= frozenset("option recompile maxdop optimize unknown nolock rowlock updlock holdlock readpast tablock xlock serializable readcommitted snapshot isolation level transaction save rollback work only rollup cube grouping sets array apply hash loop force plan disable enable trigger statistics io ansi_nulls quoted_identifier xact_abort arithabort fillfactor online partition scheme filegroup login role permissions execute caller owner self schemabinding encryption returns readonly scroll static dynamic keyset fast_forward forward_only read_only absolute relative prior first last rows range preceding following unbounded current matched source target inserted deleted output waitfor delay".split())
SYSTEM_SCHEMAS = frozenset("sys dbo information_schema guest db_owner db_datareader db_datawriter".split())
ORACLE_WORDS = frozenset("is loop elsif package body type record exception others pragma raise rowtype sequence synonym materialized trigger before after each new old connect prior start level rownum nextval currval dual bulk collect forall found notfound isopen varray constant".split())
#: beginnings of Oracle's own views and packages
ORACLE_OWN = ("v$", "gv$", "dba_", "all_", "user_", "dbms_", "utl_")
ORACLE_QUOTES = {"[": "]", "(": ")", "{": "}", "<": ">"}
CODE_WORDS = frozenset(
    """abstract and as async await base bool boolean break byte case catch char class const continue debugger decimal default delegate delete dim do double dynamic each else elseif end enum event
    explicit export extends extern false finally fixed float for foreach friend from function get global goto if implements implicit import imports in inherits inner instanceof int integer
    interface internal is let lock long match me member module mustinherit mutable mybase namespace new next not nothing null object of open operator option optional or out override
    overridable byval byref paramarray params partial private property protected public readonly rec record redim ref return sbyte sealed select self set shared short single sizeof static step stop string
    struct structure sub super switch then this throw to true try type typeof uint ulong undefined union unsafe until ushort using val var virtual void volatile wend when where while with yield""".split()
)
FRAMEWORK = frozenset("Console Math String Object Array Task List Dictionary Exception Main ToString Equals GetHashCode Add Count Length System Linq Collections Generic Threading Text IO Net printfn sprintf console window document Promise JSON require module exports WScript Server Response Request".split())

ID = r"[^\W\d][\w$#@]*"
PART = rf"(?:\[[^\]\n]+\]|\"[^\"\n]+\"|[#@]{{0,2}}{ID})"
NAME = rf"{PART}(?:\s*\.\s*{PART}){{0,3}}"

DOTNET = (
    (rf"\bnamespace\s+({ID}(?:\.{ID})*)", "Namespace"), (rf"\bclass\s+({ID})", "Class"), (rf"\bstruct(?:ure)?\s+({ID})", "Class"), (rf"\binterface\s+({ID})", "Interface"), (rf"\brecord\s+(?:class\s+|struct\s+)?({ID})", "Record"), (rf"\benum\s+({ID})", "Enum"),
)
CSHARP = DOTNET + (
    (rf"\bdelegate\s+[\w<>\[\],.?\s]+?\s({ID})\s*\(", "Delegate"), (rf"\bevent\s+[\w<>\[\],.?]+\s+({ID})", "Event"),
    (rf"(?:public|private|protected|internal|static|virtual|override|async|abstract|sealed|partial|\s)+(?!(?:new|return|await|throw|else|yield|case|in|is|as|out|ref|using|goto)\b)[\w<>\[\],.?]+\s+({ID})\s*(?:<[\w,\s]+>)?\s*\((?![^)]*\)\s*;\s*$)", "Method"),
    (rf"\b[\w<>\[\],.?]+\s+({ID})\s*\{{\s*(?:get|set|init)\b", "Property"), (rf"\b(?:private|protected|public|internal|static|readonly|const)\s+(?:[\w<>\[\],.?]+\s+)+({ID})\s*(?:=|;)", "Field"),
    (rf"\b(?:var|int|string|bool|double|decimal|long|float|object|[A-Z][\w<>\[\],.?]*)\s+({ID})\s*(?:=(?!=)|;|\bin\b)", "Variable"), (rf"[(,]\s*(?:(?:this|ref|out|in|params)\s+)?[\w<>\[\].?]+\s+({ID})\s*(?=[,)=])", "Parameter"), (rf"\bcatch\s*\(\s*[\w.]+\s+({ID})", "Variable"),
)
VISUAL_BASIC = tuple((f"(?i){p}", c) for p, c in DOTNET) + (
    (rf"(?i)\bmodule\s+({ID})", "Module"), (rf"(?i)\b(?:sub|function)\s+({ID})", "Method"), (rf"(?i)\bproperty\s+(?:get\s+|let\s+|set\s+)?({ID})", "Property"), (rf"(?i)\bevent\s+({ID})", "Event"), (rf"(?i)\btype\s+({ID})", "UserDefinedType"),
    (rf"(?i)\b(?:dim|redim(?:\s+preserve)?|const|static)\s+({ID})", "Variable"), (rf"(?i)^\s*(?:private|public|friend|protected)\s+(?:shared\s+|readonly\s+|withevents\s+)*({ID})\s+as\b", "Field"), (rf"(?i)\b(?:byval|byref)\s+({ID})", "Parameter"), (rf"(?i)[(,]\s*({ID})\s+as\b", "Parameter"), (rf"(?i)\bfor\s+(?:each\s+)?({ID})\b", "Variable"),
)
FSHARP = (
    (rf"\bnamespace\s+({ID}(?:\.{ID})*)", "Namespace"), (rf"\bmodule\s+({ID})", "Module"), (rf"\btype\s+({ID})\s*=\s*\{{", "Record"), (rf"\btype\s+({ID})", "Class"), (rf"^\s*\|\s+({ID})\s*(?:of\b|$)", "UnionCase"),
    (rf"\blet\s+(?:rec\s+|inline\s+|mutable\s+|private\s+)*({ID})\s*=", "Variable"), (rf"\blet\s+(?:rec\s+|inline\s+|private\s+)*({ID})\s+[^=\n]", "Function"), (rf"\bmember\s+\w+\.({ID})", "Method"), (rf"\(\s*({ID})\s*:", "Parameter"),
)
JAVASCRIPT = (
    (rf"\bclass\s+({ID})", "Class"), (rf"\bfunction\s*\*?\s*({ID})", "Function"), (rf"\b(?:const|let|var)\s+({ID})", "Variable"), (rf"\bimport\s+({ID})", "ImportBinding"), (rf"\bimport\s*\*\s*as\s+({ID})", "ImportBinding"), (rf"\bimport\s*\{{[^}}]*?\bas\s+({ID})", "ImportBinding"),
    (rf"\b({ID})\s*=>", "Parameter"), (rf"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+({ID})", "ExportBinding"), (rf"\bcatch\s*\(\s*({ID})", "Variable"), (rf"^\s+(?:async\s+|static\s+)*({ID})\s*\([^)]*\)\s*\{{", "Method"),
)
SQL_DECLARED = (
    (rf"(?i)\bcreate\s+(?:or\s+(?:replace|alter)\s+)?proc(?:edure)?\s+({NAME})", "StoredProc"), (rf"(?i)\bexec(?:ute)?\s+(?!sp_|xp_|fn_)({NAME})", "StoredProc"), (rf"(?i)\bcreate\s+(?:or\s+(?:replace|alter)\s+)?function\s+({NAME})", "Function"), (rf"(?i)\bcreate\s+(?:or\s+replace\s+)?trigger\s+({NAME})", "StoredProc"),
    (rf"(?i)\bcreate\s+(?:or\s+replace\s+)?package\s+body\s+({NAME})", "OraclePackageBody"), (rf"(?i)\bcreate\s+(?:or\s+replace\s+)?package\s+(?!body\b)({NAME})", "OraclePackage"), (rf"(?i)\bmaterialized\s+view\s+({NAME})", "MaterializedView"), (rf"(?i)\bsequence\s+({NAME})", "Sequence"), (rf"(?i)\bsynonym\s+({NAME})", "Synonym"),
    (rf"(?i)\bdeclare\s+({ID})\s+(?:\w+\s+)*cursor\b", "Cursor"), (rf"(?i)\bcursor\s+({ID})\s+is\b", "Cursor"), (rf"(?i)\b(?:open|close|deallocate)\s+({ID})", "Cursor"), (rf"(?i)\bwith\s+({ID})\s*(?:\([^)]*\)\s*)?as\s*\(", "CTE"), (rf"(?i)\)\s*,\s*({ID})\s+as\s*\(", "CTE"), (rf"(?i)\bgoto\s+({ID})", "Variable"),
    (rf"(?i)\b(?:from|join|into|update|table|view|references)\s+({NAME})", "Table"),
    (rf"(?i)\bmerge\s+(?:into\s+)?{NAME}(?:\s+(?:as\s+)?{ID})?\s+using\s+({NAME})", "Table"), (rf"(?i)\bmerge\s+(?:into\s+)?{NAME}\s+(?:as\s+)?(?!using\b)({ID})\s+using\b", "Variable"), (rf"(?i)\busing\s+{NAME}\s+(?:as\s+)?(?!on\b)({ID})\s+on\b", "Variable"),
    (rf"(?i)\b(?:from|join)\s+{NAME}\s+(?:as\s+)?({ID})\s*(?=\bon\b|\bwhere\b|\bjoin\b|\binner\b|\bleft\b|\bright\b|,|;|\n|$)", "Variable"), (rf"(?i)({ID})\s*\.\s*(?:{ID}|\*|\[)", "Table"),
)
DB2 = (
    (rf"(?i)\bin\s+({ID})\s*\.\s*{ID}", "Database"), (rf"(?i)\bin\s+database\s+({ID})", "Database"), (rf"(?i)(?:\bin\s+(?:{ID}\s*\.\s*)?|\btablespace\s+)(?!database\b)({ID})", "Tablespace"), (rf"(?i)\bbufferpool\s+({ID})", "BufferPool"), (rf"(?i)\b(?:using\s+)?stogroup\s+({ID})", "StorageGroup"), (rf"(?i)\bcollection\s+({ID})", "Collection"), (rf"(?i)\bpackage\s+(?:{ID}\.)?({ID})", "Db2Package"), (rf"(?i)\bplan\s*\(\s*({ID})\s*\)", "Plan"), (rf"(?<=[\s,(=]):({ID})", "HostVariable"),
)


#: lists of names in one pair of brackets: parameters, destructured variables, imports, exports
JAVASCRIPT_LISTS = (
    (r"\bfunction\b[^({;]*\(([^)]*)\)", "Parameter"), (r"\(([^()]*)\)\s*=>", "Parameter"), (rf"^\s+(?:async\s+|static\s+)*(?!(?:if|for|while|switch|catch|return)\b){ID}\s*\(([^()]*)\)\s*\{{", "Parameter"),
    (r"\b(?:const|let|var)\s*\{([^}=]*(?:=[^},]*[^}=]*)*)\}\s*=", "Variable"), (r"\b(?:const|let|var)\s*\[([^\]]*)\]\s*=", "Variable"), (r"\bimport\s*(?:\w+\s*,\s*)?\{([^}]*)\}", "ImportBinding"), (r"\bexport\s*\{([^}]*)\}", "ExportBinding"),
)
BASIC_LISTS = ((r"(?i)\b(?:dim|redim(?:\s+preserve)?|const|static)[ \t]+([^\n:]+)", "Variable"), (r"(?i)\b(?:sub|function|property\s+(?:get|let|set))\s+\w+\s*\(([^)]*)\)", "Parameter"), (r"(?i)^[ \t]*(?:private|public)[ \t]+(?!(?:sub|function|property|class|const|enum|type|declare|event|default|shared|readonly|withevents|module|structure|interface|overridable|overrides|mustoverride|async|partial)\b)([^\n:]+)", "Field"))


def listed(inside: str) -> list[str]:
    """The names of a list: the last word of each item before its default, type or bounds ('a: b = 1' binds b, 'a as b' b, '...rest' rest)."""
    out = []
    for item in re.split(r",(?![^(\[{]*[)\]}])", inside):
        item = re.split(r"(?i)=|\(|\bas\s+(?:new\s+)?[\w.]+\s*$" if not re.search(r"\bas\b", item) else r"=|\(", item)[0]
        if found := re.findall(ID, item.replace("...", " ")):
            out.append(found[-1])
    return out


def basic_names(inside: str) -> list[str]:
    """The first word of each item of a declaration ('a, b(10) As Long, c = 1' declares a, b and c)."""
    return [m[1] for item in re.split(r",(?![^(]*\))", inside) if (m := re.match(rf"(?i)\s*(?:(?:optional|byval|byref|paramarray)\s+)*({ID})", item))]


class Language:
    def __init__(self, declared, line_marks, blocks, quotes, words, sql=False, any_case=False, doubled=True, verbatim=False, lists=(), q_quotes=False, triple=False, rem=False):
        self.triple, self.rem = triple, rem
        self.lists, self.q_quotes = [(re.compile(p, re.M), c) for p, c in lists], q_quotes
        self.declared = [(re.compile(p, re.M), c) for p, c in declared]
        self.line_marks, self.blocks, self.quotes, self.words, self.sql, self.any_case, self.doubled, self.verbatim = line_marks, blocks, quotes, words, sql, any_case, doubled, verbatim


SQL_ALL = SQL_WORDS | SQL_TYPES | SQL_FUNCTIONS
LANGUAGES = {
    "tsql": Language(SQL_DECLARED, ("--",), (("/*", "*/"),), "'", SQL_ALL, sql=True, any_case=False),
    "db2sql": Language(DB2 + SQL_DECLARED, ("--",), (("/*", "*/"),), "'", SQL_ALL | {"tablespace", "bufferpool", "stogroup", "collection", "package", "plan", "ur"}, sql=True),
    "oraclesql": Language(SQL_DECLARED, ("--",), (("/*", "*/"),), "'", SQL_ALL | ORACLE_WORDS, sql=True, q_quotes=True),
    "csharp": Language(CSHARP, ("//",), (("/*", "*/"),), "\"'", CODE_WORDS, doubled=False, verbatim=True, triple=True),
    "vbnet": Language(VISUAL_BASIC, ("'",), (), '"', CODE_WORDS, any_case=True, lists=BASIC_LISTS, rem=True),
    "vbscript": Language(VISUAL_BASIC, ("'",), (), '"', CODE_WORDS, any_case=True, lists=BASIC_LISTS, rem=True),
    "fsharp": Language(FSHARP, ("//",), (("(*", "*)"),), '"', CODE_WORDS, doubled=False, triple=True),
    "javascript": Language(JAVASCRIPT, ("//",), (("/*", "*/"),), "\"'`", CODE_WORDS, doubled=False, lists=JAVASCRIPT_LISTS),
}
_SQL_START = re.compile(r"\s*(SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|DROP|EXEC|EXECUTE|WITH|MERGE|DECLARE|BEGIN) ", re.I)
_NUMBER = re.compile(r"\s*[+-]?[\d,]*\.?\d+(e[+-]?\d+)?\s*$|^\d{4}[-/]\d{2}[-/]\d{2}|^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}$|^\d{1,2}-[A-Za-z]{3}-\d{2,4}$", re.I)
_OPENS = re.compile(r"\s*\(")
#: a comment word where a word begins, up to the end of its line
_REM = re.compile(r"(?i)rem(?=[ \t\r\n]|\Z)[^\n]*")
_WORD = re.compile(rf"@{{0,2}}#{{0,2}}{ID}|\[[^\]\n]+\]|\"[^\"\n]+\"")
_PLAIN_WORD = re.compile(ID)
#: what follows the first of several tables of a FROM
_MORE_TABLES = re.compile(r"(?is)\bfrom\s+[^;(),]*,([^;()]*?)(?=\b(?:where|group|order|having|union|inner|left|right|full|cross|join|on|connect|start|for|into|minus|intersect|loop|fetch|option)\b|[;()]|\Z)")
_ONE_TABLE = re.compile(rf"(?i)\s*({NAME})(?:\s+(?:as\s+)?({ID}))?\s*$")


def lexed(text: str, lang: Language) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with comments and strings blanked, and those as (start, end, 'comment' or its quote); comments nest in (* *)."""
    out, found, i, n = [], [], 0, len(text)

    def take(j, kind):
        found.append((i, j, kind))
        out.append(re.sub(r"[^\n]", " ", text[i:j]))
        return j

    while i < n:
        c = text[i]
        if any(text.startswith(m, i) for m in lang.line_marks):
            j = text.find("\n", i)
            i = take(n if j < 0 else j, "comment")
        elif (block := next((b for b in lang.blocks if text.startswith(b[0], i)), None)) is not None:
            j, depth = i + len(block[0]), 1
            while depth and j < n:
                if text.startswith(block[1], j):
                    depth, j = depth - 1, j + len(block[1])
                elif block[0] == "(*" and text.startswith("(*", j):
                    depth, j = depth + 1, j + 2
                else:
                    j += 1
            if lang.sql and text.startswith("/*+", i):  # optimizer hints stay
                out.append(text[i:j])
                i = j
            else:
                i = take(j, "comment")
        elif c in "qQ" and lang.q_quotes and text.startswith("'", i + 1) and i + 2 < n and not (i and (text[i - 1].isalnum() or text[i - 1] in "_$#") and text[i - 1] not in "nN"):
            close = ORACLE_QUOTES.get(text[i + 2], text[i + 2]) + "'"
            j = text.find(close, i + 3)
            i = take(n if j < 0 else j + 2, "q")
        elif c in "rR" and lang.rem and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and (m := _REM.match(text, i)):
            i = take(m.end(), "comment")
        elif c == '"' and lang.triple and text.startswith('"""', i):
            j = text.find('"""', i + 3)
            while 0 <= j and text.startswith('"', j + 3):  # quotes before the last three are inside
                j += 1
            i = take(n if j < 0 else j + 3, '"""')
        elif c in lang.quotes:
            j = i + 1
            verbatim = lang.verbatim and text[max(0, i - 2) : i].rstrip("$").endswith("@")
            while j < n:
                if text[j] == "\\" and not lang.doubled and not verbatim:
                    j += 2
                elif text[j] == c:
                    if (lang.doubled or verbatim) and j + 1 < n and text[j + 1] == c:
                        j += 2
                    else:
                        j += 1
                        break
                elif text[j] == "\n" and c != "`" and not lang.sql and not verbatim:
                    break
                else:
                    j += 1
            i = take(min(j, n), c)
        else:
            out.append(c)
            i += 1
    return "".join(out), found


def pieces(body: str, opener: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(texts, holes) of an interpolated string's inside, as (start, end); holes begin with opener and end with the brace that matches."""
    texts, holes, at, k, n = [], [], 0, 0, len(body)
    while k < n:
        if opener == "{" and body.startswith("{{", k):
            k += 2
        elif body.startswith(opener, k):
            texts.append((at, k))
            a, depth = k + len(opener), 1
            k = a
            while k < n and depth:
                depth += (body[k] == "{") - (body[k] == "}")
                k += 1
            holes.append((a, k - (depth == 0)))
            at = k
        else:
            k += 1
    return [*texts, (at, n)], holes


def _alternating(parts: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Texts and what lies between them, in turn, over 0 to n."""
    out = []
    for (p, q), nxt in zip(parts, [*parts[1:], (n, n)]):
        out += [(p, q), (q, nxt[0])]
    return out


def code_spans(text: str, processor: str, masked: str | None = None) -> list[tuple[int, int, str, str, str, str]]:
    """(start, length, value, category, head, tail): what to rewrite as head + alias + tail; comments have no value and head is the new text.

    masked: the text without comments and literals where the token relation has found them; then names alone are looked for.
    """
    lang = LANGUAGES.get(processor)
    if not lang or not text:
        return []
    masked, taken = lexed(text, lang) if masked is None else (masked, [])
    spans, seen, upto = [], [], 0
    for a, b, kind in taken:
        body = text[a:b]
        if kind == "comment":
            block = next((x for x in lang.blocks if body.startswith(x[0])), None)
            mark = next((m for m in lang.line_marks if body.startswith(m)), body[:3])
            spans.append((a, b - a, "", "Comment", f"{block[0]} {REMOVED} {block[1]}" if block else f"{mark} {REMOVED}", ""))
            continue
        if kind == "q":
            said = body[3:-2]
            if len(body) > 5 and body.endswith(ORACLE_QUOTES.get(body[2], body[2]) + "'") and said.strip() and not _NUMBER.match(said):
                spans.append((a, b - a, said, "StringLiteral", body[:3], body[-2:]))
            continue
        wide = len(kind)
        if len(body) < 2 * wide or not body.endswith(kind):
            continue  # does not end: what it would hold is not known, and it must come back as it is
        inner = body[wide:-wide]  # as written, doubled quotes too, so that it comes back as it was
        before = text[max(0, a - 60) : a]
        opener = "${" if kind == "`" else "{" if lang.verbatim and kind in ('"', '"""') and before[-2:].strip("@ (=,+").endswith("$") else ""
        if opener and opener in inner:
            parts, holes = pieces(inner, opener)
            for p, q in holes:  # code, whose names are rewritten like any others
                seen += [masked[upto : a + wide + p], text[a + wide + p : a + wide + q]]
                upto = a + wide + q
            for p, q in parts:
                said = inner[p:q].strip()
                if re.search(r"[^\W\d_]", said) and len(said) > 1 and "\\" not in said and "{{" not in said and not _SQL_START.match(inner):
                    spans.append((a + wide + inner.index(said, p), len(said), said, "StringLiteral", "", ""))
            if _SQL_START.match(inner):
                bare = "".join(inner[p:q] if k % 2 == 0 else " " * (q - p) for k, (p, q) in enumerate(_alternating(parts, len(inner))))
                spans += [(a + wide + s, *rest) for s, *rest in code_spans(bare, "tsql")]
            continue
        if processor == "csharp" and kind == "'":
            continue  # one character
        path = processor == "javascript" and (re.search(r"(from|require\s*\(|import\s*\(?)\s*$", before) or inner.startswith((".", "/")))
        if not inner.strip() or _NUMBER.match(inner) or path or (len(inner) >= 10 and _SQL_START.match(inner) and not lang.sql) or (kind == "`" and "${" in inner) or before.endswith("$"):
            if len(inner) >= 10 and _SQL_START.match(inner) and not lang.sql:
                spans += [(a + wide + s, n, v, c, h, t) for s, n, v, c, h, t in code_spans(inner, "tsql")]
            continue
        spans.append((a, b - a, inner, "StringLiteral", kind, kind))
    masked = "".join(seen) + masked[upto:]
    if processor in ("vbnet", "vbscript"):  # a line goes on after " _"
        masked = re.sub(r"[ \t]_[ \t]*\r?\n", lambda m: " " * len(m[0]), masked)
    names: dict[str, tuple[str, str]] = {}
    fold = (lambda s: s.lower()) if lang.any_case else (lambda s: s)

    def declare(word: str, category: str):
        bare = word.strip("[]\"")
        if bare.lower() not in lang.words and bare not in FRAMEWORK and len(bare) > (0 if lang.sql else 1):
            names.setdefault(fold(bare), (bare, category))

    def declare_sql(name: str, category: str):
        parts = [p.strip().strip('[]"') for p in re.split(r"\s*\.\s*", name)]
        owners, last = parts[:-1], parts[-1]
        kinds = ["Server", "Database", "Schema"][3 - len(owners) :] if len(owners) <= 3 else []
        system = owners and owners[-1].lower() in SYSTEM_SCHEMAS
        for owner, kind in zip(owners, kinds):
            if owner.lower() not in SYSTEM_SCHEMAS:
                declare(owner, kind)
        if system and category in ("Table", "StoredProc", "Function"):
            names.setdefault(last, (last, ""))  # what stands under a system schema keeps its name
        elif last.startswith("@"):
            declare(last, "Variable")
        else:
            declare(last, "TempTable" if last.startswith("#") else category)

    for pattern, category in lang.lists:
        for m in pattern.finditer(masked):
            for word in (basic_names if lang.any_case else listed)(m[1]):
                declare(word, category)
    if lang.sql:
        for m in _MORE_TABLES.finditer(masked):
            for item in m[1].split(","):
                if t := _ONE_TABLE.match(item):
                    declare_sql(t[1], "Table")
                    if t[2]:
                        declare(t[2], "Variable")
    for pattern, category in lang.declared:
        for m in pattern.finditer(masked):
            if lang.sql:
                declare_sql(m[1], category)
            else:
                for word in m[1].split("."):
                    declare(word, category)
    if lang.sql:
        for m in re.finditer(r"(?i)\bproc(?:edure)?\b[^;]*?\bas\b", masked):
            for p in re.finditer(rf"@{ID}", m[0]):
                declare(p[0], "Parameter")
    if lang.q_quotes:  # parameters of routines: name, mode, type
        for m in re.finditer(rf"(?i)\b(?:procedure|function)\s+{ID}(?:\s*\.\s*{ID})?\s*\(([^)]*)\)", masked):
            for item in m[1].split(","):
                if p := re.match(rf"\s*({ID})\s+\w", item):
                    declare(p[1], "Parameter")
    for m in (_WORD if lang.sql else _PLAIN_WORD).finditer(masked):
        word = m[0]
        bare = word.strip('[]"')
        low = bare.lower()
        if low in lang.words or bare in FRAMEWORK or low in SYSTEM_SCHEMAS and lang.sql or lang.q_quotes and low.startswith(ORACLE_OWN):
            continue
        if lang.q_quotes and low in ("q", "nq") and masked[m.end() : m.end() + 1] in ("", " ") and text[m.end() : m.end() + 1] == "'":
            continue
        known = names.get(fold(bare))
        if known is None:
            if not lang.sql:
                if len(bare) > 1 and (processor != "javascript" or bare[:1].isupper()):
                    known = (bare, KNOWN_BY_FAMILY)
                else:
                    continue
            elif _OPENS.match(masked, m.end()):
                continue
        if known is None:
            known = (bare, "Variable" if bare.startswith("@") else "Column")
        if not known[1] or bare.startswith("@@"):
            continue
        if lang.sql and low in ("n", "x") and text[m.end() : m.end() + 1] == "'":
            continue  # a literal's prefix
        if processor == "javascript":
            k = m.start() - 1
            while k >= 0 and masked[k].isspace():
                k -= 1
            if k >= 0 and masked[k] == "." and masked[max(0, k - 2) : k + 1] != "...":
                continue
        value, head = known[0], ""
        if value.startswith("@"):  # the key goes without its mark, the text keeps it
            value, head = value[1:], "@"
        tail = ""
        if word[0] in '["':
            head, tail = word[0] + head, word[-1]
        spans.append((m.start(), len(word), value, known[1], head, tail))
    return _later(spans) if processor == "javascript" else spans


def _later(spans: list[tuple]) -> list[tuple]:
    """Of spans that overlap the one that starts later."""
    out: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0], s[1])):
        while out and out[-1][0] + out[-1][1] > s[0]:
            out.pop()
        out.append(s)
    return out


def local_places(masked: str, processor: str) -> list[tuple[int, str]]:
    """(start, name) of the places where a C# source declares parameters and variables."""
    lang = LANGUAGES[processor]
    return [(m.start(1), m[1]) for p, category in lang.declared if category in ("Parameter", "Variable") for m in p.finditer(masked) if m[1].lower() not in lang.words]


def balanced(text: str, processor: str) -> list[str]:
    """Problems of an F# or JavaScript text: parentheses that do not match, strings and comments that do not end."""
    lang = LANGUAGES[processor]
    masked, taken = lexed(text, lang)
    out, depth = [], 0
    for c in masked:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            out.append("unexpected )")
            break
    if depth > 0:
        out.append("missing )")
    for a, b, kind in taken:
        if kind != "comment" and (b - a < 2 * len(kind) or not text[:b].endswith(kind)):
            out.append("string does not end")
        elif kind == "comment" and (block := next((x for x in lang.blocks if text.startswith(x[0], a)), None)) and not text[a:b].endswith(block[1]):
            out.append("comment does not end")
    return out
