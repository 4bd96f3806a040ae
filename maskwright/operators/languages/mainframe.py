"""COBOL, JCL and utility cards at level 2: what to rewrite in one text, as spans like those of the lexers.

A span of category KNOWN is a mere use: it is rewritten only if some document of the corpus declares its value, so a
copybook's names reach the programs that copy it whichever is read first. COBOL has hundreds of reserved words; instead of
all of them the rule is that an undeclared word is a name if it has a hyphen or digit and is none of the hyphenated
reserved words, while a plain word has to be declared somewhere. No span crosses the end of a line.
"""

from __future__ import annotations

import re

from maskwright.operators.languages import cards
from maskwright.operators.languages.lines import JCL_KEYWORDS, LEVEL, NOT_PARAGRAPHS, SQL_PROGRAMS, SYSTEM_DDS, SYSTEM_SYMBOLS
from maskwright.operators.languages.tokens import REMOVED, code_spans

KNOWN = "Known"
Span = tuple[int, int, str, str, str, str]

# Reserved words that look like names, and plain ones that a dictionary of other languages may hold.
HYPHENATED = frozenset(
    """AREA-VALUE COMP-1 COMP-2 COMP-3 COMP-4 COMP-5 COMPUTATIONAL-1 COMPUTATIONAL-2 COMPUTATIONAL-3 COMPUTATIONAL-4 COMPUTATIONAL-5 DATE-COMPILED DATE-WRITTEN DAY-OF-WEEK
    DEBUG-ITEM DECIMAL-POINT DISPLAY-1 END-ADD END-CALL END-COMPUTE END-DELETE END-DIVIDE END-EVALUATE END-EXEC END-IF END-INVOKE END-MULTIPLY END-OF-PAGE END-PERFORM
    END-READ END-RETURN END-REWRITE END-SEARCH END-START END-STRING END-SUBTRACT END-UNSTRING END-WRITE FILE-CONTROL FUNCTION-POINTER GROUP-USAGE HIGH-VALUE HIGH-VALUES
    I-O I-O-CONTROL INPUT-OUTPUT LINE-COUNTER LINAGE-COUNTER LOCAL-STORAGE LOW-VALUE LOW-VALUES NATIONAL-EDITED NUMERIC-EDITED ALPHANUMERIC-EDITED ALPHABETIC-LOWER
    ALPHABETIC-UPPER OBJECT-COMPUTER PACKED-DECIMAL PROCEDURE-POINTER PROGRAM-ID RETURN-CODE SHIFT-IN SHIFT-OUT SORT-CONTROL SORT-CORE-SIZE SORT-FILE-SIZE SORT-MESSAGE
    SORT-MODE-SIZE SORT-RETURN SOURCE-COMPUTER SPECIAL-NAMES WHEN-COMPILED WORKING-STORAGE WRITE-ONLY""".split()
)
PLAIN = frozenset(
    """ACCEPT ACCESS ADD ADDRESS ADVANCING AFTER ALL ALSO AND ARE ASCENDING ASSIGN AT BEFORE BINARY BLANK BLOCK BY CALL CANCEL CHARACTERS CLOSE COMP COMPUTE CONTAINS CONTENT
    CONTINUE CONVERTING COPY COUNT DATA DATE DAY DELETE DELIMITED DEPENDING DESCENDING DISPLAY DIVIDE DIVISION DOWN DYNAMIC ELSE END ENTRY EQUAL ERROR EVALUATE EVERY EXEC EXIT
    EXTEND EXTERNAL FALSE FD FILE FILLER FIRST FOR FROM FUNCTION GIVING GLOBAL GO GOBACK GREATER IF IN INDEX INDEXED INITIAL INITIALIZE INPUT INSPECT INTO INVALID IS JUSTIFIED
    KEY LABEL LEADING LENGTH LESS LINE LINES LINKAGE MERGE MODE MOVE MULTIPLY NEXT NO NOT NULL NUMERIC OCCURS OF OMITTED ON OPEN OR ORGANIZATION OTHER OUTPUT PAGE PERFORM PIC
    PICTURE POINTER PROCEED PROGRAM QUOTE RANDOM READ RECORD RECORDING REDEFINES REFERENCE RELATIVE REPLACING RETURN REWRITE ROUNDED RUN SEARCH SECTION SELECT SENTENCE SEQUENTIAL
    SET SIGN SIZE SORT SPACE SPACES STANDARD START STATUS STOP STRING SUBTRACT TALLYING THAN THEN THROUGH THRU TIME TIMES TO TRUE UNSTRING UNTIL UP UPON USAGE USING VALUE VALUES
    VARYING WHEN WITH WRITE ZERO ZEROES ZEROS""".split()
)
JCL_VALUES = frozenset("SHR NEW OLD MOD KEEP PASS DELETE CATLG UNCATLG CYL TRK RLSE DUMMY ONLY EVEN COND EQ NE GT LT GE LE AND OR NOT THEN RC ABEND VB FB FBA VBA YES NO DSN DISP SPACE UNIT DCB VOL SER".split())
MAIL_WORDS = frozenset("FROM DATE SUBJECT REPLY MIME VERSION CONTENT TYPE TEXT PLAIN HTML CHARSET DATA QUIT THIS THAT WITH YOUR HAVE BEEN WILL PLEASE".split())

_WORD = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?")
_LITERAL = re.compile(r"'([^']*)'|\"([^\"]*)\"")
_PICTURE = re.compile(r"(?i)\bPIC(?:TURE)?\s+(?:IS\s+)?(\S+)")
_ALIAS = re.compile(r"[A-Z]+_\d+$")
_HOST = re.compile(r":\s*([A-Za-z][A-Za-z0-9_-]*)(?:\.([A-Za-z][A-Za-z0-9_-]*))?")
_EMAIL = re.compile(r"[\w.+-]+@[\w.-]+\.\w{2,}")
_DATASET = re.compile(r"\b([A-Z]{2,8}\.[A-Z][A-Z0-9]{1,7}(?:\.[A-Z0-9]{1,8}){0,5})\b")
_NAMED = [(kinds, re.compile(p), c) for kinds, p, c in cards.NAMED]
_DSN_COMMANDS = [(re.compile(p), c) for kinds, p, c in cards.NAMED if "Db2Bind" in kinds and c in ("Program", "Db2System", "MvsDataset")]


def rows(text: str) -> list[tuple[int, str]]:
    """(offset, line) without line ends."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line.rstrip("\r")))
        at += len(line) + 1
    return out


def span(at: int, value: str, category: str, head: str = "", tail: str = "") -> Span:
    return (at, len(value), value, category, head, tail)


def removed(at: int, n: int, head: str) -> Span:
    return (at, n, "", "Comment", head, "")


def inferred(word: str) -> str:
    """Category of a name that no line declares, by its shape."""
    if word.startswith(("DCLS", "DCLGEN")) or word.endswith(("-RECORD", "-REC")):
        return "CobolRecord"
    return "CobolFile" if word.endswith("-FILE") else "Variable"


def _declared(code: str, division: str, under_fd: bool) -> tuple[str, str] | None:
    """(name, category) of what a COBOL line's upper-case code declares."""
    for pattern, category in ((r"PROGRAM-ID\s*\.?\s+['\"]?([A-Z0-9][A-Z0-9-]*)", "Program"), (r"[FS]D\s+([A-Z0-9][A-Z0-9-]*)", "CobolFile"), (r"COPY\s+['\"]?([A-Z0-9][A-Z0-9-]*)", "Copybook")):
        if m := re.match(pattern, code):
            return m[1], category
    if m := re.match(r"(\d{1,2})\s+([A-Z0-9][A-Z0-9-]*)", code):
        if m[2] in PLAIN or not re.match(LEVEL, code):
            return None
        return m[2], "Condition" if m[1] == "88" else "CobolRecord" if m[1] in ("01", "1") and under_fd else "Variable"
    return None


def cobol_spans(text: str, sql_only: bool = False) -> list[Span]:
    """Names, literals and comments of a fixed-format source; with sql_only what stands in EXEC SQL blocks alone."""
    area: list[tuple[int, str, str, str]] = []  # offset of the code, code, its kind, division
    names: dict[str, str] = {}
    out: list[Span] = []
    division, block, under = "", "", False
    for at, line in rows(text):
        mark, code = line[6:7], line[7:72]
        if mark in ("*", "/"):
            if code.strip():
                out.append(removed(at + 7, len(line) - 7 if len(line) <= 72 else 65, f" {REMOVED}"))
            continue
        up = code.upper().strip()
        if not up:
            continue
        kind = block
        if not block and (m := re.match(r"EXEC\s+(SQL|CICS)\b", up)):
            kind = block = m[1]
        if kind:
            block = "" if "END-EXEC" in up else block
        elif m := re.search(r"\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b", up):
            division, kind = m[1], "division"
        elif re.search(r"\bSECTION\s*\.", up):
            under, kind = False, "section"
            if division == "PROCEDURE" and (m := _WORD.match(up)):
                names.setdefault(m[0], "Section")
        elif mark == "-":
            kind = "code"
        elif division != "PROCEDURE" or re.match(r"COPY\s", up):
            under = under or bool(re.match(r"[FS]D\s", up))
            if (found := _declared(up, division, under)) is not None and found[0] not in HYPHENATED:
                names.setdefault(*found)
            kind = "code"
        else:
            if code[:4].strip() and (m := _WORD.match(up)) and m[0] not in NOT_PARAGRAPHS and m[0] not in PLAIN and m[0] not in HYPHENATED:
                names.setdefault(m[0], "Paragraph")
            kind = "code"
        area.append((at + 7, code, kind, division))
    if sql_only:
        out = []

    def word(at: int, w: str, default: str = KNOWN) -> None:
        up = w.upper()
        if not re.search(r"[A-Z]", up) or up in HYPHENATED or up in PLAIN and up not in names:
            return
        category = names.get(up) or (inferred(up) if len(up) > 1 and (re.search(r"[-\d]", up) or up.startswith(("DCLS", "DCLGEN"))) else default)
        out.append((at, len(w), up, category, "", ""))

    start = 0
    while start < len(area):
        kind = area[start][2]
        end = start + 1
        if kind in ("SQL", "CICS"):
            while end < len(area) and area[end][2] == kind and "END-EXEC" not in area[end - 1][1].upper():
                end += 1
        if kind == "SQL":
            _block(text, area[start:end], out, word)
        elif kind != "division" and not sql_only:
            for at, code, _, _ in area[start:end]:
                _code(at, code, kind, names, out, word)
        start = end
    return [s for s in out if "\n" not in text[s[0] : s[0] + s[1]]]


def _block(text: str, lines: list, out: list[Span], word) -> None:
    """An EXEC SQL block as one statement: host variables are COBOL's, the rest is SQL's. All outside the code area is blanked."""
    first = lines[0][0]
    sql = list(re.sub(r"[^\n]", " ", text[first : lines[-1][0] + len(lines[-1][1])]))
    for at, code, _, _ in lines:
        code = re.sub(r"(?i)\bEXEC\s+SQL\b|\bEND-EXEC\b\.?", lambda m: " " * len(m[0]), code)
        if m := re.match(r"(?i)\s*INCLUDE\s+(\w[\w-]*)", code):
            if m[1].upper() not in ("SQLCA", "SQLDA"):
                out.append((at + m.start(1), len(m[1]), m[1].upper(), "Copybook", "", ""))
            continue
        for m in _HOST.finditer(code):
            for g in (1, 2):
                if m[g]:
                    word(at + m.start(g), m[g], "HostVariable")
        code = _HOST.sub(lambda m: "0".ljust(len(m[0])), code)  # a number, so INTO and FROM do not close up
        sql[at - first : at - first + len(code)] = code
    out += [(first + s[0], *s[1:]) for s in code_spans("".join(sql), "tsql")]


def _code(at: int, code: str, kind: str, names: dict, out: list[Span], word) -> None:
    free = list(code)
    for m in _LITERAL.finditer(code):
        inner, before = m[1] if m[1] is not None else m[2], code[: m.start()].upper().rstrip()
        free[m.start() : m.end()] = " " * len(m[0])
        if before.endswith(("CALL", "COPY", "PROGRAM(", "CANCEL")) and inner.strip():
            out.append((at + m.start() + 1, len(inner), inner.upper(), "Copybook" if before.endswith("COPY") else "Program", "", ""))
        elif len(inner) >= 4 and re.search(r"[^\W\d_]", inner) and not all(_ALIAS.match(w) or len(w) <= 1 for w in re.split(r"[ ,.]+", inner.strip())):
            out.append(span(at + m.start() + 1, inner, "StringLiteral"))
    for m in _PICTURE.finditer(code):
        free[m.start(1) : m.end(1)] = " " * len(m[1])
    rest = "".join(free)
    inside = [(0, len(rest))] if kind != "CICS" else [m.span(1) for m in re.finditer(r"\(([^()]*)\)", rest)]
    for a, b in inside:
        for m in _WORD.finditer(rest, a, b):
            word(at + m.start(), m[0])


def _operands(text: str) -> str:
    """The operand field: up to the first blank outside quotes."""
    quoted = False
    for k, c in enumerate(text):
        quoted ^= c == "'"
        if c == " " and not quoted:
            return text[:k]
    return text


def top_level(operands: str) -> list[tuple[int, str]]:
    """(offset, operand): parts between commas that stand outside quotes and parentheses."""
    out, depth, quoted, at = [], 0, False, 0
    for k, c in enumerate(operands):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and depth <= 0:
                out.append((at, operands[at:k]))
                at = k + 1
    return [*out, (at, operands[at:])]


def jcl_spans(text: str, sql_only: bool = False) -> list[Span]:
    """Names, operand values and comments of job control; in-stream SQL and DSN commands. With sql_only in-stream SQL alone."""
    out: list[Span] = []
    program, delimiter, instream, operation = "", "", False, ""
    sql: list[tuple[int, str]] = []

    def flush():
        if sql:
            first = sql[0][0]
            body = text[first : sql[-1][0] + len(sql[-1][1])]
            out.extend((first + s[0], *s[1:]) for s in code_spans(body, "tsql"))
            sql.clear()

    for at, line in rows(text):
        if instream:
            ends = line.startswith(delimiter) if delimiter else line.rstrip() == "/*" or line.startswith("//")
            if not ends:
                if program in SQL_PROGRAMS and not re.match(r"\s*(DSN|RUN|END|BIND)\b|.*\b(PLAN|LIB|LIBRARY)\s*\(", line, re.I):
                    sql.append((at, line))
                elif not sql_only:
                    out += [(at + m.start(1), len(m[1]), m[1], c, "", "") for p, c in _DSN_COMMANDS for m in p.finditer(line)]
                continue
            flush()
            instream = False
            if delimiter or not line.startswith("//"):
                continue
        if line.startswith("//*"):
            if not sql_only and line[3:].strip():
                out.append(removed(at, len(line), f"//* {REMOVED}"))
            continue
        if not line.startswith("//") or not line[2:].strip():
            continue
        m = re.match(r"//(\S*)( +)(\S+)(?: +(\S.*))?$", line)
        name, where, field = "", 0, ""
        if m and (m[3].upper() in JCL_KEYWORDS):
            name, operation = m[1], m[3].upper()
            where, field = (m.start(4), m[4]) if m[4] else (len(line), "")
        elif m and not m[1]:  # continuation
            where, field = m.start(3), line[m.start(3) :]
        field = _operands(field)
        if operation == "EXEC" and (p := re.search(r"(?i)\bPGM=([A-Z0-9@#$]+)", field)):
            program = p[1].upper()
        if operation == "DD" and (field == "*" or field.startswith("*,") or field.upper().startswith("DATA")):
            d = re.search(r"(?i)DLM='?(..)", field)
            instream, delimiter = True, d[1] if d else ""
        if not sql_only:
            _card(at, name, operation, at + where, field, bool(name), out)
    flush()
    return [s for s in out if "\n" not in text[s[0] : s[0] + s[1]]]


def _card(at: int, name: str, operation: str, where: int, field: str, starts: bool, out: list[Span]) -> None:
    category = {"JOB": "Job", "EXEC": "Step", "DD": "DDName", "PROC": "Proc"}.get(operation)
    if name and category:
        k = 2
        for part in name.split("."):
            last = k + len(part) == 2 + len(name)
            own = category if last else "Step"
            if part and not (own == "DDName" and (part.upper() in SYSTEM_DDS or re.match(r"(?i)SORTWK\d{1,2}$", part))):
                out.append(span(at + k, part, own))
            k += len(part) + 1
    taken: list[tuple[int, int]] = []

    def take(a: int, value: str, kind: str, head: str = "") -> None:
        if value.strip():
            out.append((where + a - len(head), len(value) + len(head), value, kind, head, ""))
            taken.append((a - len(head), a + len(value)))

    parts = top_level(field)
    if operation == "JOB" and starts:
        for a, part in [(a, p) for a, p in parts[:2] if "=" not in p]:
            inner = part.strip("'()")
            take(a + part.find(inner), inner, "Parameter")
    elif operation == "EXEC" and starts and parts[0][1] and "=" not in parts[0][1]:
        take(parts[0][0], parts[0][1], "Proc")
    elif operation in ("SET", "PROC"):
        for a, part in parts:
            if (m := re.match(r"&?([A-Za-z0-9@#$]+)=", part)) and f"&{m[1].upper()}" not in SYSTEM_SYMBOLS:
                take(a + m.start(1), m[1], "Symbol")
    elif operation == "INCLUDE" and (m := re.search(r"(?i)MEMBER=([A-Z0-9@#$]+)", field)):
        take(m.start(1), m[1], "Include")
    for m in re.finditer(r"&([A-Za-z0-9@#$]+)", field):
        if m[0].upper() not in SYSTEM_SYMBOLS and not field[: m.start()].endswith("&"):
            take(m.start(1), m[1], "Symbol", "&")
    for m in re.finditer(r"(?i)\b(?:DSN|DSNAME)=([A-Z0-9@#$.&]+)(?:\(([^)]*)\))?", field):
        still = re.sub(r"&&?[A-Za-z0-9@#$]+\.?", lambda s: " " * len(s[0]), m[1])
        if m[1].upper() != "NULLFILE":
            for p in re.finditer(r"[A-Za-z0-9@#$]+(?:\.[A-Za-z0-9@#$]+)*", still):
                take(m.start(1) + p.start(), p[0], "Dataset")
        if m[2] and re.fullmatch(r"[A-Za-z@#$][A-Za-z0-9@#$]*", m[2]):
            take(m.start(2), m[2], "Program")
    for m in re.finditer(r"(?i)\bPGM=([A-Z0-9@#$]+)|\bPROC=([A-Z0-9@#$]+)", field):
        g = 1 if m[1] else 2
        take(m.start(g), m[g], "Program" if g == 1 else "Proc")
    for m in re.finditer(r"(?i)\bPARM=(?:'([^']*)'|([^,'()]+))", field):
        g = 1 if m[1] is not None else 2
        if "&" not in m[g]:
            take(m.start(g), m[g], "Parameter")
    for m in re.finditer(r"[A-Za-z@#$][A-Za-z0-9@#$]+(?![A-Za-z0-9@#$]*=)", field):
        if m[0].upper() not in JCL_VALUES and not any(a < m.end() and m.start() < b for a, b in taken):
            out.append(span(where + m.start(), m[0], KNOWN))


def card_spans(text: str, kind: str) -> list[Span]:
    """What a utility card of a kind (of cards.card_type) names, and its comments."""
    out: list[Span] = []
    for kinds, pattern, category in _NAMED:
        if kind in kinds and kind != "Ftp":
            out += [(m.start(1), len(m[1]), m[1], category, "", "") for m in pattern.finditer(text)]
    body = False
    for k, (at, line) in enumerate(rows(text)):
        bare = line.strip()
        a = at + len(line) - len(line.lstrip())
        if not bare:
            continue
        if bare.startswith("*") and kind in ("Sort", "Mfs", "Parameter"):
            out.append(removed(at, len(line), f"*     {REMOVED}"))
        elif kind == "Sort":
            if (m := re.search(r"(?i)\d+\s*,\s*\d+\s*,\s*[A-Z]{2}\s*,\s*[A-Z]\s*[,)]?\s{2,}(\S.+?)\s*$", line)) and len(m[1]) >= 3 and re.search(r"[^\W\d_]", m[1]):
                out.append(span(at + m.start(1), m[1], "StringLiteral"))
        elif kind == "Ftp":
            _ftp(k, a, bare, out)
        elif kind == "Smtp":
            body = _smtp(a, bare, body, out)
        elif kind == "Mfs":
            for m in re.finditer(r"'([^']{3,})'", line):
                if not re.fullmatch(r"[\d ]+", m[1]):
                    out.append(span(at + m.start(1), m[1], "ScreenLabel"))
        elif kind == "Idcams":
            out += [span(at + m.start(1), m[1], "MvsDataset") for m in _DATASET.finditer(line)]
        elif kind == "Parameter":
            _tokens(at, line, out, lambda w: True)
    return [s for s in out if "\n" not in text[s[0] : s[0] + s[1]]]


def _ftp(k: int, at: int, line: str, out: list[Span]) -> None:
    """The target in the first line, a password in the second; folders, files and datasets of commands after that."""
    command, _, rest = line.partition(" ")
    if k == 0:
        out.append(span(at, line, "Hostname"))
    elif k == 1 and not rest and command.lower() not in cards.FTP_COMMANDS:
        out.append(span(at, line, "FtpCredential"))
    elif command.lower() == "cd" and rest.strip():
        out.append(span(at + line.find(rest.strip(), 2), rest.strip(), "UnixPath"))
    elif command.lower() in ("get", "put", "mget", "mput"):
        for m in re.finditer(r"'([^']+)'|([^\s']+)", rest):
            g = 1 if m[1] else 2
            out.append(span(at + len(command) + 1 + m.start(g), m[g], "MvsDataset" if g == 1 else "SourceFile"))


def _smtp(at: int, line: str, body: bool, out: list[Span]) -> bool:
    up = line.upper()
    if up == "DATA":
        return True
    if up.startswith("SUBJECT:") and line[8:].strip():
        subject = line[8:].strip()
        out.append(span(at + line.rfind(subject), subject, "StringLiteral"))
    elif body:
        if re.fullmatch(r"\*.*\S.*\*", line) and line[1:-1].strip():
            inner = line[1:-1].strip()
            out.append(span(at + line.find(inner, 1), inner, "StringLiteral"))
        else:
            _tokens(at, line, out, lambda w: w.upper() not in MAIL_WORDS and ("-" in w or w == w.upper() or len(w) >= 6 or any(c.isupper() for c in w)))
    return body


def _tokens(at: int, line: str, out: list[Span], counts) -> None:
    """Addresses, datasets, and words: those of four and more characters that count get aliases, others only if known."""
    rest = line
    for pattern, category in ((_EMAIL, "Email"), (_DATASET, "MvsDataset")):
        out += [span(at + m.start(), m[0], category) for m in pattern.finditer(rest)]
        rest = pattern.sub(lambda m: " " * len(m[0]), rest)
    for m in re.finditer(r"\b[A-Za-z][\w-]{2,}\b", rest):
        if not _ALIAS.match(m[0]):
            out.append(span(at + m.start(), m[0], "StringLiteral" if len(m[0]) >= 4 and counts(m[0]) else KNOWN))


def spans(text: str, processor: str) -> list[Span]:
    """Spans by processor: cobol, jcl (each with :sql for embedded SQL alone), mainframe-utility:<card type>."""
    name, _, detail = processor.partition(":")
    if not text:
        return []
    if name == "cobol":
        return cobol_spans(text, detail == "sql")
    if name == "jcl":
        return jcl_spans(text, detail == "sql")
    return card_spans(text, detail) if name == "mainframe-utility" else code_spans(text, processor)


def _broken(code: str, width: int, at: str, indent: str) -> list[str]:
    """Code in lines of at most width, broken after the last `at` outside quotes; what cannot be broken is cut."""
    out = []
    while len(code.rstrip()) > width:
        quoted, best, first = None, -1, len(code) - len(code.lstrip())
        for k, c in enumerate(code[: width + 1]):
            if quoted:
                quoted = None if c == quoted else quoted
            elif c in "'\"":
                quoted = c
            elif c == at and k >= first and k < width + (at == " "):
                best = k
        if best <= len(indent):
            code = code[:width]
            break
        keep = best + (at != " ")
        out.append(code[:keep].rstrip() if at == " " else code[:keep])
        code = indent + code[keep:].strip()
    return [*out, code.rstrip()]


def refitted(old: str, new: str, processor: str) -> str:
    """The rewritten text back in its columns, line by line: COBOL code in columns 8 to 72 with columns 73 to 80 as they
    were, JCL cards in 71. What has become too long goes on in a line of its own, at a blank or after a comma; what cannot
    be broken there, in-stream data over 80 columns and comments are cut, so restoring these is not exact."""
    was, now = old.split("\n"), new.split("\n")
    if processor not in ("cobol", "jcl") or len(was) != len(now):
        return new
    out = []
    for a, b in zip(was, now):
        end = "\r" if b.endswith("\r") else ""
        a, b = a.rstrip("\r"), b.rstrip("\r")
        if a == b:
            out.append(b + end)
        elif processor == "cobol":
            ident = a[72:]
            code = b[7 : len(b) - len(ident)] if ident else b[7:]
            parts = [code[:65]] if b[6:7] in ("*", "/") else _broken(code, 65, " ", " " * 8)
            out += [f"{b[:7]}{parts[0]:65}{ident}".rstrip() + end] + [f"{'':7}{p}{end}" for p in parts[1:]]
        elif b.startswith("//") and not b.startswith("//*"):
            out += [p + end for p in _broken(b, 71, ",", "//             ")]
        else:
            out.append(b[:80] + end)
    return "\n".join(out)


def problems(text: str, processor: str) -> list[str]:
    """Warnings about a COBOL or JCL text: lines over 80 columns, divisions or a JOB or PROC card that are missing."""
    out = [f"line {k} is longer than 80 columns" for k, (_, line) in enumerate(rows(text), 1) if len(line) > 80]
    if processor == "cobol":
        out += [f"no {d} DIVISION" for d in ("IDENTIFICATION", "PROCEDURE") if not re.search(rf"(?i)\b{d}\s+DIVISION\b", text)]
    elif processor == "jcl" and not re.search(r"(?im)^//\S+ +(JOB|PROC)\b", text):
        out.append("no JOB or PROC card")
    return out
