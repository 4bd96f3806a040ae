"""Sources that differ from row to row, many of them broken, and what is to be found in them by DuckDB's SQL."""

from __future__ import annotations

from maskwright.operators.languages.cobol import LEXEMES
from maskwright.operators.languages.mainframe import HYPHENATED, PLAIN
from maskwright.operators.languages.relation import NO_BLOCK, OTHER_ENDS, pattern


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


#: T-SQL of every order: literals with doubled quotes, comments that hold quotes, nested parentheses; some rows lack an end
scripts_sql = f"""SELECT o_orderkey AS doc_id, {_lines(
    "'CREATE PROC dbo.[Load ' || " + _s("o_custkey % 40") + " || '] @p' || " + _s("o_custkey % 7") + " || ' INT AS -- it''s for ' || o_orderpriority",
    "CASE WHEN o_orderkey % 3 = 0 THEN 'BEGIN TRAN' ELSE 'SET NOCOUNT ON' END",
    "repeat('BEGIN ', o_custkey % 3) || 'SELECT \"Total Price\", (' || repeat('(', o_orderkey % 5) || '1' || repeat(')', (o_orderkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) % 5) || ') /* (x ''y */ FROM t' || " + _s("o_custkey % 9"),
    "'WHERE s = N''' || o_orderstatus || '''''s -- no comment'' AND d = CASE WHEN a = 1 THEN ''(' || " + _s("o_orderkey % 13") + " || ')'' END'",
    "repeat('END ', CASE WHEN o_custkey % 17 = 0 THEN 0 ELSE o_custkey % 3 END)",
    "CASE o_orderkey % 19 WHEN 0 THEN '/* open ( ' WHEN 1 THEN 'PRINT ''open' WHEN 2 THEN 'SELECT \"open' WHEN 3 THEN 'SELECT [a' ELSE '-- done /* ' END",
)} AS content FROM orders"""  # fmt: skip

#: a Basic macro of every customer: blocks in blocks; some rows lack an end or have one too many
macros_sql = f"""SELECT c_custkey AS doc_id, {_lines(
    "'Public Sub Load' || " + _s("c_custkey % 30") + " || '(ByVal x)'",
    "CASE WHEN c_custkey % 4 = 0 THEN '  Rem for ' || c_mktsegment ELSE '  '' End Sub of ' || c_name END",
    "'  If x > 1 Then ' || CASE WHEN c_custkey % 5 = 0 THEN 'y = 2' ELSE '' END",
    "'    For i = 1 To (' || " + _s("c_nationkey") + " || CASE WHEN c_custkey % 13 = 0 THEN '' ELSE ')' END",
    "'      s = \"say \"\"End If\"\" ' || c_mktsegment || CASE WHEN c_custkey % 23 = 0 THEN '' ELSE '\"' END || ' & _'",
    "'        \"Do\"'",
    "CASE WHEN c_custkey % 7 = 0 THEN '    Loop' ELSE '    Next' END",
    "CASE WHEN c_custkey % 5 = 0 THEN '  While x' ELSE '  Select Case x' END",
    "CASE WHEN c_custkey % 5 = 0 THEN '  Wend' WHEN c_custkey % 6 = 0 THEN '  End With' ELSE '  End Select' END",
    "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '  End If' END",
    "CASE WHEN c_custkey % 9 = 0 THEN 'Exit Sub' ELSE 'End Sub' END",
)} AS content FROM customer"""  # fmt: skip

#: a C# class of every part: locals of the same names in several methods and blocks, uses where none is visible
classes_sql = f"""SELECT p_partkey AS doc_id, {_lines(
    "'namespace Acme { class P' || " + _s("p_partkey") + " || ' { // ' || p_name || ' { int v1'",
    "'  int One(int v' || " + _s("p_size % 5") + " || ') { var v1 = \"{ int v2 }\"; for (int v2 = 0; v2 < v' || " + _s("p_size % 5") + " || '; v2++) { var v3 = v1; v3 = v2; } return v2 + v1; }'",
    "'  int Two(int v0, int v2) { { var v1 = v0; { int v' || " + _s("p_size % 4") + " || ' = v1; Use(v0, v1, v2, v3); } } return v1; }'",
    "CASE WHEN p_partkey % 3 = 0 THEN '  int v' || " + _s("p_partkey % 4") + " || ' = ''{'';' ELSE '' END",
    "'  void Three() { Use(v0, v1, v2, v3' || repeat(', v4', p_size) || '); if (v1) { int v4 = 1; Use(v4); }' || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE ' }' END",
    "'} }'",
)} AS content FROM part"""  # fmt: skip

#: a COBOL program of every customer: names that it declares, names from copybooks, reserved words, pictures, literals, a remark
routines_sql = f"""SELECT c_custkey AS doc_id, {_lines(
    "'000100 IDENTIFICATION DIVISION.'", "'000200 PROGRAM-ID. PGM' || " + _s("c_custkey % 40") + " || '.'", "'000300 DATA DIVISION.'", "'000350 WORKING-STORAGE SECTION.'", "'000400 01  WS-REC-' || " + _s("c_custkey % 30") + " || '.'",
    "'000500     05  AMOUNT' || " + _s("c_custkey % 7") + " || ' PIC S9(5)V99 COMP-3 VALUE ' || " + _s("c_custkey % 9") + " || '.'", "'000600     05  STATUS-' || " + _s("c_custkey % 5") + " || ' PICTURE IS X(10).'", "'000700* paid for ' || c_name", "'000800 PROCEDURE DIVISION.'",
    "'000900 MAIN-' || " + _s("c_custkey % 25") + " || '.'", "'001000     MOVE ''' || c_mktsegment || ' of ' || " + _s("c_custkey % 11") + " || ''' TO Cpy-Field-' || " + _s("c_custkey % 6") + " || '.'",
    "'001100     IF AMOUNT' || " + _s("c_custkey % 7") + " || ' > 5 PERFORM SUB-' || " + _s("c_custkey % 4") + " || ' THRU MAIN-' || " + _s("c_custkey % 25") + " || ' END-IF.'",
    "'001200     CALL \"LIB' || " + _s("c_custkey % 8") + " || '\" USING WS-REC-' || " + _s("c_custkey % 30") + " || '.'", "'001300     COPY CPY' || " + _s("c_custkey % 3") + " || '.'",
)} AS content FROM customer"""  # fmt: skip

#: a job of every supplier that sets its symbols again and again; values hold symbols
symbols_sql = f"""SELECT s_suppkey AS doc_id, {_lines(
    "'//JOB1 JOB (A)'", "'// SET HLQ=ACME' || " + _s("s_suppkey % 13") + " || ',ENV=T' || " + _s("s_nationkey % 3"), "'// SET LIB=&HLQ..LOAD,TOP=&LIB'", "'//S1 EXEC PGM=P1'", "'//D1 DD DSN=&LIB..&ENV,DISP=SHR'", "'// SET HLQ=NEW$' || " + _s("s_suppkey"),
    "'//D2 DD DSN=&HLQ..&ENV..X&SYSUID'", "CASE WHEN s_suppkey % 2 = 0 THEN '// SET LIB=&HLQ..LIB' ELSE '//* SET LIB=NONE' END", "'// SET DEEP=&LIB..D'", "'//D3 DD DSN=&DEEP(&MEM),DISP=SHR'", "'//P1 PROC MEM=M' || " + _s("s_suppkey % 4") + " || ',HLQ=&ENV'", "'//D4 DD DSN=&LIB(&MEM).&HLQ.&HLQS..&TOP'",
)} AS content FROM supplier"""  # fmt: skip

#: programs, copybooks and jobs that take each other by number; some name what is nowhere, and copybooks go round
network_sql = f"""SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'jobs/J' || {_s("p_partkey")} || '.jcl' WHEN 1 THEN 'src/P' || {_s("p_partkey")} || '.cbl' WHEN 2 THEN 'copy/C' || {_s("p_partkey")} || '.cpy' ELSE 'src/old/P' || {_s("p_partkey")} || '.cob' END AS path,
CASE WHEN p_partkey % 4 = 0 THEN {_lines("'//J JOB A'", "'//S1 EXEC PGM=PG' || " + _s("p_partkey + 1"), "'//S2 EXEC PGM=PG' || " + _s("p_size"), "'//S3 EXEC PGM=PG' || " + _s("p_partkey + 1"))}
WHEN p_partkey % 4 = 2 THEN {_lines("'000100 01  REC-A.'", "'000200     COPY C' || " + _s("CASE WHEN p_partkey % 40 = 38 THEN p_partkey - 36 ELSE p_partkey + 4 END") + " || '.'")}
ELSE {_lines("'000100 IDENTIFICATION DIVISION.'", "'000200 PROGRAM-ID. PG' || " + _s("CASE WHEN p_partkey % 8 = 7 THEN p_partkey - 2 ELSE p_partkey END") + " || '.'", "'000300 PROCEDURE DIVISION.'", "'000400     CALL ''PG' || " + _s("p_partkey + 4") + " || '''.'", "'000500     COPY C' || " + _s("p_partkey + 1") + " || '.'")} END AS content FROM part"""  # fmt: skip


def _tokens(sql: str, language: str) -> str:
    """docs, then t: doc_id, place, text and start of each token."""
    return f"""docs AS ({sql}), parts AS (SELECT doc_id, regexp_extract_all(content, {_q(pattern(language, possessive=False))}) AS ps FROM docs),
split AS (SELECT doc_id, unnest(range(0, len(ps))) AS place, unnest(ps) AS text FROM parts),
t AS (SELECT *, (coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start FROM split WHERE text <> '')"""


_SQL_TOKENS = f"""{_tokens(scripts_sql, "tsql")},
k AS (SELECT *, CASE WHEN text LIKE '--%' OR text LIKE '/*%' THEN 'comment' WHEN regexp_matches(text, '^[nN]?''') THEN 'literal' WHEN length(text) > 1 AND text[1] IN ('"', '[') THEN 'quoted'
  WHEN regexp_matches(text, '^[@#]*[\\p{{L}}_]') THEN 'word' WHEN regexp_matches(text, '^[0-9]') THEN 'number' WHEN trim(replace(text, chr(10), ' ')) = '' THEN 'space' ELSE 'mark' END AS kind FROM t),
d AS (SELECT *, (sum(CASE WHEN kind = 'mark' AND text = '(' THEN 1 WHEN kind = 'mark' AND text = ')' THEN -1 ELSE 0 END) OVER w + CASE WHEN kind = 'mark' AND text = ')' THEN 1 ELSE 0 END)::BIGINT AS depth FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY place))"""

_BASIC = f"""{_tokens(macros_sql, "vbscript")},
k AS (SELECT *, CASE WHEN text[1] = '''' OR regexp_matches(text, '(?i)^rem([ \\t]|$)') THEN 'comment' WHEN text[1] = '"' THEN 'literal' WHEN regexp_matches(text, '^[ \\t]+_[ \\t]*\\n$') THEN 'continued' ELSE 'code' END AS kind,
  (sum(CASE WHEN text = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place))::BIGINT AS line FROM t),
said AS (SELECT doc_id, line, trim(string_agg(CASE kind WHEN 'literal' THEN '""' WHEN 'continued' THEN ' ' ELSE lower(text) END, '' ORDER BY place)) AS code FROM k WHERE kind <> 'comment' AND text <> chr(10) GROUP BY doc_id, line),
steps AS (SELECT *, CASE WHEN starts_with(code, 'public sub ') THEN 'sub' WHEN regexp_matches(code, '^if .* then$') THEN 'if' WHEN starts_with(code, 'for ') THEN 'for' WHEN starts_with(code, 'while ') THEN 'while' WHEN starts_with(code, 'select case ') THEN 'select' END AS opens,
  CASE WHEN code = 'next' THEN 'for' WHEN code = 'loop' THEN 'do' WHEN code = 'wend' THEN 'while' WHEN code LIKE 'end %' THEN code[5:] END AS closes FROM said),
-- a stack, one row after the other: open words, and the first that closes out of turn
folded AS (SELECT doc_id, list_reduce(list_prepend({{'open': []::VARCHAR[], 'bad': NULL::VARCHAR, 'o': NULL::VARCHAR, 'c': NULL::VARCHAR, 'w': NULL::VARCHAR}}, list({{'open': []::VARCHAR[], 'bad': NULL::VARCHAR, 'o': opens, 'c': closes, 'w': regexp_extract(code, '^\\w+')}} ORDER BY line)),
  lambda a, x: CASE WHEN a.bad IS NOT NULL THEN a WHEN x.o IS NOT NULL THEN {{'open': list_append(a.open, x.o), 'bad': NULL, 'o': NULL, 'c': NULL, 'w': NULL}}
    WHEN len(a.open) > 0 AND a.open[-1] = x.c THEN {{'open': a.open[:-2], 'bad': NULL, 'o': NULL, 'c': NULL, 'w': NULL}} ELSE {{'open': a.open, 'bad': x.w, 'o': NULL, 'c': NULL, 'w': NULL}} END) AS f
  FROM steps WHERE opens IS NOT NULL OR closes IS NOT NULL GROUP BY doc_id),
marks AS (SELECT doc_id, sum(CASE WHEN text = '(' THEN 1 WHEN text = ')' THEN -1 ELSE 0 END) AS net, bool_or(kind = 'literal' AND (length(text) - length(replace(text, '"', ''))) % 2 = 1) AS ragged FROM k GROUP BY doc_id)"""

_SCOPES = f"""{_tokens(classes_sql, "csharp")},
k AS (SELECT *, CASE WHEN text LIKE '//%' OR text LIKE '/*%' OR regexp_matches(text, '^[@$]*["'']') THEN '' ELSE text END AS code FROM t),
d AS (SELECT *, sum(CASE code WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS depth, sum(CASE code WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER w + CASE code WHEN '}}' THEN 1 ELSE 0 END AS level FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
braces AS (SELECT doc_id, place AS block, coalesce((SELECT max(h.place) + 1 FROM d h WHERE h.doc_id = d.doc_id AND h.place < d.place AND (h.code IN ('{{', '}}') OR h.code = ';' AND h.depth <= 0)), 0) AS "from",
  coalesce((SELECT min(c.place) FROM d c WHERE c.doc_id = d.doc_id AND c.place > d.place AND c.code = '}}' AND c.level = d.level), 1000000000) AS "to" FROM d WHERE code = '{{'),
blocks AS (SELECT * FROM braces UNION ALL SELECT doc_id, -1, 0, 1000000000 FROM docs),
words AS (SELECT doc_id, place, code AS value, lag(code) OVER (PARTITION BY doc_id ORDER BY place) AS before FROM k WHERE regexp_matches(code, '^@?[A-Za-z_]\\w*$')),
named AS (SELECT * FROM words WHERE regexp_matches(value, '^v[0-9]+$')),
homes AS (SELECT DISTINCT n.doc_id, n.value, arg_max(b.block, (b."from", b.block)) AS block FROM named n JOIN blocks b ON n.doc_id = b.doc_id AND n.place BETWEEN b."from" AND b."to" WHERE n.before IN ('int', 'var') GROUP BY n.doc_id, n.place, n.value)"""

def _in(values) -> str:
    return "(" + ", ".join(map(_q, sorted(values))) + ")"


_COBOL = rf"""docs AS ({routines_sql}), numbered AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM docs)),
code AS (SELECT doc_id, line, text, upper(text[8:72]) AS up, text[7] AS mark, contains(text, ' DIVISION') AS division FROM numbered),
split AS (SELECT doc_id, line, unnest(range(0, len(ps))) AS place, unnest(ps) AS text FROM (SELECT doc_id, line, regexp_extract_all(text[8:72], {_q(LEXEMES)}) AS ps FROM code WHERE mark = ' ' AND NOT division)),
k AS (SELECT *, lag(upper(text)) OVER (PARTITION BY doc_id, line, trim(text) = '' ORDER BY place) AS before FROM split WHERE text <> ''),
declared AS (SELECT doc_id, value, arg_min(category, line) AS category FROM (
  SELECT doc_id, line, regexp_extract(up, '^PROGRAM-ID\. (\S+)\.', 1) AS value, 'PGM' AS category FROM code UNION ALL SELECT doc_id, line, regexp_extract(up, '^(?:01|    05)  ([A-Z0-9-]+)', 1), 'VAR' FROM code
  UNION ALL SELECT doc_id, line, regexp_extract(up, '^(MAIN-\d+)\.', 1), 'PARA' FROM code UNION ALL SELECT doc_id, line, regexp_extract(up, 'COPY (\S+)\.', 1), 'CPY' FROM code UNION ALL SELECT doc_id, line, regexp_extract(up, 'CALL "(\S+)"', 1), 'PGM' FROM code) WHERE value <> '' GROUP BY doc_id, value),
found AS (SELECT k.doc_id, line, place, CASE WHEN text[1] IN ('''', '"') THEN CASE WHEN before = 'CALL' THEN upper(text[2:-2]) ELSE text[2:-2] END WHEN regexp_matches(text, '(?i)^PIC(TURE)? ') OR NOT regexp_matches(text, '[A-Za-z]') THEN NULL
  WHEN upper(text) IN {_in(HYPHENATED)} OR d.value IS NULL AND upper(text) IN {_in(PLAIN)} THEN NULL ELSE upper(text) END AS value,
  CASE WHEN text[1] = '''' THEN 'STR' WHEN text[1] = '"' THEN 'PGM' ELSE coalesce(d.category, CASE WHEN regexp_matches(text, '[-0-9]') THEN 'VAR' END) END AS prefix, text FROM k LEFT JOIN declared d ON d.doc_id = k.doc_id AND d.value = upper(k.text)),
first AS (SELECT value, min((doc_id, line, place)) AS seen, arg_min(prefix, (doc_id, line, place)) AS prefix FROM found WHERE value IS NOT NULL AND prefix IS NOT NULL GROUP BY value),
names AS (SELECT value, prefix || '_' || (row_number() OVER (PARTITION BY prefix ORDER BY seen) - 1) AS alias FROM first),
put AS (SELECT f.doc_id, f.line, string_agg(CASE WHEN alias IS NULL THEN text WHEN text[1] IN ('''', '"') THEN text[1] || alias || text[1] ELSE alias END, '' ORDER BY place) AS code FROM found f LEFT JOIN names USING (value) GROUP BY f.doc_id, f.line)"""

_SYMBOLS = rf"""docs AS ({symbols_sql}), numbered AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM (SELECT doc_id, string_split(content, chr(10)) AS ls FROM docs)),
cards AS (SELECT doc_id, line, text, trim(regexp_replace(text, '^//\S* *(JOB|EXEC|DD|SET|PROC) *', '')) AS operands, regexp_matches(text, '^//\S* *(SET|PROC) ') AS sets FROM numbered WHERE text NOT LIKE '//*%'),
pairs AS (SELECT doc_id, line, unnest(string_split(operands, ',')) AS pair FROM cards WHERE sets), given AS (SELECT doc_id, line, split_part(pair, '=', 1) AS symbol, split_part(pair, '=', 2) AS value FROM pairs),
-- one symbol a value here, so each round looks one up at the place of the card that the last one came from
chase AS (WITH RECURSIVE c AS (SELECT doc_id, line, symbol, value, line AS seen FROM given UNION ALL
  SELECT c.doc_id, c.line, c.symbol, regexp_replace(c.value, '&' || g.symbol || '(\.|$)', replace(g.value, '\', '\\')), g.line FROM c JOIN given g ON g.doc_id = c.doc_id AND g.symbol = regexp_extract(c.value, '&([A-Z0-9@#$]+)', 1)
    AND g.line = (SELECT max(h.line) FROM given h WHERE h.doc_id = c.doc_id AND h.symbol = g.symbol AND h.line < c.seen)) SELECT doc_id, line, symbol, arg_min(value, seen) AS value FROM c GROUP BY doc_id, line, symbol),
parts AS (SELECT doc_id, line, unnest(range(0, len(ps))) AS k, unnest(ps) AS part FROM (SELECT doc_id, line, regexp_extract_all(operands, '&[A-Z0-9@#$]+\.?|[^&]+|&') AS ps FROM cards)),
found AS (SELECT p.*, (SELECT arg_max(c.value, c.line) FROM chase c WHERE c.doc_id = p.doc_id AND c.line < p.line AND p.part[1] = '&' AND c.symbol = rtrim(p.part[2:], '.')) AS value FROM parts p)"""

_NETWORK = rf"""docs AS ({network_sql}), ls AS (SELECT path, unnest(string_split(content, chr(10))) AS line FROM docs),
u AS (SELECT DISTINCT path AS source, 'runs' AS kind, regexp_extract(line, 'PGM=(\w+)', 1) AS value FROM ls UNION SELECT path, 'calls', regexp_extract(line, 'CALL ''(\w+)''', 1) FROM ls UNION SELECT path, 'copies', regexp_extract(line, '^.{{7}} *COPY (\w+)', 1) FROM ls),
homes AS (SELECT path AS target, regexp_extract(line, 'PROGRAM-ID\. (\w+)', 1) AS value, 'program' AS what FROM ls UNION SELECT path, regexp_extract(path, '(\w+)\.cpy$', 1), 'copybook' FROM docs),
edges AS (SELECT DISTINCT source, kind, u.value, target FROM u LEFT JOIN homes h ON h.value = u.value AND h.what = CASE kind WHEN 'copies' THEN 'copybook' ELSE 'program' END WHERE u.value <> '')"""

TOKEN_ORACLES = {
    "jcl_symbols": f"""WITH {_SYMBOLS} SELECT f.doc_id, f.line AS line_no, any_value(c.operands) AS operands, string_agg(coalesce(f.value, part), '' ORDER BY k) AS resolved FROM found f JOIN cards c ON c.doc_id = f.doc_id AND c.line = f.line GROUP BY f.doc_id, f.line""",
    "cross_file_edges": f"WITH {_NETWORK} SELECT source, kind, value, target FROM edges",
    "copybook_chains": f"""WITH RECURSIVE {_NETWORK}, e AS (SELECT DISTINCT source, target FROM edges WHERE kind = 'copies' AND source LIKE '%.cpy' AND target IS NOT NULL),
walk AS (SELECT source, target, 1::BIGINT AS steps FROM e UNION SELECT w.source, e.target, w.steps + 1 FROM walk w JOIN e ON e.source = w.target WHERE w.steps < 20)
SELECT source, target, min(steps) AS steps, source = target AS cycle FROM walk GROUP BY source, target""",
    "cobol_rewritten": f"""WITH {_COBOL} SELECT doc_id, string_agg(CASE WHEN mark = '*' THEN text[1:7] || ' [Comment removed]' ELSE coalesce(text[1:7] || put.code, text) END, chr(10) ORDER BY line) AS content FROM code LEFT JOIN put USING (doc_id, line) GROUP BY doc_id""",
    "sql_tokens": f"WITH {_SQL_TOKENS} SELECT doc_id, kind, count(*) AS n, sum(length(text))::BIGINT AS chars, max(depth) AS deepest, sum(start)::BIGINT AS starts, max((SELECT 1))::BIGINT * max(line) AS last_line FROM (SELECT *, (1 + coalesce(sum(length(text) - length(replace(text, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS line FROM d) GROUP BY doc_id, kind",
    "sql_problems": f"""WITH {_SQL_TOKENS},
w AS (SELECT doc_id, lower(text) AS word, lag(lower(text)) OVER s AS before, lead(lower(text)) OVER s AS after FROM d WHERE kind = 'word' WINDOW s AS (PARTITION BY doc_id ORDER BY place)),
b AS (SELECT doc_id, count(*) FILTER (word = 'begin' AND coalesce(after, '') NOT IN {NO_BLOCK} OR word = 'case' AND coalesce(before, '') <> 'end') - count(*) FILTER (word = 'end' AND coalesce(after, '') NOT IN {OTHER_ENDS}) AS n FROM w GROUP BY doc_id),
p AS (SELECT doc_id, min(depth) FILTER (kind = 'mark' AND text = ')') AS low, count(*) FILTER (kind = 'mark' AND text = '(') - count(*) FILTER (kind = 'mark' AND text = ')') AS net, arg_max(kind, place) AS kind, arg_max(text, place) AS text FROM d GROUP BY doc_id)
SELECT doc_id, 'unexpected )' AS problem FROM p WHERE low <= 0 UNION ALL SELECT doc_id, 'missing )' FROM p WHERE net > 0 AND NOT coalesce(low <= 0, false)
UNION ALL SELECT doc_id, 'comment does not end' FROM p WHERE kind = 'comment' AND text LIKE '/*%' AND text NOT LIKE '%*/'
UNION ALL SELECT doc_id, 'string does not end' FROM p WHERE kind = 'literal' AND text NOT LIKE '%''' UNION ALL SELECT doc_id, 'name does not end' FROM p WHERE kind = 'quoted' AND text LIKE '"%' AND text NOT LIKE '%"'
UNION ALL SELECT doc_id, 'BEGIN or CASE without END' FROM b WHERE n > 0""",
    "basic_problems": f"""WITH {_BASIC}
SELECT doc_id, 'unexpected ' || f.bad AS problem FROM folded WHERE f.bad IS NOT NULL UNION ALL SELECT doc_id, unnest(f.open) || ' does not end' FROM folded WHERE f.bad IS NULL
UNION ALL SELECT doc_id, 'missing )' FROM marks WHERE net > 0 UNION ALL SELECT doc_id, 'string does not end' FROM marks WHERE ragged""",
    "code_scopes": f"""WITH {_SCOPES}
SELECT n.doc_id, n.place, n.value, arg_max(b.block, (b."from", b.block)) AS block FROM named n JOIN homes h ON n.doc_id = h.doc_id AND n.value = h.value JOIN blocks b ON b.doc_id = h.doc_id AND b.block = h.block AND n.place BETWEEN b."from" AND b."to" GROUP BY n.doc_id, n.place, n.value""",
}
