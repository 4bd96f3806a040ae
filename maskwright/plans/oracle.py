"""Texts made by the same SQL in both engines, and the queries once more in DuckDB's SQL."""

from __future__ import annotations

from maskwright.functions.text import SQL_STARTS
from maskwright.operators.languages.cards import FTP_COMMANDS, NAMED, SIGNS
from maskwright.operators.paths import IGNORED_DIRECTORIES, IGNORED_EXTENSIONS, KNOWN, PROJECT_FILES, STRUCTURAL
from maskwright.operators.rules import BUILT_IN
from maskwright.operators.scope import EXTENSIONS
from maskwright.plans.sources import SOURCES, expected_sql, made_sql


def _s(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _lines(*parts: str) -> str:
    return " || chr(10) || ".join(parts)


SYNTH = f"""SELECT o_orderkey AS doc_id, 'conn Server=Seg' || {_s("o_custkey % 9")} || 'xDB;db=OrdersDB' || {_s("o_custkey % 50")} || ';ip 10.' || {_s("o_orderkey % 4")} || '.'
|| {_s("o_custkey % 7")} || '.' || {_s("o_orderkey % 200")} || chr(10) || ' mail u' || {_s("o_custkey % 500")} || '@corp.local host app' || {_s("o_custkey % 11")} || '.internal path C:' || chr(92) || 'data' || chr(92) || 'f'
|| {_s("o_orderkey % 13")} || chr(10) || ' table users_' || {_s("o_custkey % 5")} || ' from sales_prod, ACME.PROD' || {_s("o_custkey % 6")} || '.DATA 192.168.1.' || {_s("o_orderkey % 90")} AS content FROM orders"""
_EXT = "(CASE doc_id % 17 WHEN 0 THEN '.cs' WHEN 1 THEN '.js' WHEN 2 THEN '.sql' WHEN 3 THEN '.cbl' WHEN 4 THEN '.jcl' WHEN 5 THEN '.png' WHEN 6 THEN '' WHEN 7 THEN '.csproj' WHEN 8 THEN '.PRC' WHEN 9 THEN '.fs' WHEN 10 THEN '.vb' WHEN 11 THEN '.bas' WHEN 12 THEN '.pkb' WHEN 13 THEN '.db2' WHEN 14 THEN '.ts' WHEN 15 THEN '.weird' ELSE '.md' END)"
_DIR = "(CASE doc_id % 7 WHEN 0 THEN 'src/Billing' WHEN 1 THEN 'src/app' WHEN 2 THEN 'node_modules/x' WHEN 3 THEN 'docs' WHEN 4 THEN 'Ledger/obj' WHEN 5 THEN 'src/billing/deep' ELSE 'lib/Core' END)"
files_sql = f"SELECT doc_id, {_DIR} || '/f' || {_s('doc_id % 400')} || {_EXT} AS path FROM documents"
#: the same paths with contents that begin like a program, a job, a macro, or like none
_KINDS = [_lines("'000100 IDENTIFICATION DIVISION.'", "'000200 PROGRAM-ID. P.'"), _lines("'//JOB1 JOB'", "'//S1 EXEC PGM=A'"), "'Option Explicit' || chr(10) || 'Dim x'", "'10 PRINT x'", "'      77  AMT PIC 9.'"]
typed_files_sql = f"SELECT doc_id, {_DIR} || '/f' || {_s('doc_id % 400')} || {_EXT} AS path, CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(_KINDS)) + " END || chr(10) || coalesce(left(text, 40), '') AS content FROM documents"
programs_sql = "SELECT c_custkey AS doc_id, " + _lines(
    "'000100 IDENTIFICATION DIVISION.'", f"'000200 PROGRAM-ID. PGM' || {_s('c_custkey % 40')} || '.'", "'000300 DATA DIVISION.'", "'000400 WORKING-STORAGE SECTION.'", f"'000500 01  WS-REC-' || {_s('c_custkey % 30')} || '.'",
    "'000600     05  WS-AMT PIC 9(5).'", "'000700* a remark'", "''", "'000800 PROCEDURE DIVISION.'", f"'000900 MAIN-' || {_s('c_custkey % 25')} || '.'", "'001000     EXEC SQL'", "'001100* inner remark'",
    f"'001200       SELECT A INTO :HV-' || {_s('c_custkey % 12')} || ' FROM T'", "'001300     END-EXEC.'", f"'001400     CALL ''SUB' || {_s('c_custkey % 8')} || '''.'", "'001500-    CONT'", "'001600     COPY CPY1.'",
) + " AS content FROM customer"
jobs_sql = "SELECT s_suppkey AS doc_id, " + _lines(
    f"'//JOB' || {_s('s_suppkey % 9')} || ' JOB (ACCT),CLASS=A'", "'//* remark'", f"'//S1 EXEC PGM=LOAD' || {_s('s_suppkey % 5')} || ',REGION=0M'", "'//IN DD DSN=ACME.IN,'", "'//   DISP=SHR'", "'//SYSIN DD *'", "'SOME DATA'", "'/*'",
    "'//S2 EXEC PGM=DSNTEP2'", "'//SYSIN DD DATA'", "'SELECT 1 FROM T'", "'/*'", "'//'",
) + " AS content FROM supplier"
_CARD = [
    _lines("'DSN SYSTEM(DB2P)'", "'RUN PROGRAM(PG1) PLAN(PL1) LIB(''ACME.LOAD'')'", "'END'"), _lines("'HELO mail.acme.com'", "'MAIL FROM:<a@b.org>'"), "' MSG TYPE=OUTPUT,SOR=(MAP1)' || chr(10) || 'FLD1 MFLD X'", "' DEFINE CLUSTER (NAME(ACME.VSAM) VOLUMES(VOL001))'",
    "' SORT FIELDS=(1,5,CH,A)'", _lines("'ftp.acme.com'", "'user pw'", "'cd /data/in'", "'get FILE1'", "'quit'"), "'  DELETE ACME.OLD PURGE'", "'CONTROL  CNTL X'", "'free text for x@y.org'", "'REPRO INFILE(A) OUTFILE(B)'",
]
snippets_sql = "SELECT p_partkey AS doc_id, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(_CARD)) + " END AS content FROM part"
statements_sql = "SELECT s_suppkey AS doc_id, CASE s_suppkey % 5 " + " ".join(
    f"WHEN {i} THEN {c}" for i, c in enumerate([
        f"'SELECT a FROM sales.Orders -- note ' || {_s('s_suppkey')} || chr(10) || 'WHERE b = ''west' || {_s('s_suppkey % 6')} || ''' AND c = ''12.5'''", "'  update t set x = N''it''''s'' /* multi' || chr(10) || 'line */'",
        f"'plain words ' || {_s('s_suppkey')}", "'select 1'", f"'EXECUTE load_' || {_s('s_suppkey % 3')} || ' ''2024-01-02'', ''Acme' || {_s('s_suppkey % 4')} || ''''",
    ])
) + " END AS content FROM supplier"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


_PER_RULE = " UNION ALL ".join(
    f"SELECT doc_id, content, {i} AS ord, {_q(r.prefix)} AS prefix, {_q(r.rule_id)} AS rule_id, {_q(r.severity)} AS severity, regexp_extract_all(content, {_q(r.pattern)}) AS hits, string_split_regex(content, {_q(r.pattern)}) AS gaps FROM docs WHERE regexp_matches(content, {_q(r.pattern)})"
    for i, r in enumerate(BUILT_IN)
)
_SPANS = f"""docs AS ({SYNTH}), per AS ({_PER_RULE}),
spans AS (SELECT doc_id, content, ord, prefix, rule_id, severity, hits[k] AS value, length(hits[k]) AS len,
  coalesce(list_sum(list_transform(gaps[1:k], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0)::BIGINT AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM per)),
lined AS (SELECT *, (length(content[1:start]) - length(replace(content[1:start], chr(10), '')) + 1)::BIGINT AS line FROM spans)"""
_DICT = f"""{_SPANS},
firsts AS (SELECT value, min(struct_pack(doc_id := doc_id, ord := ord, start := start, prefix := prefix)) AS f FROM spans GROUP BY value),
dict AS (SELECT value, f.prefix AS prefix, row_number() OVER (PARTITION BY f.prefix ORDER BY f.doc_id, f.ord, f.start) - 1 AS n FROM firsts),
names AS (SELECT value, prefix, n, prefix || '_' || n AS alias FROM dict)"""
_KEPT = f"""{_DICT},
lists AS (SELECT doc_id, any_value(content) AS content, list(struct_pack(start := start, len := len, alias := alias, value := value, rule_id := rule_id, severity := severity, line := line) ORDER BY start, len DESC, ord) AS ms
  FROM lined JOIN names USING (value) GROUP BY doc_id),
kept AS (SELECT doc_id, content, list_reduce(ms, lambda a, m: CASE WHEN m.start >= a.pos THEN struct_pack(pos := m.start + m.len, picked := list_append(a.picked, m)) ELSE a END,
  struct_pack(pos := 0::BIGINT, picked := ms[1:0])).picked AS ks FROM lists),
flat AS (SELECT doc_id, k.* FROM (SELECT doc_id, unnest(ks) AS k FROM kept)),
done AS (SELECT d.doc_id, CASE WHEN ks IS NULL THEN d.content ELSE (SELECT r.txt || d.content[r.pos + 1:] FROM (SELECT list_reduce(ks, lambda a, m: struct_pack(txt := a.txt || d.content[a.pos + 1:m.start] || m.alias, pos := m.start + m.len), struct_pack(txt := '', pos := 0::BIGINT)) AS r)) END AS content, coalesce(len(ks), 0)::BIGINT AS replacements
  FROM docs d LEFT JOIN kept USING (doc_id))"""
_EMAIL = next(r.pattern for r in BUILT_IN if r.rule_id == "email_addresses")
_FILES = f"""files AS ({files_sql}), f AS (SELECT path, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) AS ext, regexp_extract(path, '(\\.[^./]*)$', 1) AS raw_ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') AS stem FROM files)"""
_BAD = f"(list_has_any(string_split(lower(dir), '/'), [{', '.join(map(_q, IGNORED_DIRECTORIES))}]) OR ext IN {_in(IGNORED_EXTENSIONS)})"
_SEGMENTS = f"""{_FILES}, segs AS (SELECT DISTINCT lower(unnest(string_split(dir, '/'))) AS segment FROM f),
das AS (SELECT segment, 'DIR_' || (row_number() OVER (ORDER BY segment) - 1) AS alias FROM segs WHERE segment <> '' AND segment NOT IN {_in(STRUCTURAL)})"""
_CASE = r"""CASE WHEN ext = '' AND (regexp_matches(content, '(?im)^.{6} .*\b(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE)\s+DIVISION\b') OR regexp_matches(content, '(?m)^.{6} +(01|05|10|77|88) +[A-Z0-9-]+.*\b(PIC|VALUE)\b')) THEN 'cobol'
WHEN ext = '' AND len(list_filter(string_split(content, chr(10))[1:5], lambda x: starts_with(x, '//'))) >= 2 THEN 'jcl' WHEN ext = '' THEN 'mainframe-utility'
WHEN ext = '.bas' AND NOT regexp_matches(content, '(?i)\b(?:(?:Sub|Function|Dim)\s+\w|Option\s+(?:Explicit|Base|Compare|Private)|(?:Public|Private)\s+(?:Sub|Function)\b)') THEN NULL """ + " ".join(f"WHEN ext IN {_in(e)} THEN {_q(p)}" for p, e in EXTENSIONS if e) + " END"
_FTP = f"""(len(list_filter(string_split(content, chr(10)), lambda x: x <> '')) >= 3 AND (len(list_filter(string_split(content, chr(10)), lambda x: string_split(lower(trim(x)), ' ')[1] IN {_in(FTP_COMMANDS)})) >= 2 OR regexp_matches(content, '(?im)^\\s*LOCSITE')))"""


def _signs(kind: str, groups) -> str:
    one = lambda x: f"starts_with(ltrim(upper(content)), {_q(x[1:])})" if x.startswith("^") else f"contains(upper(content), {_q(x)})"
    return _FTP if kind == "Ftp" else " AND ".join("(" + " OR ".join(map(one, g)) + ")" for g in groups)


_CARDS = f"docs AS ({snippets_sql}), typed AS (SELECT doc_id, content, CASE " + " ".join(f"WHEN {_signs(k, g)} THEN {_q(k)}" for k, g in SIGNS) + " ELSE 'Parameter' END AS card_type FROM docs)"
_COBOL = f"""docs AS ({programs_sql}), numbered AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS text FROM (SELECT doc_id, string_split(content, chr(10)) AS parts FROM docs)),
areas AS (SELECT *, rpad(text, 80, ' ')[7:7] AS ind, upper(trim(rpad(text, 80, ' ')[8:72])) AS body FROM numbered),
typed AS (SELECT *, CASE WHEN ind IN ('*', '/') THEN 'Comment' WHEN ind = '-' THEN 'Continuation' WHEN body = '' THEN 'Blank' WHEN regexp_matches(body, '^COPY(\\s|$)') THEN 'CopyStatement' WHEN regexp_matches(body, '^EXEC\\s+SQL\\b') THEN 'ExecSqlBlock'
  WHEN regexp_matches(body, ' DIVISION') THEN 'DivisionHeader' WHEN regexp_matches(body, ' SECTION\\.$') THEN 'SectionHeader' WHEN regexp_matches(body, '^(0?[1-9]|[1-4]\\d|66|77|88)\\b') THEN 'DataDefinition'
  WHEN trim(text[8:11]) <> '' THEN 'ParagraphHeader' ELSE 'ProcedureStatement' END AS own FROM areas),
blocks AS (SELECT *, last_value(CASE WHEN own IN ('Comment', 'Blank') THEN NULL WHEN contains(body, 'END-EXEC') THEN 'closed' WHEN own = 'ExecSqlBlock' THEN own END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state FROM typed),
lines AS (SELECT doc_id, line_no, CASE WHEN state = 'ExecSqlBlock' AND own NOT IN ('Comment', 'Blank') THEN state ELSE own END AS line_type, body FROM blocks)"""
_NAMED = " UNION ALL ".join(f"SELECT {_q(c)} AS category, unnest(regexp_extract_all(content, {_q(p)}, 1)) AS value FROM typed WHERE card_type IN {_in(kinds)}" for kinds, p, c in NAMED)
_DECLARED = """SELECT 'Program' AS category, regexp_extract(body, '^PROGRAM-ID\\. ([A-Z0-9-]+)', 1) AS value FROM lines WHERE starts_with(body, 'PROGRAM-ID') UNION ALL
SELECT 'Copybook', regexp_extract(body, '^COPY ([A-Z0-9-]+)', 1) FROM lines WHERE line_type = 'CopyStatement' UNION ALL
SELECT CASE WHEN starts_with(body, '88 ') THEN 'Condition' ELSE 'Variable' END, regexp_extract(body, '^\\d+ +([A-Z0-9-]+)', 1) FROM lines WHERE line_type = 'DataDefinition' UNION ALL
SELECT 'Paragraph', regexp_extract(body, '^([A-Z0-9-]+)', 1) FROM lines WHERE line_type = 'ParagraphHeader' AND starts_with(body, 'MAIN') UNION ALL
SELECT 'Program', regexp_extract(body, 'CALL .([A-Z0-9-]+)', 1) FROM lines WHERE contains(body, 'CALL ') UNION ALL
SELECT 'HostVariable', regexp_extract(body, ':([A-Z][A-Z0-9_-]*)', 1) FROM lines WHERE line_type = 'ExecSqlBlock'"""
_JCL = f"""docs AS ({jobs_sql}), numbered AS (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS line_no, unnest(parts) AS t FROM (SELECT doc_id, string_split(content, chr(10)) AS parts FROM docs)),
typed AS (SELECT *, CASE WHEN t LIKE '//*%' THEN 'Comment' WHEN t = '//' THEN 'Null' WHEN t = '/*' THEN 'Delimiter' WHEN regexp_matches(t, '^//\\S+ JOB ') THEN 'Job' WHEN regexp_matches(t, '^//\\S+ EXEC ') THEN 'Exec' WHEN regexp_matches(t, '^//\\S+ DD ') THEN 'Dd' WHEN t LIKE '// %' THEN 'Continuation' ELSE 'Instream' END AS line_type FROM numbered),
progs AS (SELECT *, last_value(CASE WHEN line_type = 'Exec' THEN regexp_extract(t, 'PGM=([A-Z0-9]+)', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS program FROM typed)"""

ORACLES = {
    "rule_match_counts": f"WITH {_SPANS} SELECT rule_id, count(*) AS n, count(DISTINCT value) AS distinct_values FROM spans GROUP BY rule_id",
    "docs_with_email": f"SELECT doc_id FROM documents WHERE regexp_matches(text, {_q(_EMAIL)})",
    "match_spans": f"WITH {_SPANS} SELECT doc_id, rule_id, start, len::BIGINT AS len, value, line FROM lined",
    "exceptions_filtered": f"WITH {_SPANS} SELECT value, count(*) AS n FROM spans WHERE rule_id = 'server_names' AND lower(value) NOT IN ('ordersdb1', 'ordersdb2') GROUP BY value",
    "alias_dictionary": f"WITH {_DICT} SELECT value, prefix, n, alias FROM names",
    "alias_gaps": f"WITH {_KEPT} SELECT alias, value FROM names WHERE value NOT IN (SELECT value FROM flat)",
    "overlap_resolved": f"WITH {_KEPT} SELECT doc_id, start, len::BIGINT AS len, alias, rule_id, line FROM flat",
    "sanitized_text": f"WITH {_KEPT} SELECT doc_id, content, replacements > 0 AS was_sanitized, replacements FROM done",
    "restore_roundtrip": f"WITH docs AS ({SYNTH}) SELECT doc_id, content, 0::BIGINT AS n_unmatched FROM docs",
    "unmatched_aliases": """SELECT o_orderkey AS doc_id, concat_ws(',', CASE WHEN o_orderkey % 7 > 1 THEN 'IP_' || (o_orderkey % 7) END, CASE WHEN o_orderkey % 3 <> 2 THEN 'HOST_' || (o_orderkey % 3) END) AS unmatched FROM orders""",
    "rule_merge": """WITH r(rule_id, pattern, ord, enabled, source_rank, seq) AS (VALUES ('Alpha', 'a+', 5, true, 1, 0), ('beta', 'b+', 7, true, 1, 1), ('gamma', 'c+', 7, true, 1, 2), ('ALPHA', 'aa', 9, true, 2, 0), ('delta', 'd', 1, true, 2, 1), ('beta', 'bb', 100, false, 2, 2))
SELECT rule_id, pattern, ord::BIGINT AS ord FROM (SELECT *, row_number() OVER (PARTITION BY lower(rule_id) ORDER BY source_rank DESC, seq DESC) AS rn FROM r) WHERE rn = 1 AND enabled""",
    "active_rules_sorted": "SELECT * FROM (VALUES " + ", ".join(f"({_q(r.rule_id)}, {_q(r.prefix)}, {_q(r.severity)}, {r.ord}::BIGINT)" for r in BUILT_IN) + ") t(rule_id, prefix, severity, ord)",
    "file_filter": f"WITH {_FILES} SELECT path, ext, ext IN {_in(KNOWN)} AND NOT {_BAD} AS kept, (ext IN {_in(KNOWN)} OR ext = '') AND NOT {_BAD} AS kept_extensionless FROM f",
    "scope_dispatch": f"WITH {_FILES.replace(files_sql, typed_files_sql).replace('SELECT path, lower', 'SELECT path, content, lower')}, w AS (SELECT {_CASE} AS processor FROM f) SELECT processor, count(*) AS n, coalesce(processor IN ('tsql', 'db2sql', 'oraclesql', 'cobol'), false) AS in_scope FROM w GROUP BY processor",
    "directory_aliases": f"WITH {_SEGMENTS} SELECT segment, alias FROM das",
    "path_aliases": f"""WITH {_SEGMENTS}, u AS (SELECT DISTINCT path, ext, raw_ext, dir FROM f), k AS (SELECT *, CASE WHEN ext IN {_in(PROJECT_FILES)} THEN 'PROJ' ELSE 'FILE' END AS prefix FROM u),
parts AS (SELECT path, unnest(range(1, len(ps) + 1)) AS place, unnest(ps) AS part FROM (SELECT path, string_split(dir, '/') AS ps FROM u)),
dirs AS (SELECT path, string_agg(coalesce(alias, part), '/' ORDER BY place) AS new_dir FROM parts LEFT JOIN das ON lower(part) = segment GROUP BY path)
SELECT path, CASE WHEN new_dir = '' THEN '' ELSE new_dir || '/' END || prefix || '_' || (row_number() OVER (PARTITION BY prefix ORDER BY path) - 1) || raw_ext AS new_path FROM k JOIN dirs USING (path)""",
    "normalize_path": f"""WITH {_FILES} SELECT path, regexp_replace(path, '/[^/]*$', '') || '/x/' || path AS normalized,
CASE WHEN lower(path) LIKE 'src/app/%' THEN path[9:] WHEN lower(path) LIKE 'src/%' THEN '../' || path[5:] ELSE '../../' || path END AS relative FROM f""",
    "card_type": f"WITH {_CARDS} SELECT doc_id, card_type FROM typed",
    "cobol_line_class": f"""WITH {_COBOL} SELECT doc_id, line_no, line_type, last_value(CASE WHEN line_type = 'DivisionHeader' THEN regexp_extract(body, '(IDENTIFICATION|ENVIRONMENT|DATA|PROCEDURE) DIVISION', 1) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS division FROM lines""",
    "card_values": f"WITH {_CARDS}, found AS ({_NAMED}) SELECT category, value, count(*) AS n FROM found GROUP BY category, value",
    "cobol_names": f"WITH {_COBOL}, found AS ({_DECLARED}) SELECT category, count(*) AS n, count(DISTINCT value) AS distinct_values FROM found WHERE value <> '' GROUP BY category",
    "jcl_instream_program": f"WITH {_JCL} SELECT doc_id, line_no, line_type, program, line_type = 'Instream' AND program = 'DSNTEP2' AS instream_sql FROM progs",
    "cross_refs": f"WITH {_JCL} SELECT program AS value, 'jcl' AS source_language, 'cobol' AS target_language, count(*) AS n FROM progs WHERE line_type = 'Exec' GROUP BY program",
    "host_refs": f"WITH {_COBOL}, used AS (SELECT unnest(regexp_extract_all(body, ':([A-Z][A-Z0-9_-]*)', 1)) AS value FROM lines WHERE line_type = 'ExecSqlBlock') SELECT value, 'cobol' AS source_language, 'sql' AS target_language, count(*) AS n FROM used GROUP BY value",
    "looks_like_sql": f"WITH docs AS ({statements_sql}) SELECT doc_id, length(content) >= 10 AND regexp_matches(upper(ltrim(content)), '^({'|'.join(SQL_STARTS)}) ') AS sql FROM docs",
    "sql_comment_strip": f"""WITH docs AS ({statements_sql}) SELECT doc_id, regexp_replace(regexp_replace(content, '--[^\\n]*', '-- [Comment removed]', 'g'), '(?s)/\\*.*?\\*/', '/* [Comment removed] */', 'g') AS content FROM docs""",
    "literal_alias": f"""WITH docs AS ({statements_sql}), per AS (SELECT doc_id, regexp_extract_all(content, 'N?''([^'']|'''')*''') AS hits FROM docs), lits AS (SELECT doc_id, unnest(range(1, len(hits) + 1)) AS k, unnest(hits) AS h FROM per),
vals AS (SELECT doc_id, k, replace(regexp_extract(h, '^N?''(.*)''$', 1), '''''', '''') AS value FROM lits), first AS (SELECT value, min(struct_pack(doc_id := doc_id, k := k)) AS f FROM vals WHERE NOT regexp_matches(value, '^[0-9.]+$|^\\d{{4}}-\\d{{2}}-\\d{{2}}') GROUP BY value)
SELECT value, 'STR_' || (row_number() OVER (ORDER BY f.doc_id, f.k) - 1) AS alias FROM first""",
    "host_variables": f"WITH docs AS ({programs_sql}) SELECT value, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '[\\s,(=]:([A-Za-z_][A-Za-z0-9_\\-]*)', 1)) AS value FROM docs) GROUP BY value",
    "source_map": f"""WITH {_KEPT} SELECT value, any_value(alias) AS alias, arg_min(rule_id, struct_pack(a := doc_id, b := start)) AS rule_id, count(*) AS n, min(doc_id) AS first_doc, arg_min(line, struct_pack(a := doc_id, b := start)) AS first_line FROM flat GROUP BY value""",
    "stats_summary": f"""WITH {_KEPT} SELECT count(*) AS total_files, count(*) FILTER (replacements > 0) AS processed_files, count(*) FILTER (replacements = 0) AS skipped_files, sum(replacements)::BIGINT AS total_replacements, (SELECT count(*) FROM names) AS unique_values FROM done""",
    "xref_report": f"WITH {_KEPT} SELECT alias, value, (SELECT count(*) FROM flat WHERE flat.value = names.value) AS occurrences FROM names",
    "status_top10": f"WITH {_DICT} SELECT alias, value FROM names ORDER BY alias LIMIT 10",
    "leakage_check": "SELECT 0::BIGINT AS leaks",
    "severity_rollup": f"WITH {_KEPT} SELECT severity, rule_id, count(*) AS n FROM flat GROUP BY ROLLUP (severity, rule_id)",
    "file_counts": f"WITH {_KEPT} SELECT doc_id, replacements FROM done",
}

ORACLES |= {f"{name}_obfuscation": expected_sql(name) for name in SOURCES}
_WORDS = "'[\\p{L}\\p{N}_]'"
_EVERY = " UNION ALL ".join(f"SELECT doc_id * {len(SOURCES)} + {k} AS doc_id, path, content FROM ({made_sql(n)})" for k, n in enumerate(SOURCES))
ORACLES |= {
    "level2_roundtrip": f"SELECT doc_id, path, content, true AS renamed, false AS literal_seen FROM (SELECT doc_id, path, replace(content, 'pay run', '[Comment removed]') AS content FROM ({_EVERY}))",
    # by hand: 9 replacements in the first file, the comment among them, 9 in the second; Acme, Pay, three classes and Job, total, two methods, city, run, note and two literals
    "level2_stats": "SELECT 2 * count(*) AS total_files, 2 * count(*) AS processed_files, 0::BIGINT AS skipped_files, 18 * count(*) AS total_replacements, 14::BIGINT AS unique_values FROM supplier",
    "level2_leaks": "SELECT 0::BIGINT AS leaks",
    # every value against every document that slipped by
    "corpus_leaks": f"""WITH {_DICT}, raw AS MATERIALIZED (SELECT doc_id, ' ' || content || ' ' AS c FROM docs WHERE doc_id % 7 = 0), vals AS MATERIALIZED (SELECT DISTINCT value FROM names WHERE length(value) >= 3),
pairs AS MATERIALIZED (SELECT doc_id, value, string_split(c, value) AS ps FROM raw JOIN vals ON contains(c, value)), sides AS MATERIALIZED (SELECT doc_id, value, unnest(range(1, len(ps))) AS k, ps FROM pairs)
SELECT DISTINCT doc_id, value FROM sides WHERE NOT (regexp_matches(value[1], {_WORDS}) AND regexp_matches(ps[k][-1], {_WORDS})) AND NOT (regexp_matches(value[-1], {_WORDS}) AND regexp_matches(ps[k + 1][1], {_WORDS}))""",
    # one file takes the name of each class, the others that declare it again get names of their own
    "typed_paths": """WITH f AS (SELECT s_suppkey * 2 + k AS doc_id, k, s_suppkey % 3 AS m, 'src/f' || (s_suppkey * 2 + k) || '.cs' AS path FROM supplier, (VALUES (0), (1)) t(k)),
named AS (SELECT path, 'src/CLS_' || CASE WHEN k = 1 THEN 1 WHEN m = 0 THEN 0 WHEN m = 1 THEN 2 ELSE 3 END AS stem FROM f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY path) AS rn FROM named)
SELECT path, CASE WHEN rn = 1 THEN stem || '.cs' ELSE 'src/FILE_' || (row_number() OVER (PARTITION BY rn > 1 ORDER BY path) - 1) || '.cs' END AS new_path FROM ranked""",
    # all built-in rules over the real texts
    "sanitized_documents": f"WITH {_KEPT.replace(SYNTH, 'SELECT doc_id, text AS content FROM documents')} SELECT doc_id, md5(content) AS content_md5, replacements FROM done",
    # a script's own name, without its extension, leads to itself or to a file without one beside it; nothing lies a folder up
    "js_import_resolve": f"WITH {_FILES} SELECT DISTINCT path, './' || stem AS reference, './n' || stem AS new_reference FROM f WHERE ext = '.js'",
}
