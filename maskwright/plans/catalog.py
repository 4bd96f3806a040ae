"""The library's queries over the test tables, each with the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.functions import text as X
from maskwright.operators import audit, paths, rules, sanitize, scope
from maskwright.operators.languages import cards, lines, links, relation, rewrite
from maskwright.operators.restore import restored, unmatched
from maskwright.plans import engine, sources
from maskwright.plans.oracle import ORACLES, SYNTH, files_sql, typed_files_sql, programs_sql, jobs_sql, snippets_sql, statements_sql
from maskwright.plans.token_oracle import TOKEN_ORACLES, classes_sql, macros_sql, network_sql, routines_sql, scripts_sql, symbols_sql
from maskwright.sources.shared import written

RULES = list(rules.BUILT_IN)


def _view(spark: SparkSession, sf: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf}/{n}.parquet").createOrReplaceTempView(n)


def _spread(docs: DataFrame) -> DataFrame:
    """docs over as many partitions as there are cores where they come from fewer files: the test tables are one file each."""
    n = docs.sparkSession.sparkContext.defaultParallelism
    return docs if len(docs.inputFiles()) >= n else docs.repartition(n)


def _made(sql, *tables, spread=True):
    def docs(spark: SparkSession, sf: str) -> DataFrame:
        _view(spark, sf, *tables)
        return _spread(spark.sql(sql)) if spread else spark.sql(sql)

    return docs


synth = _made(SYNTH, "orders")
files = _made(files_sql, "documents")
typed_files = _made(typed_files_sql, "documents")
programs = _made(programs_sql, "customer")
jobs = _made(jobs_sql, "supplier")
snippets = _made(snippets_sql, "part")
statements = _made(statements_sql, "supplier")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return _spread(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("content")))


def _run(spark, sf):
    found = sanitize.keyed(sanitize.detected(synth(spark, sf), RULES), "detected")
    names = written(sanitize.dictionary(found), "dictionary")
    return found, names


def rule_match_counts(spark, sf):
    found = sanitize.detected(synth(spark, sf), RULES)
    return found.select(F.explode("spans").alias("s")).groupBy("s.rule_id").agg(F.count("*").alias("n"), F.countDistinct("s.value").alias("distinct_values"))


def docs_with_email(spark, sf):
    email = next(r for r in RULES if r.rule_id == "email_addresses")
    return documents(spark, sf).where(F.col("content").rlike(email.pattern)).select("doc_id")


def match_spans(spark, sf):
    found = sanitize.detected(synth(spark, sf), RULES)
    s = found.select("doc_id", "content", F.explode("spans").alias("s"))
    return s.select("doc_id", "s.rule_id", F.col("s.start").cast("long").alias("start"), F.col("s.len").cast("long").alias("len"), "s.value", X.line_of(F.col("content"), F.col("s.start")).cast("long").alias("line"))


def exceptions_filtered(spark, sf):
    some = [rules.Rule(r.rule_id, r.pattern, r.prefix, exceptions=["ORDERSDB1", "ordersdb2"]) for r in RULES if r.rule_id == "server_names"]
    return sanitize.detected(synth(spark, sf), some).select(F.explode("spans").alias("s")).groupBy("s.value").agg(F.count("*").alias("n"))


def alias_dictionary(spark, sf):
    return _run(spark, sf)[1]


def alias_gaps(spark, sf):
    found, names = _run(spark, sf)
    used = audit.occurrences(sanitize.applied(found, names)).select("value").distinct()
    return names.join(used, "value", "left_anti").select("alias", "value")


def overlap_resolved(spark, sf):
    kept = audit.occurrences(sanitize.applied(*_run(spark, sf)))
    return kept.select("doc_id", F.col("start").cast("long").alias("start"), F.col("len").cast("long").alias("len"), "alias", "rule_id", F.col("line").cast("long").alias("line"))


def sanitized_text(spark, sf):
    return sanitize.applied(*_run(spark, sf)).select("doc_id", "content", "was_sanitized", F.size("matches").cast("long").alias("replacements"))


def sanitized_documents(spark, sf):
    found = sanitize.keyed(sanitize.detected(documents(spark, sf), RULES), "detected")
    names = written(sanitize.dictionary(found), "dictionary")
    return sanitize.applied(found, names).select("doc_id", F.md5("content").alias("content_md5"), F.size("matches").cast("long").alias("replacements"))


def restore_roundtrip(spark, sf):
    found, names = _run(spark, sf)
    return restored(sanitize.applied(found, names).select("doc_id", "content"), names).select("doc_id", "content", F.size("unmatched").cast("long").alias("n_unmatched"))


def unmatched_aliases(spark, sf):
    docs = synth(spark, sf).select("doc_id", F.concat(F.lit("use IP_"), (F.col("doc_id") % 7).cast("string"), F.lit(" and HOST_"), (F.col("doc_id") % 3).cast("string"), F.lit(" xIP_1y")).alias("content"))
    known = F.array(F.lit("IP_0"), F.lit("IP_1"), F.lit("HOST_2"))
    return docs.select("doc_id", F.array_join(unmatched(F.col("content"), known), ",").alias("unmatched"))


def rule_merge(spark, sf):
    R = rules.Rule
    one = rules.frame(spark, [R("Alpha", "a+", "A", ord=5), R("beta", "b+", "B", ord=7), R("gamma", "c+", "C", ord=7)], 1)
    two = rules.frame(spark, [R("ALPHA", "aa", "A", ord=9), R("delta", "d", "D", ord=1), R("beta", "bb", "B", enabled=False)], 2)
    got = rules.active(rules.merged(one.unionByName(two)))
    return got.select("rule_id", "pattern", F.col("ord").cast("long").alias("ord"))


def active_rules_sorted(spark, sf):
    got = rules.active(rules.frame(spark, rules.BUILT_IN))
    return got.select("rule_id", "prefix", "severity", F.col("ord").cast("long").alias("ord"))


def file_filter(spark, sf):
    p = F.col("path")
    return files(spark, sf).select("path", scope.extension(p).alias("ext"), (paths.should_process(p) & ~paths.should_ignore(p)).alias("kept"), (paths.should_process(p, True) & ~paths.should_ignore(p)).alias("kept_extensionless"))


def scope_dispatch(spark, sf):
    who = scope.processor_of(F.col("path"), F.col("content"))
    rows = typed_files(spark, sf).select("path", who.alias("processor"))
    ids = scope.parsed_scope("Database, cobol")
    return rows.groupBy("processor").agg(F.count("*").alias("n"), F.bool_or(scope.in_scope(F.col("processor"), ids)).alias("in_scope"))


def directory_aliases(spark, sf):
    return paths.directory_aliases(files(spark, sf))


def path_aliases(spark, sf):
    return paths.path_aliases(files(spark, sf))


def normalize_path(spark, sf):
    p = F.concat(F.col("path"), F.lit("/../x/./y/../"), F.col("path"))
    return files(spark, sf).select("path", paths.normalized(p).alias("normalized"), paths.relative(F.lit("src/app"), F.col("path")).alias("relative"))


def js_import_resolve(spark, sf):
    f = files(spark, sf)
    js = f.where(scope.extension(F.col("path")) == ".js")
    refs = js.select("path", F.explode(F.array(F.lit("./"), F.lit("../"))).alias("up")).select("path", F.concat("up", paths.stem(F.col("path"))).alias("reference"))
    mapping = f.select("path", F.concat(F.lit("out/"), paths.directory(F.col("path")), F.lit("/n"), paths.stem(F.col("path")), scope.extension(F.col("path"))).alias("new_path"))
    return paths.resolved_imports(refs, mapping)


def card_type(spark, sf):
    return snippets(spark, sf).select("doc_id", cards.card_type(F.col("content")).alias("card_type"))


def card_values(spark, sf):
    c = F.col("content")
    v = snippets(spark, sf).select(F.explode(cards.named_values(c, cards.card_type(c))).alias("v"))
    return v.groupBy("v.category", "v.value").agg(F.count("*").alias("n"))


def cobol_line_class(spark, sf):
    return lines.cobol_lines(programs(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line_type", "division")


def cobol_names(spark, sf):
    return lines.cobol_names(programs(spark, sf)).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("value").alias("distinct_values"))


def jcl_instream_program(spark, sf):
    return lines.jcl_lines(jobs(spark, sf)).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line_type", "program", "instream_sql")


def cross_refs(spark, sf):
    return lines.cross_references(jobs(spark, sf))


def host_refs(spark, sf):
    return lines.host_references(programs(spark, sf))


def looks_like_sql(spark, sf):
    return statements(spark, sf).select("doc_id", X.looks_like_sql(F.col("content")).alias("sql"))


def sql_comment_strip(spark, sf):
    c = F.regexp_replace(F.regexp_replace("content", r"--[^\n]*", "-- [Comment removed]"), r"(?s)/\*.*?\*/", "/* [Comment removed] */")
    return statements(spark, sf).select("doc_id", c.alias("content"))


def literal_alias(spark, sf):
    lit = statements(spark, sf).select("doc_id", F.explode(X.hits(F.col("content"), "N?'([^']|'')*'")).alias("h")).select("doc_id", "h.start", X.literal_inner(F.col("h.value")).alias("value"))
    first = lit.where(~X.is_numeric_or_date(F.col("value"))).groupBy("value").agg(F.min(F.struct("doc_id", "start")).alias("f")).select("value", F.lit("STR").alias("prefix"), "f.doc_id", "f.start")
    return sanitize.numbered(first, ["doc_id", "start"]).select("value", "alias")


def host_variables(spark, sf):
    v = F.regexp_extract_all("content", F.lit(r"[\s,(=]:([A-Za-z_][A-Za-z0-9_\-]*)"), F.lit(1))
    return programs(spark, sf).select(F.explode(v).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def source_map(spark, sf):
    got = audit.source_map(sanitize.applied(*_run(spark, sf)))
    first = F.col("first")
    return got.select("value", "alias", "rule_id", "n", first["doc_id"].alias("first_doc"), first["line"].cast("long").alias("first_line"))


def stats_summary(spark, sf):
    found, names = _run(spark, sf)
    return audit.stats(sanitize.applied(found, names), names)


def xref_report(spark, sf):
    found, names = _run(spark, sf)
    return audit.xref(names, sanitize.applied(found, names))


def status_top10(spark, sf):
    return audit.status(_run(spark, sf)[1])


def leakage_check(spark, sf):
    found, names = _run(spark, sf)
    gone = audit.leaks(sanitize.applied(found, names), synth(spark, sf), names)
    return gone.agg(F.count("*").alias("leaks"))


def severity_rollup(spark, sf):
    got = sanitize.applied(*_run(spark, sf))
    return audit.by_severity(got, rules.frame(spark, rules.BUILT_IN))


def file_counts(spark, sf):
    return audit.file_counts(sanitize.applied(*_run(spark, sf)))


def _language(name):
    def query(spark, sf):
        return rewrite.obfuscated(_made(sources.made_sql(name), "supplier")(spark, sf))[0].select("doc_id", "content")

    return query


def _every_language(spark, sf):
    _view(spark, sf, "supplier")
    parts = [f"SELECT doc_id * {len(sources.SOURCES)} + {k} AS doc_id, path, content FROM ({sources.made_sql(n)})" for k, n in enumerate(sources.SOURCES)]
    return _spread(spark.sql(" UNION ALL ".join(parts)))


def level2_roundtrip(spark, sf):
    """Sanitized at level 2 with renamed files, and restored: all comes back but comments, which cannot."""
    docs = _every_language(spark, sf)
    run = engine.run(docs, RULES)
    hidden = written(run.documents.select("doc_id", "path", "content"), "level-2")
    back = restored(engine.restored_paths(hidden, run.paths, run.references), run.names).select("doc_id", "path", "content")
    shown = hidden.select("doc_id", F.col("path").alias("hidden_path"), F.contains("content", F.lit("north west")).alias("literal_seen"))
    return back.join(shown, "doc_id").select("doc_id", "path", "content", (F.col("path") != F.col("hidden_path")).alias("renamed"), "literal_seen")


def level2_stats(spark, sf):
    docs = _made(sources.made_sql("csharp"), "supplier")(spark, sf)
    out, names = engine.sanitize(docs, RULES)
    return audit.stats(written(out, "level-2"), names)


def level2_leaks(spark, sf):
    """Values of the dictionary, literals of several words among them, that any rewritten file of any language still shows."""
    out, names = rewrite.obfuscated(_every_language(spark, sf))
    return audit.leak_search(written(out, "level-2"), names).agg(F.count("*").alias("leaks"))


def corpus_leaks(spark, sf):
    """One document in seven slips by unsanitized: every value that it shows is found, wherever that value was first seen."""
    found, names = _run(spark, sf)
    out = sanitize.applied(found, names)
    raw = synth(spark, sf).select("doc_id", F.col("content").alias("raw"))
    mixed = out.join(raw, "doc_id").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.col("raw")).otherwise(F.col("content")).alias("content"))
    return audit.leak_search(mixed, names)


def typed_paths(spark, sf):
    """File names by the main type that a file declares."""
    docs = _made(sources.made_sql("csharp"), "supplier")(spark, sf)
    _, _, types = rewrite.rewritten(docs)
    return paths.path_aliases(docs.select("path"), types)


def code_obfuscation(spark, sf):
    docs = statements(spark, sf).select("doc_id", F.lit("q.sql").alias("path"), "content")
    return rewrite.obfuscated(docs)[0].select("doc_id", "content", "processor", F.col("replacements").cast("long").alias("replacements"))


def mainframe_obfuscation(spark, sf):
    made = ((programs, "p.cbl", 0), (jobs, "j.jcl", 1), (snippets, "CARD", 2))
    docs = [f(spark, sf).select((F.col("doc_id") * 3 + k).alias("doc_id"), F.lit(path).alias("path"), "content") for f, path, k in made]
    out = rewrite.obfuscated(sanitize.union_all(docs), fixed_width=True)[0]
    return out.select("doc_id", "content", "processor", F.col("replacements").cast("long").alias("replacements"))


def _by_row(docs):
    """docs with the engine's row number, which is doc_id here, where ids are unique."""
    return docs.withColumn(sanitize.ROW, F.col("doc_id").cast("long"))


scripts = _made(scripts_sql, "orders", spread=False)  # the token relation deals them
macros = _made(macros_sql, "customer")
classes = _made(classes_sql, "part")
routines = _made(routines_sql, "customer")
symbol_jobs = _made(symbols_sql, "supplier")
network = _made(network_sql, "part")


def sql_tokens(spark, sf):
    """T-SQL sources as tokens: how many of each kind, how long, how deep and on how many lines."""
    rows = relation.tokens(_by_row(scripts(spark, sf)), "tsql")
    return rows.groupBy(F.col(sanitize.ROW).alias("doc_id"), "kind").agg(F.count("*").alias("n"), F.sum("len").alias("chars"), F.max("depth").cast("long").alias("deepest"), F.sum("start").alias("starts"), F.max("line").cast("long").alias("last_line"))


def sql_problems(spark, sf):
    """Sources of which many are broken, each in its own way."""
    return relation.sql_problems(relation.tokens(_by_row(scripts(spark, sf)), "tsql")).select(F.col(sanitize.ROW).alias("doc_id"), "problem")


def basic_problems(spark, sf):
    return relation.basic_problems(relation.tokens(_by_row(macros(spark, sf)), "vbscript")).select(F.col(sanitize.ROW).alias("doc_id"), "problem")


def cobol_rewritten(spark, sf):
    """COBOL programs at level 2: their own names, names from copybooks, literals and remarks; reserved words and pictures stay."""
    docs = routines(spark, sf).select("doc_id", F.lit("src/p.cbl").alias("path"), "content")
    return rewrite.obfuscated(docs)[0].select("doc_id", "content")


def jcl_symbols(spark, sf):
    """Operands with each symbol as it stands at its card; the cards that set it among them."""
    got = links.jcl_resolved(symbol_jobs(spark, sf))
    return got.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "operands", "resolved")


def cross_file_edges(spark, sf):
    return links.file_edges(network(spark, sf))


def copybook_chains(spark, sf):
    """What copybooks reach over others, and which come round to themselves."""
    copies = links.file_edges(network(spark, sf)).where("kind = 'copies' and source like '%.cpy'")
    return links.reached(copies).select("source", "target", F.col("steps").cast("long").alias("steps"), "cycle")


def code_scopes(spark, sf):
    """Uses of local names, with the block that binds each; those that no declaration is visible to have no row."""
    rows = written(relation.tokens(_by_row(classes(spark, sf)), "csharp"), "tokens")
    words = rows.where("kind = 'word'").withColumns({"before": F.lag("text").over(Window.partitionBy(sanitize.ROW).orderBy("place"))})
    named = words.where(F.col("text").rlike("^v[0-9]+$")).select(sanitize.ROW, "place", F.col("text").alias("value"), "before")
    bound = relation.bound_uses(named.where("before in ('int', 'var')"), named, relation.brace_blocks(rows))
    return bound.select(F.col(sanitize.ROW).alias("doc_id"), F.col("place").cast("long").alias("place"), "value", F.col("block").cast("long").alias("block"))


csharp_obfuscation, vb_obfuscation, fsharp_obfuscation, js_obfuscation, vbs_obfuscation, tsql_obfuscation, db2_obfuscation, oracle_obfuscation = map(_language, sources.SOURCES)


NAMES = (
    "rule_match_counts docs_with_email match_spans exceptions_filtered alias_dictionary alias_gaps overlap_resolved sanitized_text sanitized_documents restore_roundtrip unmatched_aliases rule_merge "
    "active_rules_sorted file_filter scope_dispatch directory_aliases path_aliases normalize_path js_import_resolve card_type card_values cobol_line_class cobol_names jcl_instream_program cross_refs host_refs "
    "looks_like_sql sql_comment_strip literal_alias host_variables source_map stats_summary xref_report status_top10 leakage_check severity_rollup file_counts code_obfuscation mainframe_obfuscation "
    "csharp_obfuscation vb_obfuscation fsharp_obfuscation js_obfuscation vbs_obfuscation tsql_obfuscation db2_obfuscation oracle_obfuscation level2_roundtrip level2_stats level2_leaks corpus_leaks typed_paths "
    "sql_tokens sql_problems basic_problems code_scopes cobol_rewritten jcl_symbols cross_file_edges copybook_chains"
).split()


def queries() -> dict:
    return {n: globals()[n] for n in NAMES}


def oracle_sql() -> dict[str, str]:
    known = ORACLES | TOKEN_ORACLES
    return {n: known[n] for n in NAMES if n in known}
