"""File names and the references between files: filters, aliases of paths, relative paths, imports, project entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskwright.operators.sanitize import ROW, keyed, numbered
from maskwright.operators.scope import extension
from maskwright.sources.shared import written

# Fixed values.
KNOWN = (
    ".cs", ".csx", ".fs", ".fsx", ".fsi", ".vb", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", ".vbs", ".bas", ".cls", ".frm",
    ".py", ".go", ".rs", ".java", ".kt", ".swift", ".rb", ".php", ".json", ".yaml", ".yml", ".xml", ".config", ".ini", ".toml", ".env",
    ".sh", ".bash", ".ps1", ".psm1", ".bat", ".cmd", ".html", ".htm", ".css", ".scss", ".less",
    ".sql", ".db2", ".pls", ".plb", ".pks", ".pkb", ".fnc", ".prc", ".trg", ".graphql", ".cbl", ".cob", ".cpy", ".jcl", ".md", ".txt", ".rst",
)
IGNORED_DIRECTORIES = (".maskwright", ".git", ".svn", ".hg", "node_modules", "vendor", "packages", ".nuget", "bin", "obj", "dist", "build", "target", "out", ".vs", ".vscode", ".idea")
IGNORED_EXTENSIONS = (".exe", ".dll", ".so", ".dylib", ".pdb", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".svg", ".zip", ".tar", ".gz", ".rar", ".7z", ".pfx", ".p12", ".cer", ".crt", ".key")
MOST_BYTES = 10 * 1024 * 1024
STRUCTURAL = ("src", "lib", "test", "tests", "public", "wwwroot", "assets", "config", "scripts", "docs", "resources", "properties")
PROJECT_FILES = (".csproj", ".fsproj", ".vbproj", ".sln", ".slnx")
BY_TYPE = (".cs", ".vb", ".fs", ".fsx", ".fsi", ".cbl", ".cob", ".cpy", ".jcl")
PRIMARY = ("Class", "Interface", "Record", "Enum", "Delegate", "Module", "Program", "Copybook", "Job")
JS_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")

#: what a script takes from another file: a quoted name after from, import or require, in either quote
IMPORTED = r"\b(?:from|import|require)\s*\(?\s*{q}([^{q}\n]*){q}"
#: an attribute that names a file, of any element, in either quote
NAMED_FILE = r"(?s)<[A-Za-z][\w.]*\s[^<>]*?\b(?:Include|Path)\s*=\s*{q}([^<{q}]*){q}"
QUOTES = ("'", '"')
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def unescaped(text: Column) -> Column:
    """XML's five entities undone."""
    for entity, c in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(c))
    return text


def escaped(text: Column) -> Column:
    for entity, c in reversed(ENTITIES):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def should_process(path: Column, extensionless: bool = False) -> Column:
    ext = extension(path)
    return ext.isin(*KNOWN) | (ext == "") if extensionless else ext.isin(*KNOWN)


def should_ignore(path: Column, size: Column | None = None) -> Column:
    """By a directory, an extension, or the size. The path must be relative to the corpus, so its own place does not count."""
    parts = F.slice(F.split(F.lower(slashes(path)), "/"), 1, F.greatest(F.size(F.split(slashes(path), "/")) - 1, F.lit(0)))
    bad = F.arrays_overlap(parts, F.array(*map(F.lit, IGNORED_DIRECTORIES))) | extension(path).isin(*IGNORED_EXTENSIONS)
    return bad if size is None else bad | (F.coalesce(size, F.lit(0)) > MOST_BYTES)


def directory(path: Column) -> Column:
    return F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(slashes(path), r"([^/]*)$", 1), r"\.[^.]*$", "")


def normalized(path: Column) -> Column:
    """. and empty parts dropped, .. folded into the part before it."""

    def step(a, p):
        up = (p == "..") & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("..")) != "..")
        return F.when(p.isin("", "."), a).when(up, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, p))

    return F.array_join(F.aggregate(F.split(slashes(path), "/"), F.array().cast("array<string>"), step), "/")


def relative(from_dir: Column, to_path: Column) -> Column:
    """to_path as seen from from_dir; parts are compared in any case."""
    a, b = (F.filter(F.split(x, "/"), lambda p: p != "") for x in (from_dir, to_path))
    same = F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda k: F.lower(F.array_join(F.slice(a, 1, k), "/")) == F.lower(F.array_join(F.slice(b, 1, k), "/")))
    common = F.array_max(same)
    ups = F.array_repeat(F.lit(".."), (F.size(a) - common).cast("int"))
    return F.array_join(F.concat(ups, F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))), "/")


def directory_aliases(paths: DataFrame) -> DataFrame:
    """(segment, alias DIR_n): directory names but structural ones, numbered in order, in any case."""
    parts = paths.select(F.explode(F.split(directory(F.col("path")), "/")).alias("part")).where("part <> ''").select(F.lower("part").alias("segment")).distinct()
    named = numbered(parts.where(~F.col("segment").isin(*STRUCTURAL)).withColumn("prefix", F.lit("DIR")), ["segment"])
    return named.select("segment", "alias")


def path_aliases(paths: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """(path, new_path): project files PROJ_n, code files by the alias of their main type, the rest FILE_n.

    types: (path, value, alias, category) of declared names; one named like the file comes first, then the first by alias.
    A path that is taken already (in any case) gets a FILE_n of its own.
    """
    p = paths.select(slashes(F.col("path")).alias("path")).distinct().withColumns({"ext": F.regexp_extract("path", r"(\.[^./]*)$", 1), "dir": directory(F.col("path")), "stem": stem(F.col("path"))})
    if types is not None:
        plain = lambda c: F.lower(F.regexp_replace(c, "-", ""))
        best = p.join(types.where(F.col("category").isin(*PRIMARY)).select(slashes(F.col("path")).alias("path"), "value", "alias"), "path")
        best = best.groupBy("path").agg(F.min_by("alias", F.struct((plain("value") != plain("stem")).alias("other"), "alias")).alias("type_alias"))
        p = p.join(best, "path", "left")
    else:
        p = p.withColumn("type_alias", F.lit(None).cast("string"))
    ext = F.lower("ext")
    usable = ext.isin(*BY_TYPE) | (ext == "")
    p = p.withColumn("kind", F.when(ext.isin(*PROJECT_FILES), "PROJ").when(usable & F.col("type_alias").isNotNull(), "TYPE").otherwise("FILE"))
    d = p.select("path", F.posexplode(F.split("dir", "/")).alias("at", "part")).join(directory_aliases(p), F.lower("part") == F.col("segment"), "left")
    dirs = d.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("alias", "part").alias("name")))).alias("parts")).select("path", F.array_join(F.col("parts.name"), "/").alias("new_dir"))
    p = p.join(dirs, "path")
    place = lambda name: F.concat(F.when(F.col("new_dir") == "", F.lit("")).otherwise(F.concat("new_dir", F.lit("/"))), name, F.col("ext"))
    by_type = p.where("kind = 'TYPE'").withColumn("new_path", place(F.col("type_alias")))
    by_type = by_type.withColumn("rn", F.row_number().over(Window.partitionBy(F.lower("new_path")).orderBy("path")))
    rest = p.where("kind <> 'TYPE'").select("path", "ext", "new_dir", F.col("kind").alias("prefix")).unionByName(by_type.where("rn > 1").select("path", "ext", "new_dir", F.lit("FILE").alias("prefix")))
    named = numbered(rest, ["path"])
    return by_type.where("rn = 1").select("path", "new_path").unionByName(named.select("path", place(F.col("alias")).alias("new_path")))


def imports(docs: DataFrame) -> DataFrame:
    """(path, reference): relative imports of scripts."""
    found = F.concat(*(F.regexp_extract_all("content", F.lit(IMPORTED.format(q=q)), F.lit(1)) for q in QUOTES))
    rows = docs.where(extension(F.col("path")).isin(*JS_EXTENSIONS)).select("path", F.explode(F.array_distinct(found)).alias("reference"))
    return rows.where(F.col("reference").startswith("./") | F.col("reference").startswith("../"))


def project_references(docs: DataFrame) -> DataFrame:
    """(path, reference): entries of project and solution files, as written: of a solution the third quoted value of each line that
    begins a project, of XML the attributes that name files, in either quote; what is commented out is no entry."""
    ext = extension(F.col("path"))
    quoted = lambda line: F.try_element_at(F.regexp_extract_all(line, F.lit('"([^"]*)"'), F.lit(1)), F.lit(3))
    solution = F.filter(F.transform(F.filter(F.split("content", "\n"), lambda x: x.startswith("Project(")), quoted), lambda x: x.isNotNull())
    live = F.regexp_replace("content", r"(?s)<!--.*?-->", "")
    found = F.when(ext == ".sln", solution).otherwise(F.concat(*(F.regexp_extract_all(live, F.lit(NAMED_FILE.format(q=q)), F.lit(1)) for q in QUOTES)))
    return docs.where(ext.isin(*PROJECT_FILES)).select("path", F.explode(F.array_distinct(found)).alias("reference"))


def once(mapping: DataFrame) -> DataFrame:
    """mapping (path, new_path) with each path once, under its least new path: a corpus may hold several rows of one path."""
    return mapping.groupBy("path").agg(F.min("new_path").alias("new_path"))


def resolved_imports(refs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, reference, new_reference): the exact file, else with a script extension, else a directory's index file; the
    first that exists, by equality joins on candidate paths. References that lead nowhere have no row; repeated ones and repeated paths
    of the mapping give one."""
    mapping = once(mapping)
    base = normalized(F.concat_ws("/", directory(F.col("path")), F.col("reference")))
    shapes = ["", *JS_EXTENSIONS, *(f"/index{e}" for e in JS_EXTENSIONS)]
    cand = refs.withColumn("__base", base).select("path", "reference", F.posexplode(F.array(*(F.concat("__base", F.lit(s)) for s in shapes))).alias("rank", "target"))
    hit = cand.join(mapping.select(F.col("path").alias("target"), F.col("new_path").alias("target_new")), "target")
    best = hit.groupBy("path", "reference").agg(F.min_by("target_new", "rank").alias("target_new"), F.min("rank").alias("rank"))
    best = best.join(mapping.select("path", F.col("new_path").alias("from_new")), "path")
    here = directory(F.col("from_new"))
    has_ext = F.regexp_extract("reference", r"[^/.](\.[^./]+)$", 1) != ""
    to_file = relative(here, F.col("target_new"))
    bare = F.when(has_ext, to_file).otherwise(F.regexp_replace(to_file, r"(?i)\.(js|ts|jsx|tsx|mjs|cjs)$", ""))
    file_ref = F.when(bare.startswith("../"), bare).otherwise(F.concat(F.lit("./"), bare))
    up = relative(here, directory(F.col("target_new")))
    return best.select("path", "reference", F.when(F.col("rank") > len(JS_EXTENSIONS), F.when(up == "", ".").otherwise(up)).otherwise(file_ref).alias("new_reference"))


def resolved_entries(refs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(path, reference, new_reference) of project entries, in their own slashes; in XML entities are undone to find the file."""
    refs, mapping = refs.distinct(), once(mapping)
    xml = extension(F.col("path")) != ".sln"
    named = F.when(xml, unescaped(F.col("reference"))).otherwise(F.col("reference"))
    r = refs.withColumn("target", normalized(F.concat_ws("/", directory(F.col("path")), slashes(named))))
    r = r.join(mapping.select(F.col("path").alias("target"), F.col("new_path").alias("target_new")), "target").join(mapping.select("path", F.col("new_path").alias("from_new")), "path")
    new = relative(directory(F.col("from_new")), F.col("target_new"))
    new = F.when(F.contains("reference", F.lit("\\")), F.translate(new, "/", "\\")).otherwise(new)
    return r.select("path", "reference", F.when(xml, escaped(new)).otherwise(new).alias("new_reference"))


def patched(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """docs (path, content) with quoted references replaced; `patched` tells which changed."""
    per = resolved.groupBy("path").agg(F.array_sort(F.collect_list(F.struct((-F.length("reference")).alias("n"), "reference", "new_reference"))).alias("__refs"))

    def step(text, r):
        for q in ("'", '"'):
            text = F.replace(text, F.concat(F.lit(q), r["reference"], F.lit(q)), F.concat(F.lit(q), r["new_reference"], F.lit(q)))
        return text

    out = docs.join(per, "path", "left").withColumn("__new", F.when(F.col("__refs").isNull(), F.col("content")).otherwise(F.aggregate("__refs", F.col("content"), step)))
    return out.withColumn("patched", ~F.col("__new").eqNullSafe(F.col("content"))).withColumn("content", F.col("__new")).drop("__new", "__refs")


LISTING = (r"Folder PATH listing", r"\+---", r"\\\\---")


def listed_paths(lists: DataFrame) -> DataFrame:
    """lists: (__list, n, line): lines of directory listings. (__list, n, head, name, listed): of each line what stands before its name, the
    name, and its whole path within the listing, in lower case: the names of the lines it hangs on, its own last.

    A line hangs on the last one before it that is less deep, and so do that one's parents. Depth is what the drawing takes up in fours,
    as tree commands draw it: a line of depth d ends what was open at d and below, so its parent is the last line of depth d - 1.
    """
    head = F.regexp_extract("line", r"^([\s|+\\\-]*)", 1)
    rows = lists.withColumns({"head": head, "name": F.regexp_extract("line", r"^[\s|+\\\-]*(.*?)\s*$", 1)}).withColumn("depth", F.ceil(F.length("head") / 4).cast("int"))
    w = Window.partitionBy("__list").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deepest = 32
    parts = [F.last(F.when((F.col("depth") == d) & (F.col("name") != ""), F.struct("n", F.lower("name").alias("name"))), ignorenulls=True).over(w) for d in range(deepest)]
    rows = rows.withColumn("open", F.array(*parts))
    # a name counts if no line of less depth came after it
    chain = F.filter(F.transform(F.sequence(F.lit(0), F.least("depth", F.lit(deepest - 1))), lambda d: F.get("open", d)), lambda p: p.isNotNull())
    live = F.filter(chain, lambda p, k: ~F.exists(F.slice(chain, 1, k), lambda q: q["n"] > p["n"]))
    return rows.select("__list", "n", "line", "head", "name", F.array_join(F.transform(live, lambda p: p["name"]), "/").alias("listed"))


def relisted(docs: DataFrame, mapping: DataFrame, back: bool = False) -> DataFrame:
    """docs (path, content) with the names in directory listings (.txt files of a tree command) replaced: each line's file or folder is
    looked up by its whole path, in any case, so names that two folders share keep apart. A listing may begin at the corpus's root, at
    any folder of it, or above it: lines meet every mapped path that ends like theirs as far as both go, the longest match first."""
    old, new = ("new_path", "path") if back else ("path", "new_path")
    m = mapping.select(F.split(F.lower(F.col(old)), "/").alias("a"), F.split(F.col(new), "/").alias("b")).where(F.size("a") == F.size("b"))
    # every file and folder, by its path and by the ends of that path
    every = m.select(F.explode(F.sequence(F.lit(1), F.size("a"))).alias("k"), "a", "b").select(F.slice("a", 1, F.col("k")).alias("a"), F.element_at("b", F.col("k")).alias("to"), "k")
    ends = every.select(F.explode(F.sequence(F.lit(1), F.col("k"))).alias("s"), "a", "to", "k").select(F.array_join(F.slice("a", F.col("s"), F.col("k")), "/").alias("__end"), (F.col("k") - F.col("s") + 1).alias("__parts"), "to")
    # an end that leads to several names is none
    ends = ends.groupBy("__end", "__parts").agg(F.min("to").alias("__new"), F.max("to").alias("__other")).where("__new = __other").drop("__other")
    is_list = (extension(F.col("path")) == ".txt") & F.col("content").rlike("|".join(LISTING))
    keyed_docs = keyed(docs, "listings")
    lists = keyed_docs.where(is_list).select(F.col(ROW).alias("__list"), F.posexplode(F.split("content", "\n")).alias("n", "line"))
    rows = written(listed_paths(lists), "listed")
    parts = F.split("listed", "/")
    asked = rows.where("name <> ''").select("__list", "n", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("s"), parts.alias("p")).select("__list", "n", (F.size("p") - F.col("s") + 1).alias("__parts"), F.array_join(F.slice("p", F.col("s"), F.size("p")), "/").alias("__end"))
    best = asked.join(ends, ["__end", "__parts"]).groupBy("__list", "n").agg(F.max_by("__new", "__parts").alias("__new"))
    put = rows.join(best, ["__list", "n"], "left").withColumn("line", F.when(F.col("__new").isNull() | (F.lower("name") == F.lower("__new")), F.col("line")).otherwise(F.concat("head", "__new")))
    whole = put.groupBy("__list").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("rows")).select(F.col("__list").alias(ROW), F.array_join(F.col("rows.line"), "\n").alias("__listed"))
    return keyed_docs.join(whole, ROW, "left").withColumn("content", F.coalesce("__listed", "content")).select(*docs.columns)


def renamed(docs: DataFrame, mapping: DataFrame, back: bool = False) -> DataFrame:
    """docs with `path` mapped, or mapped back (in any case); unknown paths stay."""
    m = mapping.select(F.lower(F.col("new_path" if back else "path")).alias("__key"), F.col("path" if back else "new_path").alias("__to"))
    return docs.join(m, F.lower("path") == F.col("__key"), "left").withColumn("path", F.coalesce("__to", "path")).drop("__key", "__to")
