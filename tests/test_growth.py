"""What showed only on larger tables: repeated paths, tables that are small on disk and large in memory, shuffles of tokens."""

from pyspark.sql import functions as F

from maskwright.operators import audit, paths
from maskwright.operators.languages import relation, rewrite
from maskwright.operators.sanitize import ROW


def test_references_of_a_path_that_comes_twice_are_one_row(spark):
    mapping = spark.createDataFrame([("a/x.js", "o/nx.js"), ("a/x.js", "o/nx.js"), ("a/y.js", "o/ny.js"), ("a/y.js", "o/nz.js"), ("p.csproj", "q.csproj"), ("p.csproj", "q.csproj")], "path string, new_path string")
    refs = spark.createDataFrame([("a/x.js", "./y"), ("a/x.js", "./y"), ("a/x.js", "./x")], "path string, reference string")
    assert sorted(map(tuple, paths.resolved_imports(refs, mapping).collect())) == [("a/x.js", "./x", "./nx"), ("a/x.js", "./y", "./ny")]
    entries = spark.createDataFrame([("p.csproj", "a/x.js"), ("p.csproj", "a/x.js")], "path string, reference string")
    assert [tuple(r) for r in paths.resolved_entries(entries, mapping).collect()] == [("p.csproj", "a/x.js", "o/nx.js")]


def shuffles(df):
    """The exchanges of df's plan, from the last to the first, with the lines of the plan that stand under each."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    at = [k for k, x in enumerate(lines) if "Exchange " in x]
    return [lines[k + 1 :] for k in at]


def scripts(spark):
    texts = ["begin tran begin select (1", "case when 1 end", "end case x", "begin", "select 'a", "a) /* b", "begin\nend if", "end /* x */ case", "BEGIN x END conversation", "", None, "-- begin\n'end'", "begin begin x end"]
    return spark.createDataFrame(list(enumerate(texts)), f"{ROW} long, content string")


def test_texts_are_shuffled_and_tokens_are_not(spark):
    rows = relation.tokens(scripts(spark), "tsql")
    for df in (rows, rows.groupBy(ROW, "kind").agg(F.count("*"), F.max("depth"))):
        (below,) = shuffles(df)  # one, of the texts
        assert not any("posexplode" in x for x in below)
    assert {n for (n,) in rows.groupBy(ROW, F.spark_partition_id()).count().groupBy(ROW).agg(F.count("*")).select("count(1)").collect()} == {1}
    assert relation.dealt(scripts(spark), most=10).rdd.getNumPartitions() >= 14  # as many as texts call for


def test_sql_problems_shuffle_texts_alone(spark):
    got = relation.sql_problems(relation.tokens(scripts(spark), "tsql"))
    (below,) = shuffles(got)
    assert not any("posexplode" in x for x in below)
    open_ = "BEGIN or CASE without END"
    assert sorted(map(tuple, got.collect())) == sorted([(0, "missing )"), (0, open_), (3, open_), (4, "string does not end"), (5, "comment does not end"), (5, "unexpected )"), (6, open_), (8, open_), (12, open_)])


def test_rows_of_the_corpus_are_not_broadcast(spark):
    """Equal texts take next to nothing in a written table, so its size on disk would have Spark broadcast it."""
    text = "SELECT o.Total FROM sales.Orders o WHERE o.City = 'north west' -- pay run"
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("q"), "id", F.lit(".sql")).alias("path"), F.lit(text).alias("content"))
    out, names = rewrite.obfuscated(docs)
    leaks = audit.leak_search(docs, names)
    for df in (out, leaks):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sent = [x for x in plan.split("\n") if "BroadcastExchange" in x and "bigint" in x]
        assert "Join" in plan and not sent
    assert {(r.value, r["count"]) for r in leaks.groupBy("value").count().collect()} == {(v, 4000) for v in ("Total", "sales", "Orders", "City", "north west")}
    assert audit.leak_search(out.select("doc_id", "content"), names).count() == 0
