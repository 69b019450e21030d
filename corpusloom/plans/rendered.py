"""A corpus rendered from the star schema: one document for each key, so that every family has texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of rendered documents and the label each is cleaned as.
KINDS = {
    "csv": "csv", "log": "log", "json": "json", "env": "env", "sql": "sql", "yaml": "yaml", "diff": "git-diff", "python": "trace/python", "javascript": "trace/javascript", "java": "trace/java",
    "go": "trace/go", "rusttrace": "trace/rust", "rust": "code/rust", "typescript": "code/typescript", "cargo": "build/cargo", "tsc": "build/typescript", "eslint": "build/eslint",
    "dockerfile": "dockerfile", "terraform": "terraform", "markdown": "markdown",
}


def _ordered(df: DataFrame, key: str, order: str, line: Column, before: str = "", after: str = "", glue: str = "\n") -> DataFrame:
    """One text for each key: its lines in order, between two texts."""
    rows = df.select(F.col(key).cast("long").alias("doc_key"), F.struct(F.col(order).cast("long").alias("o"), line.alias("line")).alias("x"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), glue)
    return rows.groupBy("doc_key").agg(F.concat(F.lit(before), body, F.lit(after)).alias("text"))


def _lines(n: Column, line, glue: str = "\n") -> Column:
    """line(i) for i from 1 to n."""
    return F.array_join(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), line), glue)


def _text(i: Column) -> Column:
    return i.cast("string")


def render(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    if kind == "csv":
        return _ordered(t("lineitem"), "l_orderkey", "l_linenumber", c(F.col("l_orderkey"), ",", F.col("l_linenumber"), ",", F.col("l_quantity").cast("long")), "orderkey,linenumber,quantity\n")
    if kind == "log":
        level = F.when(F.col("event_id") % 7 == 0, "ERROR").when(F.col("event_id") % 5 == 0, "WARN").otherwise("INFO")
        return _ordered(t("events"), "user_id", "event_id", c("2024-01-01T00:00:00Z ", level, " ", F.col("event_type"), " id=1", F.col("event_id") + 1000))
    if kind == "json":
        item = c('{"key": ', F.col("o_orderkey"), ', "status": "', F.col("o_orderstatus"), '", "priority": "', F.col("o_orderpriority"), '", "note": null}')
        return _ordered(t("orders"), "o_custkey", "o_orderkey", item, '{"orders": [', '], "page": {"info": {"next": 2}}, "empty": []}', ", ")
    customer, part, supplier = t("customer"), t("part"), t("supplier")
    k, p, s = F.col("c_custkey"), F.col("p_partkey"), F.col("s_suppkey")
    n = (s % 20).cast("int")
    if kind == "env":
        return customer.select(k.alias("doc_key"), c("# settings\nC_NAME=", F.col("c_name"), "\nexport API_KEY_", k, '="sk-', k, '"\n\n\nDB_PASSWORD=p', k, "\nSEGMENT='", F.col("c_mktsegment"), "'\nplain line\n").alias("text"))
    if kind == "yaml":
        return customer.select(
            k.alias("doc_key"),
            c("kind: Customer # kind\nmetadata:\n   name: ", F.col("c_name"), "\n   description: |\n     about\n     it\nspec:\n  # note\n  replicas: 1\n  segment: ", F.col("c_mktsegment"), "\n  script: |\n",
              _lines((k % 6).cast("int"), lambda i: c("    step ", _text(i))), "\nstatus:\n  ready: true\n").alias("text"),
        )
    if kind == "sql":
        return _ordered(t("nation"), "n_regionkey", "n_nationkey", c("(", F.col("n_nationkey"), ", '", F.col("n_name"), "')"), "-- nations\ninsert into nation values\n", ";\nselect n_name from nation where n_regionkey is not null order by n_name;\n", ",\n")
    if kind == "diff":
        context = lambda m, mark: _lines((p % m).cast("int"), lambda i: c(" ", mark, " line ", _text(i)))
        return part.select(p.alias("doc_key"), c("diff --git a/f b/f\nindex 1..2\n--- a/f\n+++ b/f\n@@ -1,9 +1,9 @@\n", context(9, "top"), "\n-", F.col("p_name"), "\n+", F.col("p_brand"), "\n", context(7, "end"), "\n@@ -20 +20 @@\n only context").alias("text"))
    if kind == "python":
        frames = _lines(n, lambda i: c('  File "/srv/app.py", line ', _text(i), ", in f", _text(i), "\n    call(", _text(i), ")"))
        return supplier.select(s.alias("doc_key"), c("Traceback (most recent call last):\n", frames, "\nKeyError: '", F.col("s_name"), "'").alias("text"))
    if kind == "javascript":
        frames = _lines(n, lambda i: c("    at fn", _text(i), " (/home/user/project/src/lib/file.js:", _text(i), ":1)"))
        return supplier.select(s.alias("doc_key"), c("Error: ", F.col("s_name"), "\n", frames).alias("text"))
    if kind == "java":
        frames = _lines(n, lambda i: c("\tat ", F.when(i % 4 == 0, "java.util.List").otherwise("com.shop.Cart"), ".get(Cart.java:", _text(i), ")"))
        return supplier.select(s.alias("doc_key"), c('Exception in thread "main" java.lang.Error: ', F.col("s_name"), "\n", frames, "\nCaused by: x\n", frames).alias("text"))
    if kind == "go":
        frames = _lines(n, lambda i: c("main.f", _text(i), "(0x1)\n\t/src/main.go:", _text(i), " +0x1d"))
        return supplier.select(s.alias("doc_key"), c("panic: ", F.col("s_name"), "\n\ngoroutine 1 [running]:\n", frames, "\n\nexit status 2").alias("text"))
    if kind == "rusttrace":
        frames = _lines(n, lambda i: c("   ", _text(i), ": ", F.when(i % 5 == 0, "std::rt::run").otherwise("shop::cart::get")))
        return supplier.select(s.alias("doc_key"), c("thread 'main' panicked at src/main.rs:1:1:\n", F.col("s_name"), "\nstack backtrace:\n", frames, "\n").alias("text"))
    if kind == "rust":
        uses = _lines((p % 6 + 1).cast("int"), lambda i: c("use shop::part", _text(i), ";"))
        return part.select(p.alias("doc_key"), c(uses, "\n/// About ", F.col("p_name"), "\n#[derive(Debug)]\npub struct P;   \n\n\n\npub fn f() -> i32 { let a = 1; a } // one\n#[cfg(test)]\nmod tests {\n  fn t() {}\n}\n").alias("text"))
    if kind == "typescript":
        gets = _lines((p % 5).cast("int"), lambda i: c("  get a", _text(i), "() { return ", _text(i), "; }"))
        return part.select(p.alias("doc_key"), c("import a from 'a';\n/** doc\n * more */\n// note\nexport class P {\n", gets, '\n  url = "http://x"; // keep\n  @dec\n  f() {}\n}\nconst g = () => 1;').alias("text"))
    if kind == "cargo":
        found = _lines(n, lambda i: c(F.when(i % 3 == 0, "warning: unused").otherwise("error[E0425]: missing"), " v", _text(i), "\n  --> src/m", _text(i % 3), ".rs:", _text(i), ":5\n   |\n", _text(i), " | x"))
        return supplier.select(s.alias("doc_key"), c("   Compiling a v1\n   Compiling b v1\n", found, "\nerror: could not compile `b`").alias("text"))
    if kind == "tsc":
        return supplier.select(s.alias("doc_key"), c(_lines(n, lambda i: c("src/a", _text(i % 2), ".ts(", _text(i), ",1): error TS230", _text(i % 3), ": bad ", _text(i))), "\nFound errors.").alias("text"))
    if kind == "eslint":
        found = _lines(n, lambda i: c("  ", _text(i), ":1  ", F.when(i % 4 == 0, "warning").otherwise("error"), "  message ", _text(i), "  rule-", _text(i % 2)))
        return supplier.select(s.alias("doc_key"), c("/src/a.js\n", found, "\n\n✖ ", n, " problems").alias("text"))
    if kind == "dockerfile":
        steps = _lines((s % 8 + 1).cast("int"), lambda i: c("  step", _text(i)), " && \\\n")
        return supplier.select(s.alias("doc_key"), c("# build\nFROM base AS b\n\n\nRUN ", steps, "\nFROM run\nCOPY a b\nEXPOSE 80 ", s, "\nCMD x").alias("text"))
    if kind == "terraform":
        return supplier.select(s.alias("doc_key"), c('variable "a" {\n description = "d"\n  default = {\n    x = ', s, '\n  }\n}\n# note\nresource "r" "', F.col("s_name"), '" { # inline\n   url = "http://x"\n}\n').alias("text"))
    if kind == "markdown":
        return part.select(p.alias("doc_key"), c("# ", F.col("p_name"), "\n[![b](i)](l)\n<!-- c\n -->\n\n\n\n## License\nMIT\n### Inner\nx\n## Use\n### ", F.col("p_brand"), "\n```\ncode\n```\n").alias("text"))
    raise ValueError(kind)


def corpus(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(kind, doc_key, text) of one kind or of all."""
    out = None
    for name in [kind] if kind else KINDS:
        one = render(spark, sf_dir, name).select(F.lit(name).alias("kind"), "doc_key", "text")
        out = one if out is None else out.unionByName(one)
    return out
