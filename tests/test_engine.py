"""Column forms of the engine on hand-made texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import annotate, prompt, tokens
from corpusloom.functions.detect import detect
from corpusloom.functions.register import register
from corpusloom.functions.text import lines, sample
from corpusloom.operators import clean, discover, ledger
from corpusloom.plans.options import Options, load
from corpusloom.plans.process import preview, process, restore
from corpusloom.sources import documents

LABELS = {
    "diff --git a b\n": "git-diff", "goroutine 1 [running]:": "trace/go", "\tat com.a.B.c(B.java:1)": "trace/java", "Traceback (most recent call last):": "trace/python",
    "thread 'main' panicked at x": "trace/rust", "    at f (a)\n    at async g.h (b)": "trace/javascript", "    at f (a)": "text", "  0: a\n  1: b": "trace/rust",
    "   Compiling a v1\nerror[E0425]: x": "build/cargo", "a.ts(1,2): error TS1: x": "build/typescript", "  1:1  error  x\n  2:1  error  x\n  3:1  warning  x": "build/eslint",
    '{"a": "2024-01-01T00:00 2024-01-01T00:00 2024-01-01T00:00"}': "log", ' {"a": 1}': "json", '["a"]': "json", "---\nx": "yaml", "a: 1\nb: 2\nc: 3\nd: 4": "yaml",
    "# a\n# b\n```\nx": "markdown", "<!doctype html>": "html", "<div>\n<p>\n</p>": "html", "select 1 where 2": "sql", "select a\nwhere\nb": "text", "SELECT a WHERE b": "sql",
    "FROM a\nRUN b\nCMD c": "dockerfile", 'resource "a"\nvariable "b"': "terraform", "AB=1\nCD=2\nx": "env", "a,b,c\n1,2,3\n4,5,6": "csv", "a,b,c\n1,2,3": "text",
    "fn a() { let b }": "code/rust", "```sh\nx": "code/sh", "def a():\nimport b": "code/python", "\x1b[31mred": "log", "hello": "text", "": "text",
}


def test_detect(spark):
    df = spark.createDataFrame(list(LABELS.items()), "t string, want string").select("t", "want", detect(F.col("t")).alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != r.want] == []
    assert spark.range(1).select(detect(F.lit("x"), "PY"), detect(F.lit("x"), "??"), detect(F.lit("x"), force_diff=True)).first()[:] == ("code/python", "text", "git-diff")


def test_text_helpers(spark):
    rows = spark.createDataFrame([("a\r\nb\n",), ("",), ("\n",), ("x" + "é" * 5000,)], "t string").select(lines(F.col("t")).alias("l"), sample(F.col("t")).alias("s")).collect()
    assert [r.l for r in rows[:3]] == [["a", "b"], [], [""]]
    assert rows[3].s == ("x" + "é" * 5000).encode()[:8192].decode("utf-8", "ignore")


def test_native_cleaners(spark):
    csv = "id,name,amt\n" + "".join(f"{i}, n{i},{'é' * 30}\n" for i in range(7))
    env = "# c\nexport API_KEY=\"sk-1\"\n\n\nAPP='demo'\nMONKEY=1\nx y\nL=" + "z" * 120
    html = "<!DOCTYPE html>\n<head><title>x</title></head>\n<div class=\"a\"><p id=\"x\">A &amp;lt; B</p></div>\n\n\n<span>\n<b onclick=\"1\">t</b>"
    c = spark.createDataFrame([(csv, env, html, "a\x1b[31mb\tc")], "csv string, env string, html string, ansi string").select(
        clean.clean_csv(F.col("csv")), clean.clean_csv(F.col("csv"), True), clean.clean_env(F.col("env")), clean.clean_env(F.col("env"), True), clean.clean_html(F.col("html")), clean.clean_html(F.col("html"), True), clean.strip_ansi(F.col("ansi")),
    ).first()
    assert c[0].endswith("... [2 more rows]") and c[0].count("\n") == 6
    assert c[1].split("\n")[1] == f"0,n0,{'é' * 23}..." and c[1].endswith("... [4 more rows]")
    assert c[2].split("\n")[:5] == ["API_KEY=***", "", "APP=demo", "MONKEY=***", "x y"]
    assert c[3].split("\n")[-1] == "L=" + "z" * 50 + "...[120 chars]"
    assert c[4] == "<!DOCTYPE html>\n\n<p>A &amp;lt; B</p>\n\n<b>t</b>".replace("html>\n\n<p>", "html>\n\n<p>")
    assert c[5].endswith("A < B\n\nt") and c[6] == "ab\tc"


def test_process(spark):
    docs = spark.createDataFrame([(0, "2024-01-01T00:00:00Z INFO ping 1\n" * 5), (1, " \n\t"), (2, None), (3, "select a from t where b = 1"), (4, "")], "doc_id long, text string")
    rows = {r.id: r for r in process(docs, options=Options(prompt="fix", stats=True, force_type="sql")).collect()}
    assert rows[3].cleaned == "SELECT a FROM t WHERE b = 1" and rows[3].original_tokens == 10
    assert rows[3].output.startswith("# stats [sql]: 10 -> 10 tokens (no change)\nYou are a senior database engineer.\n\n[sql | 1 lines | 1 select]\nSELECT")
    assert rows[1].output == " \n\t" and rows[1].label is None and rows[2].output is None and rows[4].output == ""
    found = process(docs)
    assert {r.label for r in found.collect()} == {"log", "sql", None}
    assert ledger.entries(found, datetime(2024, 1, 1)).count() == 2
    assert restore(found).where("id = 0").first().text.startswith("2024") and preview(docs).columns[-1] == "savings_label"
    assert process(docs.limit(0)).count() == 0


def test_savings(spark):
    pairs = [(100, 50, "-50%"), (100, 107, "+7%"), (1000, 999, "-<1%"), (1000, 1001, "+<1%"), (5, 5, "no change"), (0, 3, "+<1%")]
    df = spark.createDataFrame(pairs, "o long, c long, want string").select("want", tokens.savings_label(F.col("o"), F.col("c")).alias("got"), ledger.savings_pct(F.col("o"), F.col("c")).alias("pct"))
    rows = df.collect()
    assert all(r.got == r.want for r in rows) and rows[-1].pct == 0.0
    names = spark.createDataFrame([('Code("rust")',), ("LogFile",), ("GitDiff",)], "n string").select(tokens.friendly_name(F.col("n")), tokens.short_number(F.lit(1500)))
    assert [r[0] for r in names.collect()] == ["code/rust", "log", "git-diff"] and names.first()[1] == "1.5K"


def test_annotations(spark):
    cases = {
        ("code/rust", "pub fn a() {}\nfn b() {}\nstruct S;\n#[test]"): "[code/rust | 4 lines | 1 exported | 2 functions | 1 types/classes | contains tests]",
        ("code/go", "func Main() {}\nfunc x() {}"): "[code/go | 2 lines | 1 exported | 2 functions]",
        ("yaml", "services:\n  web:\n    image: x"): "[yaml | 3 lines | Docker Compose | 1 service(s)]",
        ("yaml", "on: push\njobs:\n  build:\n    x: 1"): "[yaml | 4 lines | GitHub Actions workflow | 1 job(s)]",
        ("yaml", "openapi: 3\npaths:\n  /a:\n"): "[yaml | 3 lines | OpenAPI spec | 1 endpoint(s)]",
        ("git-diff", "diff --git a b\n--- a\n+++ b\n+x\n-y\nrename from a"): "[git-diff | 6 lines | 1 file(s) | +1/-1 | includes renames]",
        ("log", "ERROR a\nwarn b"): "[log | 2 lines | 1 error(s) | 1 warning(s)]", ("log", "a"): "[log | 1 lines | 1 lines]",
        ("json", "[\n  {\n  },\n  {\n  },\n              1"): "[json | 6 lines | array of ~2 objects | 7+ nesting depth]",
        ("dockerfile", "FROM a\nFROM b\nEXPOSE 80 443\nRUN x"): "[dockerfile | 4 lines | 2 stages | exposes 80, 443 | 1 RUN commands]",
        ("terraform", 'resource "a" "b"\ndata "x" "y"'): "[terraform | 2 lines | 1 resources | 1 data sources]",
        ("trace/python", "  File \"a\"\n" + "é" * 50): "[trace/python | 2 lines | 1 frames | " + "é" * 38 + "...]",
        ("markdown", "# a\n```\nx\n```"): "[markdown | 4 lines | ~5 words | 1 sections | 1 code blocks]",
        ("build/cargo", "error a\nwarning b"): "[build/cargo | 2 lines | 1 error(s) | 1 warning(s)]",
    }
    df = spark.createDataFrame([(k, t, w) for (k, t), w in cases.items()], "k string, t string, w string").select("w", annotate.header(F.col("t"), F.col("k")).alias("got"))
    assert [(r.got, r.w) for r in df.collect() if r.got != r.w] == []


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "runs")
    ledger.create(spark, path)
    rows = [(1, datetime(2024, 1, 1, 10), "log", 100, 20, 80.0), (2, datetime(2024, 1, 2, 0), "log", 0, 5, 0.0), (3, datetime(2024, 1, 2, 9), "json", 50, 60, -20.0)]
    ledger.append(spark.createDataFrame(rows, ledger.SCHEMA), path)
    runs, now = ledger.scan(spark, path), datetime(2024, 1, 2, 12)
    assert ledger.totals(runs).first()[:] == (3, 150, 85, 20.0)
    assert ledger.totals(ledger.today(runs, now)).first().runs == 2 and ledger.since_days(runs, now, 1).count() == 1 + 1
    assert ledger.totals(runs.limit(0)).first()[:] == (0, 0, 0, 0.0)
    assert [r.content_type for r in ledger.by_type(runs).collect()] == ["log", "json"]
    total = [r for r in ledger.daily_with_total(runs).collect() if r.is_total]
    assert total[0].savings_pct == pytest.approx(65 / 150 * 100)
    assert [r.run_id for r in ledger.history(runs, 2).collect()] == [3, 2] and ledger.scan(spark, path, datetime(2024, 1, 2)).count() == 2
    ledger.write_export(runs, str(tmp_path / "x"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).columns == ["ts", "content_type", "original_tokens", "cleaned_tokens", "savings_pct"]


def test_transcripts(spark, tmp_path):
    import json as j

    root = tmp_path / "-home-me"
    (root / "a" / "b" / "c" / "d").mkdir(parents=True)
    line = lambda content: j.dumps({"type": "user", "message": {"content": content}}, separators=(",", ":"))
    parts = [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "text", "text": "two"}]
    (root / "s.jsonl").write_text("\n".join([line("hi"), line(parts), '{"type": "user"}', '{"type":"user", broken', line(5), line("[not parts]")]))
    (root / "a" / "b" / "c" / "deep.jsonl").write_text(line("depth three"))
    (root / "a" / "b" / "c" / "d" / "deeper.jsonl").write_text(line("depth four"))
    got = documents.transcripts(spark, str(tmp_path), project="/home/me")
    assert sorted(r.text for r in got.collect()) == sorted(["hi", "one\ntwo", "[not parts]", "depth three"])
    assert documents.transcripts(spark, str(tmp_path), as_of=datetime(2000, 1, 1), days=1, most_depth=9).count() == 5
    assert documents.transcripts(spark, str(tmp_path), as_of=datetime(2999, 1, 1), days=1).count() == 0
    texts = spark.createDataFrame([("1", "a: 1\nb: 2\nc: 3\nd: 4\n" + "x" * 300), ("1", "y" * 299), ("2", "z" * 300)], "s string, text string")
    assert discover.summary(texts, session_col="s").first()[:] == (2, 2, 1)
    assert sorted((r.label or "", r.messages, r.percent) for r in discover.by_label(texts).collect()) == [("", 1, 25), ("yaml", 1, 25)]
    assert [(r.messages, r.percent) for r in discover.by_label(texts.limit(0)).collect()] == [(0, 0)]


def test_options(tmp_path):
    bad, good = tmp_path / "bad.json", tmp_path / "good.json"
    bad.write_text('{"defaults": {"compact": 3}}')
    good.write_text('{"defaults": {"compact": true}}')
    with pytest.warns(UserWarning):
        assert load([str(tmp_path / "none"), str(bad), str(good)]) == Options(compact=True)
    assert Options(stats=True).merged(Options(compact=True)).effective_aggressive


def test_sql_names(spark):
    register(spark, ())
    assert spark.sql("SELECT clean_lines('select 1', 'sql', false) AS c").first().c == "SELECT 1"
    assert [r.line for r in spark.sql("SELECT * FROM doc_lines('a\\nb')").collect()] == ["a", "b"]


def test_sql_names_give_what_columns_give(spark):
    register(spark)
    given = ["", None, "a,b,c\n1,2,3\n4,5,6\n7,8,9", "API_KEY='x\\y'\nHOST=h\nPORT=1", "<div class=\"a\">it's &amp; \\d</div>\n<p>x</p>\n<ul>", '{"a": "b"}', "Traceback (most recent call last):\n  boom\r\n", "\x1b[1mplain\x1b[0m \u00e9"]
    docs = spark.createDataFrame(list(enumerate(given)), "n int, text string").withColumn("label", detect(F.col("text")))
    docs.createOrReplaceTempView("given")
    text, label = F.col("text"), F.col("label")
    family = F.substring_index(label, "/", 1)
    pairs = {
        "detect_type(text)": label, "est_tokens(text, substring_index(label, '/', 1))": tokens.estimate(text, family), "simple_tokens(text)": tokens.simple_estimate(text),
        "frame_text(text, label)": annotate.frame(text, label), "wrap_prompt(text, 'REVIEW', label)": prompt.wrap(text, "review", label), "wrap_prompt(text, 'none', label)": prompt.wrap(text, "none", label),
        "clean_text(text, label, false)": clean.clean(text, label, False), "clean_text(text, label, true)": clean.clean(text, label, True),
    }
    named = spark.sql(f"SELECT n, {', '.join(f'{sql} AS c{i}' for i, sql in enumerate(pairs))} FROM given ORDER BY n").collect()
    columns = docs.select("n", *[c.alias(f"c{i}") for i, c in enumerate(pairs.values())]).orderBy("n").collect()
    assert named == columns
    assert {r["c0"] for r in named} >= {"csv", "env", "html", "json", "trace/python", "text"}


def test_stream(spark, tmp_path):
    from corpusloom.streaming import watch

    a, b = "2024-01-01T00:00:00Z INFO ping\n" * 20, "2024-01-01T00:00:00Z WARN pong\n" * 20
    out = process(spark.createDataFrame([(0, a)], "doc_id long, text string")).first().output
    rows = [(1, a), (2, a), (3, b), (4, a), (5, "short"), (6, a), (7, out)]
    src = str(tmp_path / "src")
    spark.createDataFrame([("s", q, t) for q, t in rows], "session_id string, seq long, text string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("session_id string, seq long, text string").parquet(src)
    q = watch.start(stream, str(tmp_path / "out"), str(tmp_path / "led"), str(tmp_path / "cp"), at=datetime(2024, 1, 1), availableNow=True)
    q.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out"))
    # 2 repeats the text before, 7 is the output of 6; the short text of 5 still counts as a change
    assert sorted(r.seq for r in written.collect()) == [1, 3, 4, 6]
    assert watch.totals(written).first().runs == 4 and spark.read.parquet(str(tmp_path / "led")).count() == 4


def test_stream_state_goes_on(spark, tmp_path):
    """First values of a session, state after a restart, expiry, and state read back."""
    from corpusloom.streaming import watch

    a, b = "2024-01-01T00:00:00Z INFO ping\n" * 20, "2024-01-01T00:00:00Z WARN pong\n" * 20
    schema = "session_id string, seq long, text string"
    src, cp = str(tmp_path / "src"), str(tmp_path / "cp")
    hashed = spark.sql("SELECT xxhash64(:a) AS own", {"a": a}).first().own
    initial = spark.createDataFrame([("s", hashed, hashed, 5, 500, 0), ("never", None, None, 1, 10, 7)], watch.INITIAL)
    for part in ([("s", 1, a), ("s", 2, b), ("t", 1, None), ("t", 2, a), (None, 1, b)], [("s", 3, b), ("s", 4, a), ("t", 3, b), ("t", None, a)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        watch.start(stream, str(tmp_path / "out"), str(tmp_path / "led"), cp, at=datetime(2024, 1, 1), ttl_ms=3_600_000, initial=initial, once=True).awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    last = (1 << 63) - 1
    assert {(r.session, r.seq, r.runs) for r in written} == {("s", 2, 6), ("s", 4, 7), ("t", 2, 1), ("t", 3, 2), ("t", last, 3), (None, 1, 1)}
    saved = {r.session: r.saved for r in watch.totals(spark.createDataFrame(written)).collect()}
    now = {r.session: (r.runs, r.saved, r.last_seq) for r in watch.state(spark, cp).collect()}
    assert now == {"s": (7, 500 + saved["s"], 4), "t": (3, saved["t"], last), None: (1, saved[None], 1), "never": (1, 10, 7)}
    first = {r.session: r.runs for r in watch.state(spark, cp, batch=0).collect()}
    assert first == {"s": 6, "t": 1, None: 1, "never": 1}
    assert {(r.session, r.seq) for r in watch.state(spark, cp, "undo").collect()} == {("s", 2), ("s", 4), ("t", 2), ("t", 3), ("t", last), (None, 1)}
    assert {r.session for r in watch.state(spark, cp, "before").collect()} == {"s", "t", None}
