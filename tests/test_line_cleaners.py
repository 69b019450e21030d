"""Hand-derived results of the cleaners, with the borders of their limits."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.operators import line_cleaners as L


def traceback(n):
    return "Traceback (most recent call last):\n" + "".join(f'  File "/a.py", line {i}, in f{i}\n    call()\n' for i in range(n)) + "KeyError: 'x'"


@pytest.mark.parametrize(("n", "aggressive", "rows"), [(10, False, 22), (11, False, 23), (12, False, 23), (5, True, 12), (12, True, 13)])
def test_python_trace(n, aggressive, rows):
    out = L.python_trace(traceback(n), aggressive).split("\n")
    assert len(out) == rows
    assert out[-1] == "KeyError: 'x'"
    assert ("  ... [frames truncated]" in out) == (n > (5 if aggressive else 10))


def test_other_traces():
    js = "Error: x\n" + "\n".join(f"    at f{i} (/home/u/a/b/c.js:{i}:1)" for i in range(14))
    out = L.stack_trace(js, "javascript", False).split("\n")
    assert len(out) == 14 and out[1] == "    at f0 (.../c.js:0:1)" and out[-1].endswith("[frames truncated]")
    java = "\n".join(["Exception in thread x", *["\tat com.a.B.c(B.java:1)"] * 16, "\tat java.util.List.get(List.java:3)", "Caused by: y", "\tat com.a.B.c(B.java:1)"])
    out = L.stack_trace(java, "java", False).split("\n")
    assert len(out) == 1 + 15 + 1 + 2 and not any("java.util" in x for x in out)
    go = "goroutine 1 [running]:\n" + "\n".join(f"main.f({i})" for i in range(12)) + "\n\nmain.g()"
    assert len(L.stack_trace(go, "go", False).split("\n")) == 1 + 10 + 2
    rust = "thread 'main' panicked at x\nstack backtrace:\n" + "\n".join(f"   {i}: app::f" for i in range(16)) + "\n  17: std::rt::x"
    assert len(L.stack_trace(rust, "rust", True).split("\n")) == 2 + 8 + 1


def test_diff():
    body = [*(f" c{i}" for i in range(8)), "-old", "+new", *(f" d{i}" for i in range(8))]
    out = L.git_diff("\n".join(["diff --git a b", "@@ -1 +1 @@", *body]), "", False).split("\n")
    assert out == ["diff --git a b", "@@ -1 +1 @@", " ... [6 context lines omitted]", " c6", " c7", "-old", "+new", " d0", " d1", " ... [6 context lines omitted]"]
    assert " ... [7 context lines omitted]" in L.git_diff("\n".join(["@@ -1 +1 @@", *body]), "", True)
    assert L.git_diff("@@ -1 +1 @@\n a\n b", "", False) == "@@ -1 +1 @@"
    assert L.git_diff("@@ -1 +1 @@\n a\n b\n c\n d\n+x", "", False).count("\n") == 5  # two lines would go: they stay


def test_log_and_plain():
    log = "".join(f"2024-01-01T00:00:0{i}Z INFO ping 1234{i}\n" for i in range(5))
    assert L.log(log, "", False).split("\n")[2:] == ["  [... 3 identical lines suppressed]"]
    assert L.log(log, "", True).count("\n") == 1
    assert L.log("a\n[==>  ] 40%\n\rb\nc", "", False) == "a\nc"
    assert L.log("\n\n\n", "", False) == "\n\n"
    assert L.plain("x\n-----\na\na\na\na\n\n\n\n\n>>> q\nz\n\n") == "x\na\na\n  [... 2 identical lines]\n\n\nz"
    assert L.plain("") == "" and L.plain("\n\n") == ""


def test_json():
    read = lambda s, a=False: L.json_text(s, "", a)
    assert json.loads(read('{"id":1,"error":"boom","ts":null,"user":{"a":1}}')) == {"_omitted": "2 non-error fields omitted", "error": "boom", "id": 1}
    assert read('{"a":{"b":{"c":1}}}') == '{\n  "a.b.c": 1\n}'
    assert json.loads(read('[{"a":1},{"a":2},{"a":3},{"a":4}]')) == [{"a": 1}, {"a": 2}, "... 2 more objects with same structure"]
    assert json.loads(read('[{"a":1},{"a":2},{"a":3}]')) == [{"a": 1}, {"a": 2}, {"a": 3}]
    assert json.loads(read(json.dumps(list(range(25))))) == list(range(25))
    assert json.loads(read('{"x":1.236,"y":-0.125,"createdAt":1}', True)) == {"x": 1.24, "y": -0.13}
    assert read('{"n": [NaN]}') == '{"n": [NaN]}'  # no JSON: plain text
    assert json.loads(read(json.dumps({"s": "é" * 101, "t": 1})))["s"] == "é" * 50 + "...[202 chars]"
    assert read("[1e16, 1e-7, 123456789012345678901234567890, 0.00001]") == "[\n  1e16,\n  1e-7,\n  1.2345678901234568e29,\n  0.00001\n]"


def test_yaml_and_terraform():
    y = "kind: Pod # c\ndescription: |\n  x\nspec:\n   a: |\n     1\n     2\n     3\n     4\n   replicas: 1\nstatus:\n  z: 1"
    assert L.yaml(y, "", False).split("\n") == ["kind: Pod", "spec:", "    a: |", "      1", "      2", "      3", "      # ... [1 more lines]", "    replicas: 1", "status:", "  z: 1"]
    assert L.yaml(y, "", True).split("\n")[-2:] == ["      # ... [1 more lines]", "status: # [omitted]"]
    assert L.yaml('a: "x # y"\nb: &k 1 # z', "", False) == 'a: "x # y"\nb: &k 1'
    t = 'variable "a" {\n description = "d"\n  default = {\n\n    x = 1\n  }\n}\nurl = "http://x" // c'
    assert L.terraform(t, "", True).split("\n") == ['variable "a" {', "  default = { ... }", "", "}", 'url = "http://x"']


def test_code():
    rust = "use a::b;\nuse c;\nuse d;\nuse e;\nuse f;\n/// doc\nfn main() {} // c\n#[cfg(test)]\nmod tests {\n  fn t() {}\n}\n#[derive(Debug)]\nstruct S;"
    assert L.code(rust, "rust", False).split("\n")[1] == "// [5 imports: a::b, c, d, e, ...]"
    assert L.code(rust, "rust", True).split("\n")[2:] == ["fn main() {}", "// [test module omitted]", "struct S;", "```"]
    js = "x = 'http://a'; // y\n/** d\n */\nclass A {\n" + "".join(f"  get a{i}() {{ return {i}; }}\n" for i in range(3)) + "}"
    assert L.code(js, "typescript", False).split("\n") == ["```typescript", "x = 'http://a';", "class A {", "  // [3 getters/setters: a0, a1, a2]", "}", "```"]
    two = "class A {\n  get a() { return 1; }\n  get b() { return 2; }\n}"
    assert "get b()" in L.code(two, "java", False)  # fewer than three stay
    assert L.code("```py\nx = 1\n```", "python", False) == "```py\nx = 1\n```"


def test_build_output():
    cargo = "   Compiling a v1\nerror[E0425]: nope\n  --> src/m.rs:4:5\nwarning: w\n  --> src/a.rs:1:1\nerror: could not compile"
    assert L.build(cargo, "cargo", False).split("\n") == ["// Build: 1 error(s), 1 warning(s)", "", "src/m.rs (1 error(s)):", "  error[E0425]: nope", "", "src/a.rs (1 warning(s)):", "  warning: w", "error: could not compile"]
    assert "warning: w" not in L.build(cargo, "cargo", True)
    tsc = L.build("a.ts(1,2): error TS2304: m\na.ts(3,2): error TS2304: m\nb.ts(1,1): error TS1: q\nend", "typescript", False)
    assert tsc.split("\n") == ["// TypeScript: 3 error(s)", "", "TS1: b.ts:1 -- q", "", "TS2304 (2x): m", "  a.ts:1", "  a.ts:3", "end"]
    es = L.build("/a.js\n" + "".join(f"  {i}:1  error  msg  no-var\n" for i in range(5)) + "  9:1  warning  w  eq\n\n✖ 6 problems", "eslint", True)
    assert es.split("\n") == ["// ESLint: 5 violation(s)", "  no-var (5x):", "    /a.js:0 msg", "    /a.js:1 msg", "    /a.js:2 msg", "    ... 2 more", "", "✖ 6 problems"]


def test_markdown_sql_dockerfile():
    md = "# T\n[![b](x)](y)\n## License\nmit\n### Sub\nx\n## Use\n### S2\n\n\n\nq"
    assert L.markdown(md, "", True).split("\n") == ["# T", "## Use", "- **S2**", "", "q"]
    assert "- **Sub**" in L.markdown(md, "", False)
    sql = L.sql("select a from t\n\n\n-- c\n/* d */\ninsert into t values\n(1),\n(2),\n(3),\n(4);\nselect selection", "", False)
    assert sql.split("\n") == ["SELECT a FROM t", "", "INSERT INTO t VALUES", "(1),", "(2),", "(3),", "  -- ... [VALUES rows truncated]", "  -- (4 total rows)", "SELECT selection"]
    docker = "FROM a\n# c\nRUN x && \\\n  y && \\\n  z\nCMD q"
    assert L.dockerfile(docker, "", False).split("\n") == ["FROM a", "RUN x && \\", "    y && \\", "    z", "CMD q"]
    many = "RUN " + " && ".join("abcdefg")
    assert L.dockerfile(many, "", True).split("\n") == ["RUN a && \\", "    b && \\", "    # ... [4 more commands] && \\", "    g"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300), st.sampled_from(sorted(L.CLEANERS)), st.booleans())
def test_no_text_fails(text, family, aggressive):
    assert isinstance(L.CLEANERS[family](text, "rust", aggressive), str)
