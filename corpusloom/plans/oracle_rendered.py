"""SQL in closed form for cleaned documents of the rendered corpus: what the rules leave of each, written from the rules alone."""

from __future__ import annotations

from .oracle import _fold, words

NL = "chr(10)"


def _lines(n: str, line: str) -> str:
    """line(i) for i from 1 to n, joined by line feeds."""
    return f"array_to_string(list_transform(generate_series(1, {n}), lambda i: {line}), {NL})"


def _some(n: str, name: str) -> str:
    return f"CASE WHEN {n} > 0 THEN ' | ' || {n} || '{name}' ELSE '' END"


def csv(aggressive: bool) -> str:
    k = 3 if aggressive else 5
    return f"""
WITH l AS (SELECT l_orderkey AS doc_key, l_linenumber AS o, l_orderkey || ',' || l_linenumber || ',' || CAST(trunc(l_quantity) AS BIGINT) AS line FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY o, line) AS n, count(*) OVER (PARTITION BY doc_key) AS m FROM l)
SELECT doc_key, 'orderkey,linenumber,quantity' || {NL} || string_agg(line, {NL} ORDER BY n) || CASE WHEN any_value(m) > {k} THEN {NL} || '... [' || (any_value(m) - {k}) || ' more rows]' ELSE '' END AS cleaned,
       '[csv | ' || (count(*) + 1 + CAST(any_value(m) > {k} AS INTEGER)) || ' lines | ' || (count(*) + CAST(any_value(m) > {k} AS INTEGER)) || ' rows | 3 columns | orderkey, linenumber, quantity]' AS framed
FROM r WHERE n <= {k} GROUP BY doc_key
"""


def log(aggressive: bool) -> str:
    k = 1 if aggressive else 2
    level = "CASE WHEN event_id % 7 = 0 THEN 'ERROR' WHEN event_id % 5 = 0 THEN 'WARN' ELSE 'INFO' END"
    rows = f"SELECT user_id AS doc_key, event_id AS i, '2024-01-01T00:00:00Z ' || {level} || ' ' || event_type || ' id=1' || (event_id + 1000) AS line, {level} || event_type AS k FROM events"
    note = f"'  [... ' || (size - {k}) || ' identical lines suppressed]'"
    return f"""
WITH {_fold('doc_key', rows, 'k', k, note)},
w AS (SELECT doc_key, string_agg(line, {NL} ORDER BY i) AS cleaned, count(*) AS n, count(*) FILTER (regexp_matches(upper(line), 'ERROR|FATAL|PANIC')) AS e, count(*) FILTER (contains(upper(line), 'WARN')) AS a FROM v GROUP BY doc_key)
SELECT doc_key, cleaned, '[log | ' || n || ' lines' || {_some('e', ' error(s)')} || {_some('a', ' warning(s)')} || CASE WHEN e = 0 AND a = 0 THEN ' | ' || n || ' lines' ELSE '' END || ']' AS framed FROM w
"""


def env(aggressive: bool) -> str:
    parts = ["'C_NAME=' || c_name", "'API_KEY_' || c_custkey || '=***'", "''", "'DB_PASSWORD=***'", "'SEGMENT=' || c_mktsegment", "'plain line'"]
    return f"SELECT CAST(c_custkey AS BIGINT) AS doc_key, {f' || {NL} || '.join(parts)} AS cleaned, '[env | 6 lines | 4 vars | 2 secrets masked]' AS framed FROM customer"


def _trace(body: str, label: str, rows: str, frames: str, error: str) -> str:
    return f"""
WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS doc_key, s_name, CAST(s_suppkey % 20 AS BIGINT) AS n FROM supplier)
SELECT doc_key, {body} AS cleaned, '[{label} | ' || ({rows}) || ' lines' || {_some(frames, ' frames')} || ' | ' || {error} || ']' AS framed FROM s
"""


def python(aggressive: bool) -> str:
    k = 5 if aggressive else 10
    kept, over = f"least(n, {k})", f"CASE WHEN n > {k} THEN {NL} || '  ... [frames truncated]' ELSE '' END"
    frame = f"'  File \"/srv/app.py\", line ' || i || ', in f' || i || {NL} || '    call(' || i || ')'"
    body = f"'Traceback (most recent call last):' || CASE WHEN n > 0 THEN {NL} || {_lines(kept, frame)} ELSE '' END || {over} || {NL} || 'KeyError: ''' || s_name || ''''"
    return _trace(body, "trace/python", f"2 + 2 * {kept} + CAST(n > {k} AS INTEGER)", kept, "'KeyError: ''' || s_name || ''''")


def javascript(aggressive: bool) -> str:
    k = 5 if aggressive else 12
    kept, over = f"least(n, {k})", f"CASE WHEN n > {k} THEN {NL} || '    ... [frames truncated]' ELSE '' END"
    frame = "'    at fn' || i || ' (.../file.js:' || i || ':1)'"
    body = f"'Error: ' || s_name || CASE WHEN n > 0 THEN {NL} || {_lines(kept, frame)} ELSE '' END || {over}"
    return _trace(body, "trace/javascript", f"1 + {kept} + CAST(n > {k} AS INTEGER)", kept, "'Error: ' || s_name")


def go(aggressive: bool) -> str:
    k = 5 if aggressive else 10
    kept = f"least(2 * n, {k})"
    frame = "CASE WHEN i % 2 = 1 THEN 'main.f' || ((i + 1) // 2) || '(0x1)' ELSE chr(9) || '/src/main.go:' || (i // 2) || ' +0x1d' END"
    body = f"'panic: ' || s_name || {NL} || {NL} || 'goroutine 1 [running]:' || {NL} || {_lines(kept, frame)} || {NL} || {NL} || 'exit status 2'"
    return _trace(body, "trace/go", f"5 + greatest({kept}, 1)", f"({kept} // 2)", "'exit status 2'")


def terraform(aggressive: bool) -> str:
    value = ["'  default = { ... }'"] if aggressive else ["'  default = {'", "'    x = ' || s_suppkey", "'  }'"]
    parts = ["'variable \"a\" {'", *value, "'}'", "'resource \"r\" \"' || s_name || '\" {'", "'    url = \"http://x\"'", "'}'"]
    return f"SELECT CAST(s_suppkey AS BIGINT) AS doc_key, {f' || {NL} || '.join(parts)} AS cleaned, '[terraform | {len(parts)} lines | 1 resources | 1 variables]' AS framed FROM supplier"


def markdown(aggressive: bool) -> str:
    side = [] if aggressive else ["'## License'", "'MIT'", "'- **Inner**'", "'x'"]
    parts = ["'# ' || p_name", "''", *side, "'## Use'", "'- **' || p_brand || '**'", "'```'", "'code'", "'```'"]
    text = f" || {NL} || ".join(parts)
    return f"SELECT doc_key, cleaned, '[markdown | {len(parts)} lines | ~' || {words('cleaned')} || ' words | {2 if aggressive else 3} sections | 1 code blocks]' AS framed FROM (SELECT CAST(p_partkey AS BIGINT) AS doc_key, {text} AS cleaned FROM part)"


def tsc(aggressive: bool) -> str:
    group = []
    size = []
    for k in range(3):
        mine = f"list_filter(generate_series(1, n), lambda i: i % 3 = {k})"
        place = "'src/a' || (i % 2) || '.ts:' || i"
        many = f"{NL} || {NL} || 'TS230{k} (' || len({mine}) || 'x): bad ' || {mine}[1] || {NL} || array_to_string(list_transform({mine}, lambda i: '  ' || {place}), {NL})"
        one = f"{NL} || {NL} || 'TS230{k}: ' || array_to_string(list_transform({mine}, lambda i: {place} || ' -- bad ' || i), '')"
        group.append(f"CASE WHEN len({mine}) > 1 THEN {many} WHEN len({mine}) = 1 THEN {one} ELSE '' END")
        size.append(f"CASE WHEN len({mine}) > 1 THEN 2 + len({mine}) WHEN len({mine}) = 1 THEN 2 ELSE 0 END")
    return f"""
WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS doc_key, CAST(s_suppkey % 20 AS BIGINT) AS n FROM supplier)
SELECT doc_key, '// TypeScript: ' || n || ' error(s)' || {' || '.join(group)} || {NL} || 'Found errors.' AS cleaned, '[build/typescript | ' || (2 + {' + '.join(size)}) || ' lines | 2 error(s)]' AS framed FROM s
"""


FORMS = {"csv": csv, "log": log, "env": env, "trace_python": python, "trace_javascript": javascript, "trace_go": go, "terraform": terraform, "markdown": markdown, "build_typescript": tsc}
ORACLE_SQL = {f"clean_{name}_rendered{suffix}": form(bool(suffix)) for name, form in FORMS.items() for suffix in ("", "_aggressive")}


def yaml(aggressive: bool) -> str:
    """Comments and description go; a script of more than three steps is cut (its last line is the blank behind none)."""
    n = "(c_custkey % 6)"
    steps = f"CASE WHEN {n} > 0 THEN {NL} || {_lines(f'least({n}, 3)', repr('    step ') + ' || i')} ELSE {NL} END || CASE WHEN {n} > 3 THEN {NL} || '    # ... [' || ({n} - 3) || ' more lines]' ELSE '' END"
    head = ["'kind: Customer'", "'metadata:'", "'    name: ' || c_name", "'spec:'", *([] if aggressive else ["'  replicas: 1'"]), "'  segment: ' || c_mktsegment", "'  script: |'"]
    tail = f"{NL} || 'status: # [omitted]'" if aggressive else f"{NL} || 'status:' || {NL} || '  ready: true'"
    rows = f"{len(head) + (1 if aggressive else 2)} + greatest(least({n}, 3), 1) + CAST({n} > 3 AS INTEGER)"
    return f"SELECT CAST(c_custkey AS BIGINT) AS doc_key, {f' || {NL} || '.join(head)} || {steps} || {tail} AS cleaned, '[yaml | ' || ({rows}) || ' lines | Kubernetes Customer]' AS framed FROM customer"


def dockerfile(aggressive: bool) -> str:
    n = "(s_suppkey % 8 + 1)"
    step = f"CASE WHEN i = 1 THEN 'RUN ' ELSE '    ' END || 'step' || i || CASE WHEN i < {n} THEN ' && \\' ELSE '' END"
    run = _lines(n, step)
    short = f" || {NL} || ".join(["'RUN step1 && \\'", "'    step2 && \\'", f"'    # ... [' || ({n} - 3) || ' more commands] && \\'", f"'    step' || {n}"])
    run = f"CASE WHEN {n} = 1 THEN 'RUN   step1' ELSE {run} END"  # a single line stays as it stands
    body, rows = (f"CASE WHEN {n} > 5 THEN {short} ELSE {run} END", f"CASE WHEN {n} > 5 THEN 4 ELSE {n} END") if aggressive else (run, n)
    return f"""SELECT CAST(s_suppkey AS BIGINT) AS doc_key, 'FROM base AS b' || {NL} || {NL} || {body} || {NL} || 'FROM run' || {NL} || 'COPY a b' || {NL} || 'EXPOSE 80 ' || s_suppkey || {NL} || 'CMD x' AS cleaned,
       '[dockerfile | ' || (6 + {rows}) || ' lines | 2 stages | exposes 80, ' || s_suppkey || ' | 1 RUN commands]' AS framed FROM supplier"""


def diff(aggressive: bool) -> str:
    k = 1 if aggressive else 2
    p, q = "(p_partkey % 9)", "(p_partkey % 7)"
    note = lambda n: f"' ... [' || ({n} - {k}) || ' context lines omitted]'"
    part = lambda name, lo, hi: f"array_to_string(list_transform(generate_series({lo}, {hi}), lambda i: ' {name} line ' || i), {NL})"
    top = f"CASE WHEN {p} - {k} >= 3 THEN {note(p)} || {NL} || {part('top', f'{p} - {k} + 1', p)} ELSE {part('top', 1, p)} END"
    end = f"CASE WHEN {q} - {k} >= 3 THEN {part('end', 1, k)} || {NL} || {note(q)} ELSE {part('end', 1, q)} END"
    count = lambda n: f"CASE WHEN {n} - {k} >= 3 THEN {k} + 1 ELSE greatest({n}, 1) END"
    head = f" || {NL} || ".join(["'diff --git a/f b/f'", "'index 1..2'", "'--- a/f'", "'+++ b/f'", "'@@ -1,9 +1,9 @@'"])
    return f"""SELECT CAST(p_partkey AS BIGINT) AS doc_key, {head} || {NL} || {top} || {NL} || '-' || p_name || {NL} || '+' || p_brand || {NL} || {end} || {NL} || '@@ -20 +20 @@' AS cleaned,
       '[git-diff | ' || (8 + {count(p)} + {count(q)}) || ' lines | 1 file(s) | +1/-1]' AS framed FROM part"""


def java(aggressive: bool) -> str:
    k = 8 if aggressive else 15
    frames = "list_filter(generate_series(1, n), lambda i: i % 4 <> 0)"
    kept = f"{frames}[1:{k}]"
    body = f"CASE WHEN len({frames}) > 0 THEN {NL} || array_to_string(list_transform({kept}, lambda i: chr(9) || 'at com.shop.Cart.get(Cart.java:' || i || ')'), {NL}) ELSE CASE WHEN n = 0 THEN {NL} ELSE '' END END || CASE WHEN len({frames}) > {k} THEN {NL} || chr(9) || '... [frames truncated]' ELSE '' END"
    text = f"'Exception in thread \"main\" java.lang.Error: ' || s_name || {body} || {NL} || 'Caused by: x' || CASE WHEN n = 0 THEN '' ELSE {body} END"
    rows = f"2 + 2 * len({kept}) + 2 * CAST(len({frames}) > {k} AS INTEGER) + CAST(n = 0 AS INTEGER)"
    return _trace(text, "trace/java", rows, f"(2 * len({kept}))", "'Caused by: x'")


MORE = {"yaml": yaml, "dockerfile": dockerfile, "git_diff": diff, "trace_java": java}
ORACLE_SQL |= {f"clean_{name}_rendered{suffix}": form(bool(suffix)) for name, form in MORE.items() for suffix in ("", "_aggressive")}


def sql(aggressive: bool) -> str:
    row = "'(' || n_nationkey || ', ''' || n_name || '''),'"
    return f"""
WITH r AS (SELECT n_regionkey, {row} AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation)
SELECT CAST(n_regionkey AS BIGINT) AS doc_key, 'INSERT INTO nation VALUES' || {NL} || string_agg(line, {NL} ORDER BY i) || {NL} || '  -- ... [VALUES rows truncated]' || {NL} || '  -- (' || any_value(n) || ' total rows)' || {NL}
       || 'SELECT n_name FROM nation WHERE n_regionkey IS NOT NULL ORDER BY n_name;' AS cleaned, '[sql | 7 lines | 1 select | 1 insert]' AS framed
FROM r WHERE i <= 3 GROUP BY n_regionkey
"""


def json(aggressive: bool) -> str:
    k = 1 if aggressive else 2
    item = f" || {NL} || ".join(["'    {'", "'      \"key\": ' || o_orderkey || ','", "'      \"priority\": \"' || o_orderpriority || '\",'", "'      \"status\": \"' || o_orderstatus || '\"'", "'    }'"])
    end = f" || {NL} || ".join(["'  ],'", "'  \"page\": {'", "'    \"info.next\": 2'", "'  }'", "'}'"])
    more = f"CASE WHEN any_value(n) > {k + 1} THEN ',' || {NL} || '    \"... ' || (any_value(n) - {k}) || ' more objects with same structure\"' ELSE '' END"
    return f"""
WITH r AS (SELECT o_custkey, {item} AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey AS doc_key, '{{' || {NL} || '  "orders": [' || {NL} || string_agg(item, ',' || {NL} ORDER BY i) || {more} || {NL} || {end} AS cleaned,
       '[json | ' || (7 + 5 * count(*) + CAST(any_value(n) > {k + 1} AS INTEGER)) || ' lines | 2 top-level keys | error response]' AS framed
FROM r WHERE n <= {k + 1} OR i <= {k} GROUP BY o_custkey
"""


def cargo(aggressive: bool) -> str:
    of = lambda k: f"list_filter(generate_series(1, n), lambda i: i % 3 = {k})"
    c = lambda k: f"len({of(k)})"
    block = lambda k, kind, text: f"CASE WHEN {c(k)} > 0 THEN {NL} || {NL} || 'src/m{k}.rs (' || {c(k)} || ' {kind}(s)):' || {NL} || array_to_string(list_transform({of(k)}, lambda i: '  {text} v' || i), {NL}) ELSE '' END"
    shown = f"({c(0)} > 0 AND {c(1)} + {c(2)} = 0)" if aggressive else f"({c(0)} > 0)"
    body = f"{block(1, 'error', 'error[E0425]: missing')} || {block(2, 'error', 'error[E0425]: missing')} || CASE WHEN {shown} THEN {block(0, 'warning', 'warning: unused')} ELSE '' END"
    rows = lambda k: f"CASE WHEN {c(k)} > 0 THEN {c(k)} + 1 ELSE 0 END"
    blanks = f"CAST({c(1)} > 0 AS INTEGER) + CAST({c(2)} > 0 AS INTEGER) + CAST({shown} AS INTEGER)"
    warned = f"CASE WHEN {shown} THEN {rows(0)} ELSE 0 END"
    return f"""
WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS doc_key, CAST(s_suppkey % 20 AS BIGINT) AS n FROM supplier)
SELECT doc_key, '// Build: ' || ({c(1)} + {c(2)}) || ' error(s), ' || {c(0)} || ' warning(s)' || {body} || {NL} || 'error: could not compile `b`' AS cleaned,
       '[build/cargo | ' || (2 + {rows(1)} + {rows(2)} + {warned} + {blanks}) || ' lines | ' || (2 + {rows(1)} + {rows(2)}) || ' error(s) | ' || (1 + {warned}) || ' warning(s)]' AS framed FROM s
"""


def eslint(aggressive: bool) -> str:
    keep = " AND i % 4 <> 0" if aggressive else ""
    of = lambda k: f"list_filter(generate_series(1, n), lambda i: i % 2 = {k}{keep})"
    c = lambda k: f"len({of(k)})"
    place = "'/src/a.js:' || i || ' message ' || i"

    def block(k: int) -> str:
        one = f"{NL} || '  rule-{k}: ' || array_to_string(list_transform({of(k)}, lambda i: {place}), '')"
        many = f"{NL} || '  rule-{k} (' || {c(k)} || 'x):' || {NL} || array_to_string(list_transform({of(k)}[1:3], lambda i: '    ' || {place}), {NL}) || CASE WHEN {c(k)} > 3 THEN {NL} || '    ... ' || ({c(k)} - 3) || ' more' ELSE '' END"
        return f"CASE WHEN {c(k)} = 1 THEN {one} WHEN {c(k)} > 1 THEN {many} ELSE '' END"

    rows = lambda k: f"CASE WHEN {c(k)} > 1 THEN 1 + least({c(k)}, 4) ELSE {c(k)} END"
    return f"""
WITH s AS (SELECT CAST(s_suppkey AS BIGINT) AS doc_key, CAST(s_suppkey % 20 AS BIGINT) AS n FROM supplier)
SELECT doc_key, '// ESLint: ' || ({c(0)} + {c(1)}) || ' violation(s)' || {block(0)} || {block(1)} || {NL} || {NL} || '✖ ' || n || ' problems' AS cleaned, '[build/eslint | ' || (3 + {rows(0)} + {rows(1)}) || ' lines]' AS framed FROM s
"""


def rust_trace(aggressive: bool) -> str:
    k = 8 if aggressive else 15
    frames = "list_filter(generate_series(1, n), lambda i: i % 5 <> 0)"
    kept = f"{frames}[1:{k}]"
    frame = "i || ': shop::cart::get'"
    body = f"CASE WHEN n = 0 THEN {NL} ELSE {NL} || array_to_string(list_transform({kept}, lambda i: '   ' || {frame}), {NL}) END || CASE WHEN len({frames}) > {k} THEN {NL} || '   ... [backtrace truncated]' ELSE '' END"
    text = f"'thread ''main'' panicked at src/main.rs:1:1:' || {NL} || s_name || {NL} || 'stack backtrace:' || {body}"
    rows = f"3 + len({kept}) + CAST(len({frames}) > {k} AS INTEGER)"
    return _trace(text, "trace/rust", rows, f"len({kept})", f"CASE WHEN n = 0 THEN 'stack backtrace:' ELSE {kept}[-1] || ': shop::cart::get' END")


LAST = {"sql": sql, "json": json, "build_cargo": cargo, "build_eslint": eslint, "trace_rust": rust_trace}
ORACLE_SQL |= {f"clean_{name}_rendered{suffix}": form(bool(suffix)) for name, form in LAST.items() for suffix in ("", "_aggressive")}


def rust(aggressive: bool) -> str:
    u = "(p_partkey % 6 + 1)"
    uses = f"CASE WHEN {u} < 3 THEN {_lines(u, repr('use shop::part') + ' || i || ' + repr(';'))} ELSE '// [' || {u} || ' imports: ' || array_to_string(list_transform(generate_series(1, least({u}, 4)), lambda i: 'shop::part' || i), ', ') || CASE WHEN {u} > 4 THEN ', ...' ELSE '' END || ']' END"
    rest = ["pub struct P;", "", "pub fn f() -> i32 { let a = 1; a }", "// [test module omitted]", "```"] if aggressive else ["#[derive(Debug)]", "pub struct P;", "", "", "pub fn f() -> i32 { let a = 1; a }", "#[cfg(test)]", "mod tests {", "  fn t() {}", "}", "```"]
    text = f" || {NL} || ".join(["'```rust'", uses, *(repr(r) for r in rest)])
    notes = "1 exported | 1 functions | 1 types/classes" if aggressive else "1 exported | 2 functions | 1 types/classes | contains tests"
    return f"SELECT CAST(p_partkey AS BIGINT) AS doc_key, {text} AS cleaned, '[code/rust | ' || ({1 + len(rest)} + CASE WHEN {u} < 3 THEN {u} ELSE 1 END) || ' lines | {notes}]' AS framed FROM part"


def typescript(aggressive: bool) -> str:
    g = "(p_partkey % 5)"
    gets = f"CASE WHEN {g} = 0 THEN '' WHEN {g} < 3 THEN {_lines(g, repr('  get a') + ' || i || ' + repr('() { return ') + ' || i || ' + repr('; }'))} ELSE '  // [' || {g} || ' getters/setters: ' || array_to_string(list_transform(generate_series(1, {g}), lambda i: 'a' || i), ', ') || ']' END"
    head = ["'```typescript'", "'import a from ''a'';'", "'export class P {'"]
    rest = ["'  url = \"http://x\";'", *([] if aggressive else ["'  @dec'"]), "'  f() {}'", "'}'", "'const g = () => 1;'", "'```'"]
    rows = f"{len(head) + len(rest)} + CASE WHEN {g} = 2 THEN 2 ELSE 1 END"
    return f"SELECT CAST(p_partkey AS BIGINT) AS doc_key, {f' || {NL} || '.join([*head, gets, *rest])} AS cleaned, '[code/typescript | ' || ({rows}) || ' lines | 1 exported | 1 functions | 1 types/classes]' AS framed FROM part"


ORACLE_SQL |= {f"clean_code_{name}_rendered{suffix}": form(bool(suffix)) for name, form in (("rust", rust), ("typescript", typescript)) for suffix in ("", "_aggressive")}

_LABELS = {
    "cargo": ("supplier", "s_suppkey", "'build/cargo'"), "diff": ("part", "p_partkey", "'git-diff'"), "dockerfile": ("supplier", "s_suppkey", "'dockerfile'"), "env": ("customer", "c_custkey", "'env'"),
    "eslint": ("supplier", "s_suppkey", "CASE WHEN s_suppkey % 20 < 3 THEN 'text' ELSE 'build/eslint' END"), "go": ("supplier", "s_suppkey", "'trace/go'"),
    "java": ("supplier", "s_suppkey", "CASE WHEN s_suppkey % 20 = 0 THEN 'text' ELSE 'trace/java' END"), "javascript": ("supplier", "s_suppkey", "CASE WHEN s_suppkey % 20 < 2 THEN 'text' ELSE 'trace/javascript' END"),
    "markdown": ("part", "p_partkey", "'markdown'"), "python": ("supplier", "s_suppkey", "'trace/python'"), "rust": ("part", "p_partkey", "'code/rust'"), "rusttrace": ("supplier", "s_suppkey", "'trace/rust'"),
    "terraform": ("supplier", "s_suppkey", "'terraform'"), "tsc": ("supplier", "s_suppkey", "CASE WHEN s_suppkey % 20 = 0 THEN 'text' ELSE 'build/typescript' END"), "typescript": ("part", "p_partkey", "'code/typescript'"),
    "yaml": ("customer", "c_custkey", "'yaml'"),
}
_GROUPED = {
    "csv": ("lineitem", "l_orderkey", "CASE WHEN count(*) < 2 THEN 'text' ELSE 'csv' END"), "log": ("events", "user_id", "CASE WHEN count(*) < 3 THEN 'text' ELSE 'log' END"),
    "json": ("orders", "o_custkey", "'json'"), "sql": ("nation", "n_regionkey", "'sql'"),
}
ORACLE_SQL["detect_rendered"] = " UNION ALL ".join(
    [f"SELECT '{kind}' AS kind, CAST({key} AS BIGINT) AS doc_key, {label} AS label FROM {table}" for kind, (table, key, label) in _LABELS.items()]
    + [f"SELECT '{kind}' AS kind, CAST({key} AS BIGINT) AS doc_key, {label} AS label FROM {table} GROUP BY {key}" for kind, (table, key, label) in _GROUPED.items()]
)
