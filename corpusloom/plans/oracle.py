"""SQL for DuckDB that gives the same rows as the registered queries, written apart from them."""

from __future__ import annotations

from ..functions.tables import ANSWERS, ROLES, SAVINGS_RATE, SIDE_SECTIONS, TASKS, TOKENS_PER_WORD

WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)

# ---- ledger ----
RUNS = """
WITH e AS (SELECT event_id AS run_id, ts, event_type AS content_type, CAST(floor(value * 100) AS BIGINT) AS original_tokens FROM events),
c AS (SELECT *, original_tokens * (40 + run_id % 80) // 100 AS cleaned_tokens FROM e),
runs AS (SELECT *, CASE WHEN original_tokens > 0 THEN 100.0 - cleaned_tokens / original_tokens * 100.0 ELSE 0.0 END AS savings_pct FROM c)
"""
_TOTAL = "SELECT count(*) AS runs, CAST(coalesce(sum(original_tokens), 0) AS BIGINT) AS original_tokens, CAST(coalesce(sum(cleaned_tokens), 0) AS BIGINT) AS cleaned_tokens, round(coalesce(avg(savings_pct), 0.0), 6) AS avg_savings_pct FROM runs"
_SUMS = "count(*) AS runs, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(cleaned_tokens) AS BIGINT) AS cleaned_tokens"
_HISTORY = "SELECT run_id, ts, content_type, original_tokens, cleaned_tokens, round(savings_pct, 6) AS savings_pct FROM runs"
_SAVED = "greatest(original_tokens - cleaned_tokens, 0)"
_PERCENT = "CASE WHEN original_tokens > 0 THEN CAST(trunc((original_tokens - cleaned_tokens) * 100 / original_tokens) AS BIGINT) ELSE 0 END"
_LABEL = "CASE WHEN original_tokens = cleaned_tokens THEN 'no change' WHEN p > 0 THEN '-' || p || '%' WHEN p < 0 THEN '+' || -p || '%' WHEN cleaned_tokens < original_tokens THEN '-<1%' ELSE '+<1%' END"
LEDGER = {
    "ledger_total": _TOTAL,
    "ledger_range_7d": _TOTAL + " WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'",
    "ledger_today": _TOTAL + " WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'",
    "ledger_by_type": "SELECT content_type, count(*) AS runs, round(avg(savings_pct), 6) AS avg_savings_pct FROM runs GROUP BY content_type",
    "ledger_daily": f"SELECT CAST(ts AS DATE) AS day, {_SUMS}, round(avg(savings_pct), 6) AS avg_savings_pct FROM runs WHERE ts >= TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1",
    "ledger_daily_rollup": f"""SELECT day, CAST(grouping(day) AS INTEGER) AS is_total, {_SUMS}, CAST(greatest(sum(original_tokens) - sum(cleaned_tokens), 0) AS BIGINT) AS saved_tokens,
        round(CASE WHEN grouping(day) = 1 THEN greatest(sum(original_tokens) - sum(cleaned_tokens), 0) / sum(original_tokens) * 100.0 ELSE avg(savings_pct) END, 6) AS savings_pct
        FROM (SELECT *, CAST(ts AS DATE) AS day FROM runs) GROUP BY ROLLUP (day)""",
    "ledger_history50": _HISTORY + " ORDER BY run_id DESC LIMIT 50",
    "ledger_history_since": _HISTORY + " WHERE ts >= TIMESTAMP '2024-01-24 00:00:00' ORDER BY run_id DESC LIMIT 100",
    "ledger_export": "SELECT ts, content_type, original_tokens, cleaned_tokens, CAST(round(savings_pct, 1) AS DOUBLE) AS savings_pct FROM runs ORDER BY run_id",
    "ledger_savings_label": f"SELECT run_id, {_SAVED} AS saved_tokens, p AS percent, {_LABEL} AS savings_label FROM (SELECT *, {_PERCENT} AS p FROM runs)",
    "ledger_cost": f"SELECT content_type, CAST(sum({_SAVED}) AS BIGINT) AS saved_tokens, round(sum({_SAVED}) / 1000.0 * 0.005, 6) AS saved_cost FROM runs GROUP BY content_type",
}


# ---- text ----
def lines(t: str) -> str:
    parts = f"string_split({t}, chr(10))"
    return f"list_transform(CASE WHEN {t} = '' OR ends_with({t}, chr(10)) THEN {parts}[1:-2] ELSE {parts} END, lambda l: CASE WHEN ends_with(l, chr(13)) THEN l[1:-2] ELSE l END)"


def trim(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}+|{WS}+$', '', 'g')"


def count(t: str, pattern: str, flags: str = "") -> str:
    return f"len(regexp_extract_all({t}, '{flags}{pattern}'))"


def words(t: str) -> str:
    return count(t, NOT_WS + "+")


def _estimate(t: str, per_word: float | str) -> str:
    removed = lambda cls: f"(length({t}) - length(regexp_replace({t}, '{cls}', '', 'g')))"
    indent = f"list_sum(list_transform({lines(t)}, lambda l: strlen(l) - strlen(regexp_replace(l, '^{WS}+', ''))))"
    total = f"{words(t)} * CAST({per_word} AS DOUBLE) + {removed(r'[{}\[\]():,;<>=!&|]')} * CAST(0.6 AS DOUBLE) + {removed(chr(10))} * CAST(0.3 AS DOUBLE) + coalesce({indent}, 0) / CAST(4 AS DOUBLE) * CAST(0.2 AS DOUBLE)"
    return f"CAST(greatest(round({total}), 1) AS BIGINT)"


_SIMPLE = lambda t: f"CAST(round({words(t)} * CAST(1.3 AS DOUBLE)) AS BIGINT)"


def _detect(table: str, keys: str, text: str) -> str:
    """Rules in order over the first 8192 bytes. The driver's tables hold no character across that border but in a few rows, where the cut goes back to the character's start."""
    m = lambda pattern, n: f"{count('s', pattern, '(?m)')} >= {n}"
    w = WS
    distinct = lambda t, signs: "(" + " + ".join(f"CAST(contains({t}, '{x}') AS INTEGER)" for x in signs) + ")"
    some = lambda x: f"len(list_filter(tl, lambda l: starts_with(l, '{x}'))) > 0"
    rules = [
        ("git-diff", m(r"^(diff --git|--- a/|\+\+\+ b/)", 1)), ("trace/go", m(r"^goroutine \d+ \[", 1)), ("trace/java", m(rf"^{w}+at{w}+[\w\.$]+\([\w]+\.java:\d+\)", 1)),
        ("trace/python", m(r"^Traceback \(most recent call last\):", 1)), ("trace/rust", m("^thread ''.+'' panicked at", 1)),
        ("trace/javascript", m(rf"^{w}+at{w}+(?:async{w}+)?[\w.<>\[\]$]+(?:\.[\w<>\[\]$]+)*{w}+\(", 2)), ("trace/rust", m(rf"^{w}{{1,6}}\d+:{w}+{NOT_WS}", 2)),
        ("build/cargo", m(rf"(?:^ {{0,3}}(?:Compiling|Checking|Downloading|Downloaded|Fresh|Updating|Locking){w}|^error\[E\d+\]|^warning:\n|^(?:Finished (?:dev|release|test)|error: could not compile))", 2)),
        ("build/typescript", m(r"\w+\.tsx?\(\d+,\d+\): (?:error|warning) TS\d+:", 1)), ("build/eslint", m(rf"^{w}+\d+:\d+{w}+(?:error|warning){w}+{NOT_WS}", 3)),
        ("log", m(rf"(?:\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}|\[(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL)\]|(?:level|lvl|severity)=(?:info|warn|error|debug|trace|fatal)|^(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)(?:{w}|:))", 3)),
        ("json", """(t LIKE '{%' OR t LIKE '[%') AND contains(t, '"') AND (contains(t, ':') OR t LIKE '[%')"""),
        ("yaml", f"starts_with(s, '---') OR len(list_filter(tl, lambda l: l <> '' AND l NOT LIKE '#%' AND contains(l, ':') AND NOT contains({trim('split_part(l, chr(58), 1)')}, ' '))) >= 4"),
        ("markdown", """CAST(len(list_filter(ls[1:40], lambda l: l LIKE '#%')) >= 2 AS INTEGER) + CAST(len(list_filter(ls[1:40], lambda l: contains(l, '![') AND contains(l, ']('))) >= 1 AS INTEGER)
          + CAST(len(list_filter(ls[1:40], lambda l: l LIKE '```%')) >= 1 AS INTEGER) + CAST(len(list_filter(ls[1:40], lambda l: contains(l, '](http'))) >= 2 AS INTEGER) >= 2"""),
        ("html", "regexp_matches(t, '^(?:<!DOCTYPE|<!doctype|<html|<HTML|<[?]xml)') OR len(list_filter(tl, lambda l: regexp_matches(l, '^<(?:div|span|p|h1|h2|h3|head|body|meta|link|script|style|form|input|table|ul|ol|li|a |img|br|nav|header|footer|section|article|main|/)'))) >= 3"),
        ("sql", distinct("upper(s)", ("SELECT ", "INSERT ", "UPDATE ", "DELETE ", "CREATE TABLE", "ALTER TABLE", "DROP TABLE", "CREATE INDEX", "BEGIN", "COMMIT", "WITH ", "JOIN ", "WHERE ", "GROUP BY", "ORDER BY", "HAVING")) + " >= 2"),
        ("dockerfile", some("FROM ") + " AND " + " + ".join(f"CAST({some(k + ' ')} AS INTEGER)" for k in ("FROM", "RUN", "COPY", "ADD", "CMD", "ENTRYPOINT", "EXPOSE", "ENV", "WORKDIR", "ARG", "LABEL", "USER", "VOLUME", "HEALTHCHECK")) + " >= 3"),
        ("terraform", distinct("s", ('resource "', 'variable "', 'output "', 'data "', 'module "', 'provider "', "terraform {", "locals {")) + " >= 2"),
        ("env", "env_all >= 2 AND env_pairs >= 2 AND env_pairs / env_all >= 0.6"),
        ("csv", "len(ls) >= 2 AND commas[1] >= 2 AND len(list_filter(commas[1:10], lambda n: n = commas[1])) >= 3"),
    ]
    fence = r"list_filter(list_transform(tl[1:5], lambda l: CASE WHEN l LIKE '```%' THEN " + trim("regexp_replace(l, '^`+', '')") + " END), lambda x: x <> '')[1]"
    head = "array_to_string(ls[1:20], chr(10))"
    both = lambda a, b: f"contains(h, '{a}') AND contains(h, '{b}')"
    code = f"""WHEN fence IS NOT NULL THEN 'code/' || fence WHEN {both('fn ', 'let ')} THEN 'code/rust' WHEN {both('def ', 'import ')} THEN 'code/python' WHEN contains(h, 'function') OR {both('const ', '=>')} THEN 'code/typescript'
      WHEN {both('func ', 'package ')} THEN 'code/go' WHEN contains(h, 'public class') OR contains(h, 'import java') THEN 'code/java' WHEN contains(h, '#include') OR contains(h, 'int main(') THEN 'code/c'"""
    case = " ".join(f"WHEN {test} THEN '{label}'" for label, test in rules)
    return f"""
WITH a AS (SELECT {keys}, coalesce({text}, '') AS x FROM {table}),
b0 AS (SELECT *, CASE WHEN strlen(x) <= 8192 THEN x ELSE left(x, 8192) END AS y FROM a),
b1 AS (SELECT * EXCLUDE (x, y), CASE WHEN strlen(y) <= 8192 THEN y ELSE decode(encode(y)[1:8192 - (CASE WHEN hex(encode(y)[8193:8193]) BETWEEN '80' AND 'BF' THEN
   CASE WHEN hex(encode(y)[8192:8192]) >= 'C0' THEN 1 WHEN hex(encode(y)[8191:8191]) >= 'C0' THEN 2 ELSE 3 END ELSE 0 END)]) END AS s FROM b0),
b AS (SELECT *, {trim('s')} AS t, {lines('s')} AS ls FROM b1),
c AS (SELECT *, list_transform(ls, lambda l: {trim('l')}) AS tl, list_transform(ls[1:10], lambda l: length(l) - length(replace(l, ',', ''))) AS commas FROM b),
d AS (SELECT *, {head} AS h, {fence} AS fence, len(list_filter(tl, lambda l: l <> '' AND l NOT LIKE '#%')) AS env_all,
      len(list_filter(tl, lambda l: regexp_matches(l, '^(?:export{w}+)?[A-Z][A-Z0-9_]+='))) AS env_pairs FROM c)
SELECT {keys}, CASE {case} {code} WHEN regexp_matches(s, '\\x1b\\[[\\d;]*[mGKHF]') THEN 'log' ELSE 'text' END AS label FROM d
"""


def _forced() -> str:
    names = {"diff": "git-diff", "LOGS": "log", "yml": "yaml", "py": "code/python", "tsc": "build/typescript", "lint": "build/eslint", "xml": "html", "hcl": "terraform", "docker": "dockerfile", "trace": "trace/javascript", "nonsense": "text", "force_diff": "git-diff"}
    values = ", ".join(f"('{k}', '{v}')" for k, v in names.items())
    return f"SELECT doc_id, forced, label FROM documents, (VALUES {values}) AS v(forced, label)"


def _discover() -> str:
    rates = " ".join(f"WHEN '{k}' THEN {v}" for k, v in SAVINGS_RATE.items())
    found = _detect("(SELECT *, text AS t0 FROM conversations WHERE role = 'user' AND strlen(text) >= 300)", "conv_id, turn, t0", "text")
    return f"""
WITH m AS ({found}),
n AS (SELECT label, {_SIMPLE('t0')} AS est_tokens FROM m WHERE label <> 'text'),
o AS (SELECT label, est_tokens, CAST(round(est_tokens * CAST(CASE split_part(label, '/', 1) {rates} END AS DOUBLE)) AS BIGINT) AS est_savings FROM n)
SELECT *, CAST(CASE WHEN est_tokens > 0 THEN round(est_savings / est_tokens * 100) ELSE 0 END AS BIGINT) AS percent FROM (
SELECT label, CAST(grouping(label) AS INTEGER) AS is_total, count(*) AS messages, CAST(coalesce(sum(est_tokens), 0) AS BIGINT) AS est_tokens, CAST(coalesce(sum(est_savings), 0) AS BIGINT) AS est_savings FROM o GROUP BY ROLLUP (label))
"""


def _discover_summary() -> str:
    found = _detect("(SELECT * FROM conversations WHERE role = 'user' AND strlen(text) >= 300)", "conv_id, turn", "text")
    return f"WITH m AS ({found}) SELECT (SELECT count(DISTINCT conv_id) FROM conversations WHERE role = 'user') AS sessions, count(*) AS messages, count(*) FILTER (label <> 'text') AS optimizable FROM m"


# ---- cleaners ----
def _csv(aggressive: bool, table: str = "documents", key: str = "doc_id") -> str:
    k = 3 if aggressive else 5
    cell = trim("c")
    cut = f"list_transform(out, lambda r: array_to_string(list_transform(string_split(r, ','), lambda c: CASE WHEN strlen({cell}) > 50 THEN decode(encode({cell})[1:47 - (CASE WHEN hex(encode({cell})[48:48]) BETWEEN '80' AND 'BF' THEN CASE WHEN hex(encode({cell})[47:47]) >= 'C0' THEN 1 WHEN hex(encode({cell})[46:46]) >= 'C0' THEN 2 ELSE 3 END ELSE 0 END)]) || '...' ELSE {cell} END), ','))"
    return f"""
WITH a AS (SELECT {key}, text, {lines('text')} AS ls FROM {table}),
b AS (SELECT {key}, text, len(ls) AS n, list_concat(ls[1:{k + 1}], CASE WHEN len(ls) - 1 > {k} THEN ['... [' || (len(ls) - 1 - {k}) || ' more rows]'] ELSE [] END) AS out FROM a)
SELECT {key}, CASE WHEN n = 0 THEN text ELSE array_to_string({cut if aggressive else 'out'}, chr(10)) END AS cleaned FROM b
"""


def _squeeze(rows: str, most: int) -> str:
    """Rows of a list with at most `most` blank ones in a run."""
    blank = " AND ".join(f"coalesce({rows}[i - {k}], 'x') = ''" for k in range(most + 1))
    return f"list_transform(list_filter(generate_series(1, len({rows})), lambda i: NOT ({blank})), lambda i: {rows}[i])"


def _html(aggressive: bool, table: str = "pages", key: str = "page_id", text: str = "html") -> str:
    s = text
    for p in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->", "<head[^>]*>.*?</head>", "<svg[^>]*>.*?</svg>", "<noscript[^>]*>.*?</noscript>"):
        s = f"regexp_replace({s}, '(?si){p}', '', 'g')"
    if aggressive:
        line = trim("regexp_replace(l, '<[^>]+>', ' ', 'g')")
        for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
            line = f"replace({line}, '{a}', '{b}')"
    else:
        tags = "div|span|section|nav|footer|header|aside|main|article|figure|figcaption|picture|source|meta|link|br|hr|input|button|form|label|fieldset|legend|template|slot|iframe|embed|object|details|summary"
        line = f"regexp_replace(l, '(?i)</?(?:{tags})(?:\\s[^>]*)?>', '', 'g')"
        line = f"""regexp_replace({line}, '\\s+(?:class|style|id|data-[\\w-]+|aria-[\\w-]+|role|tabindex|onclick|onload|onchange|onsubmit)\\s*=\\s*"[^"]*"', '', 'g')"""
        line = trim(f"regexp_replace({line}, '(<[a-zA-Z][a-zA-Z0-9]*)\\s+[^>]*(>)', '\\1\\2', 'g')")
    return f"""
WITH a AS (SELECT {key}, {s} AS s FROM {table}),
b AS (SELECT {key}, list_transform({lines('s')}, lambda l: {trim('l')}) AS ls FROM a),
c AS (SELECT {key}, list_filter(list_transform(ls, lambda l: CASE WHEN l = '' THEN chr(1) ELSE {line} END), lambda l: l <> '') AS ls FROM b),
d AS (SELECT {key}, list_transform(ls, lambda l: CASE WHEN l = chr(1) OR {trim('l')} = '' THEN '' ELSE l END) AS ls FROM c)
SELECT {key}, array_to_string({_squeeze('ls', 1)}, chr(10)) AS cleaned FROM d
"""


def _fold(keys: str, rows: str, key: str, keep: int, note: str) -> str:
    """Gaps and islands over lines (keys, i, line, k): the first lines of an island of equal, non-blank k, then how many more there were."""
    return f"""
p AS ({rows}),
q AS (SELECT *, CASE WHEN {trim('k')} <> '' AND k = lag(k) OVER (PARTITION BY {keys} ORDER BY i) THEN 0 ELSE 1 END AS new FROM p),
r AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY i ROWS UNBOUNDED PRECEDING) AS island FROM q),
u AS (SELECT *, row_number() OVER (PARTITION BY {keys}, island ORDER BY i) AS n, count(*) OVER (PARTITION BY {keys}, island) AS size FROM r),
v AS (SELECT {keys}, i, line FROM u WHERE n <= {keep} UNION ALL SELECT {keys}, i, {note} FROM u WHERE n = {keep} + 1)"""


def _log() -> str:
    k = "line"
    for p, name in ((r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?", "TS"), (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "UUID"),
                    (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b", "IP"), (r"\b0x[0-9a-fA-F]{4,}\b", "ADDR"), (r"\b\d{4,}\b", "NUM")):
        k = f"regexp_replace({k}, '{p}', '{name}', 'g')"
    rows = f"SELECT doc_id, i, line, {k} AS k FROM a WHERE NOT starts_with(line, chr(13)) AND NOT regexp_matches(line, '\\r[^\\n]|\\[=*[=> ]*\\]\\s*\\d+%|\\d+%\\s*\\[')"
    return f"""
WITH a0 AS (SELECT doc_id, {lines('text')} AS ls FROM documents), a AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM a0),
{_fold('doc_id', rows, 'k', 2, "'  [... ' || (size - 2) || ' identical lines suppressed]'")}
SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS cleaned FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id
"""


def _plain(table: str, keys: str) -> str:
    end = f"regexp_replace(line, '{WS}+$', '')"
    rows = f"SELECT {keys}, i, line, line AS k FROM g"
    return f"""
WITH a0 AS (SELECT {keys}, {lines('text')} AS ls FROM {table}), a1 AS (SELECT {keys}, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM a0),
a AS (SELECT {keys}, i, {end} AS line FROM a1),
f AS (SELECT * FROM a WHERE NOT (line <> '' AND regexp_matches({trim('line')}, '^[-=+|_* ]{{3,}}$')) AND NOT starts_with(line, '> >') AND NOT starts_with(line, '>>>')),
g0 AS (SELECT *, lag(line, 1) OVER w AS l1, lag(line, 2) OVER w AS l2 FROM f WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
g AS (SELECT {keys}, i, line FROM g0 WHERE NOT (line = '' AND l1 IS NOT NULL AND l1 = '' AND l2 IS NOT NULL AND l2 = '')),
{_fold(keys, rows, 'k', 2, "'  [... ' || (size - 2) || ' identical lines]'")},
z AS (SELECT *, min(CASE WHEN line <> '' THEN i END) OVER (PARTITION BY {keys}) AS lo, max(CASE WHEN line <> '' THEN i END) OVER (PARTITION BY {keys}) AS hi FROM v)
SELECT {keys}, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i BETWEEN lo AND hi), '') AS cleaned FROM {table} LEFT JOIN z USING ({keys}) GROUP BY {keys}
"""


def _markdown() -> str:
    """Aggressive: a side section hides its lines up to the next heading of its level or above, so a line is hidden if some side heading before it reaches it."""
    level = lambda t: f"(length({t}) - length(regexp_replace({t}, '^#+', '')))"
    title = lambda t: trim(f"regexp_replace({t}, '^#+', '')")
    side = f"(lev[j] >= 2 AND regexp_matches(lower({title('tl[j]')}), '^(?:{'|'.join(SIDE_SECTIONS)})'))"
    ends = "len(list_filter(lev[j + 1:i], lambda k: k BETWEEN 1 AND lev[j])) > 0"
    badge = rf"(contains(tl[i], '![') AND {trim(r"regexp_replace(replace(tl[i], '\!', '!'), '\[?!\[[^\]]*\]\([^)]*\)\]?(?:\([^)]*\))?', '', 'g')")} = '')"
    return f"""
WITH a AS (SELECT doc_id, regexp_replace(text, '(?s)<!--.*?-->', '', 'g') AS s FROM documents),
b AS (SELECT doc_id, {lines('s')} AS ls FROM a),
c AS (SELECT *, list_transform(ls, lambda l: {trim('l')}) AS tl FROM b),
d AS (SELECT *, list_transform(tl, lambda t: {level('t')}) AS lev FROM c),
e AS (SELECT *, list_filter(generate_series(1, len(ls)), lambda j: {side}) AS sides FROM d),
f AS (SELECT *, list_filter(generate_series(1, len(ls)), lambda i: NOT {badge} AND len(list_filter(sides, lambda j: j <= i AND NOT {ends})) = 0) AS kept FROM e),
g AS (SELECT doc_id, list_transform(kept, lambda i: CASE WHEN lev[i] >= 3 THEN '- **' || {title('tl[i]')} || '**' WHEN tl[i] = '' THEN '' ELSE ls[i] END) AS rows FROM f)
SELECT doc_id, coalesce(array_to_string({_squeeze('rows', 1)}, chr(10)), '') AS cleaned FROM g
"""


# ---- headers and prompts ----
def _header(table: str, key: str, text: str, label: str, notes: list[str]) -> str:
    parts = ", ".join(notes)
    return f"""
WITH a AS (SELECT {key}, coalesce({text}, '') AS t FROM {table}), b AS (SELECT *, {lines('t')} AS ls FROM a)
SELECT {key}, '[' || array_to_string(list_filter(['{label}', len(ls) || ' lines', {parts}], lambda x: x IS NOT NULL), ' | ') || ']' AS header FROM b
"""


def _n(expr: str, name: str) -> str:
    return f"CASE WHEN {expr} > 0 THEN {expr} || '{name}' END"


def _notes() -> dict[str, list[str]]:
    """What a header says behind the number of lines, by label."""
    having = lambda test: f"len(list_filter(ls, lambda l: {test}))"
    has = lambda part: having(f"contains(l, '{part}')")
    bad, warn = having("regexp_matches(upper(l), 'ERROR|FATAL|PANIC')"), having("contains(upper(l), 'WARN')")
    times = lambda w: f"(len(string_split(upper(t), '{w}')) - 1)"
    columns = "len(string_split(ls[1], ','))"
    cells = f"array_to_string(list_transform(string_split(ls[1], ',')[1:5], lambda c: {trim('c')}), ', ')"
    return {
        "text": [f"'~' || {words('t')} || ' words'"],
        "csv": ["greatest(len(ls) - 1, 0) || ' rows'", f"coalesce({columns}, 0) || ' columns'", f"CASE WHEN len(ls) > 0 THEN {cells} || CASE WHEN {columns} > 5 THEN ', ...' ELSE '' END END"],
        "log": [_n(bad, " error(s)"), _n(warn, " warning(s)"), f"CASE WHEN {bad} = 0 AND {warn} = 0 THEN len(ls) || ' lines' END"],
        "sql": [*(_n(times(v), " " + v.lower()) for v in ("SELECT", "INSERT", "UPDATE", "DELETE")), "CASE WHEN contains(upper(t), 'JOIN') THEN 'JOIN detected' END", _n(times("CREATE TABLE"), " table def(s)")],
        "html": [_n(has("<form"), " form(s)"), _n(has("<input"), " input(s)"), _n(has("<script"), " script(s)"), "CASE WHEN contains(t, '<table') THEN 'contains table' END", "CASE WHEN contains(t, '<nav') OR contains(t, '<header') THEN 'has navigation' END"],
    }


def _headers() -> dict[str, str]:
    return {f"frame_{k}": _header("pages", "page_id", "html", k, v) if k == "html" else _header("documents", "doc_id", "text", k, v) for k, v in _notes().items()}


def prompt_of(template: str, label: str) -> tuple[str, str]:
    """What stands before and behind the content."""
    pick = lambda table: table.get(label, table.get(label.split("/")[0], table.get("", "")))
    form = pick(ANSWERS.get(template, ANSWERS[""]))
    return pick(ROLES) + "\n\n", f"\n\n{pick(TASKS.get(template, TASKS['']))}" + (f"\n\n{form}" if form else "")


def prompts(templates: tuple[str, ...], labels: tuple[str, ...]) -> str:
    q = lambda s: "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = []
    for i, label in enumerate(labels):
        for template in templates:
            head, tail = prompt_of(template, label)
            rows.append(f"({i}, '{label}', '{template}', {q(head)}, {q(tail)})")
    return f"SELECT doc_id, label, template, md5(head || coalesce(text, '') || tail) AS wrapped_md5 FROM documents JOIN (VALUES {', '.join(rows)}) AS v(i, label, template, head, tail) ON doc_id % {len(labels)} = i"


# ---- the whole way of a text ----
_ALL_TEXTS = "SELECT 'd' || doc_id AS id, text FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages UNION ALL SELECT 'c/' || conv_id || '/' || turn, text FROM conversations"


def _cleaned() -> str:
    """Table w: id, text, label, cleaned and both estimates of the texts that are not blank. The driver's texts are of three families; one of another would lack a cleaned form."""
    of = lambda label: f"(SELECT * FROM found WHERE label = '{label}')"
    rate = "CASE split_part(label, '/', 1) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TOKENS_PER_WORD.items()) + " END"
    return f"""
corpus AS ({_ALL_TEXTS}), filled AS (SELECT * FROM corpus WHERE {trim('text')} <> ''),
found AS MATERIALIZED (SELECT id, label, text FROM filled JOIN ({_detect('filled', 'id', 'text')}) USING (id)),
done AS MATERIALIZED (SELECT * FROM ({_csv(False, of('csv'), 'id')}) UNION ALL SELECT * FROM ({_html(False, of('html'), 'id', 'text')}) UNION ALL SELECT * FROM ({_plain(of('text'), 'id')})),
w AS (SELECT id, text, label, cleaned, {_estimate('text', rate)} AS original_tokens, {_estimate('cleaned', rate)} AS cleaned_tokens FROM found LEFT JOIN done USING (id))"""


def _by_type() -> str:
    return f"WITH {_cleaned()} SELECT split_part(label, '/', 1) AS family, count(*) AS texts, {_SUMS.split(', ', 1)[1]}, CAST(greatest(sum(original_tokens) - sum(cleaned_tokens), 0) AS BIGINT) AS saved_tokens FROM w GROUP BY family"


def _full(template: str = "review") -> str:
    """Cleaned, framed and wrapped; blank texts come out as they are."""
    q = lambda x: "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    framed = " UNION ALL ".join(f"SELECT * FROM ({_header(f"(SELECT id, cleaned FROM w WHERE label = '{k}')", 'id', 'cleaned', k, _notes()[k])})" for k in ("csv", "html", "text"))
    forms = " ".join(f"WHEN '{k}' THEN {q(prompt_of(template, k)[0])} || header || chr(10) || cleaned || {q(prompt_of(template, k)[1])}" for k in ("csv", "html", "text"))
    return f"""WITH {_cleaned()}, framed AS ({framed}),
p AS (SELECT *, {_PERCENT} AS p FROM w LEFT JOIN framed USING (id))
SELECT c.id, label, md5(CASE WHEN label IS NULL THEN c.text ELSE CASE label {forms} END END) AS output_md5, original_tokens, cleaned_tokens, CASE WHEN label IS NOT NULL THEN {_LABEL} END AS savings_label
FROM corpus c LEFT JOIN p USING (id)"""


def build() -> dict[str, str]:
    return {
        **{k: RUNS + v for k, v in LEDGER.items()},
        "token_estimate_documents": f"SELECT doc_id, {_estimate('text', 1.15)} AS est_tokens, {_SIMPLE('text')} AS simple_tokens FROM documents",
        "token_estimate_pages": f"SELECT page_id, {_estimate('html', 1.2)} AS est_tokens FROM pages",
        "detect_documents": _detect("documents", "doc_id", "text"), "detect_conversations": _detect("conversations", "conv_id, turn", "text"), "detect_pages": _detect("pages", "page_id", "html"),
        "detect_events_props": _detect("events", "event_id", "props"), "detect_forced": _forced(), "discover_conversations": _discover(), "discover_summary": _discover_summary(),
        "clean_csv_default": _csv(False), "clean_csv_aggressive": _csv(True), "clean_html_default": _html(False), "clean_html_aggressive": _html(True), "clean_log_dedup": _log(),
        "clean_plain": _plain("documents", "doc_id"), "clean_plain_conversations": _plain("conversations", "conv_id, turn"),
        "clean_json_props": "SELECT event_id, '{' || chr(10) || '  \"' || json_keys(props)[1] || '\": ' || (props::JSON -> json_keys(props)[1])::VARCHAR || chr(10) || '}' AS cleaned FROM events",
        **_headers(), "clean_markdown_forced": _markdown(), "pipeline_by_type": _by_type(), "pipeline_full": _full(),
    }


ORACLE_SQL = build()
