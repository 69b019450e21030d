"""Notes about a cleaned text by family, and the header that carries them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .detect import family, variant


def _note(n: Column, form: str, test: Column | None = None) -> Column:
    """form with the number in place of {}, or null where the test (n > 0) fails."""
    before, after = form.split("{}")
    return F.when(n > 0 if test is None else test, F.concat(F.lit(before), n.cast("string"), F.lit(after)))


def _flag(test: Column, text: str) -> Column:
    return F.when(test, F.lit(text))


def _contains_any(s: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | s.contains(p)
    return found


def _starting(rows: Column, *starts: str) -> Column:
    """Number of lines that begin, behind white space, with one of the texts."""
    return T.count_lines(rows, lambda x: T.starts_with_any(T.trim_start(x), starts))


def json_notes(s: Column, rows: Column) -> list[Column]:
    t = T.trim(s)
    deepest = F.coalesce(F.array_max(F.transform(rows, T.line_indent)), F.lit(0))
    objects = T.count_lines(rows, lambda x: T.trim(x).isin("{", "},"))
    return [
        F.when(t.startswith("{"), _note(T.matches(s, r'^  "[^"]+"\s*:'), "{} top-level keys")),
        _flag(t.startswith("{") & _contains_any(s, ('"error"', '"errors"', '"message"', '"status"', '"code"')), "error response"),
        F.when(t.startswith("["), _note(F.floor(objects / 2), "array of ~{} objects", objects > 1)),
        _note(F.floor(deepest / 2), "{}+ nesting depth", deepest > 12),
    ]


def yaml_notes(s: Column, rows: Column) -> Column:
    """One of five kinds of YAML, and what is counted in it."""
    kinds = F.transform(F.filter(F.transform(rows, T.trim), lambda x: x.startswith("kind:")), lambda x: F.regexp_replace(F.regexp_replace(T.trim(F.substring(x, 6, 1 << 30)), r'\A"+|"+\z', ""), r"\A'+|'+\z", ""))
    kind = F.get(F.filter(kinds, lambda x: x != ""), F.lit(0))
    second = T.count_lines(rows, lambda x: (T.line_indent(x) == 2) & T.trim(x).endswith(":") & ~T.trim(x).startswith("#"))
    jobs = T.count_lines(rows, lambda x: (T.line_indent(x) == 2) & T.trim(x).endswith(":") & ~T.trim(x).startswith("#") & ~T.trim(x).isin("on:", "jobs:", "name:", "env:"))
    top = T.count_lines(rows, lambda x: x.rlike(r"^[\p{L}\p{N}]") & x.contains(":"))
    kept = lambda *notes: F.array_compact(F.array(*notes))
    return (
        F.when(
            kind.isNotNull(),
            kept(
                F.concat(F.lit("Kubernetes "), kind), _note(_starting(rows, "- name:", "- containerPort:"), "{} container(s)"), _flag(s.contains("resources:"), "resource limits set"),
                _flag(_contains_any(s, ("livenessProbe:", "readinessProbe:")), "health probes configured"),
            ),
        )
        .when(s.contains("services:") & _contains_any(s, ("image:", "build:")), kept(F.lit("Docker Compose"), _note(second, "{} service(s)")))
        .when(s.contains("on:") & _contains_any(s, ("jobs:", "steps:")), kept(F.lit("GitHub Actions workflow"), _note(jobs, "{} job(s)")))
        .when(_contains_any(s, ("openapi:", "swagger:")), kept(F.lit("OpenAPI spec"), _note(T.count_lines(rows, lambda x: T.trim(x).startswith("/") & T.trim(x).endswith(":")), "{} endpoint(s)")))
        .otherwise(kept(_note(top, "{} top-level keys")))
    )


# Patterns of exported and of all functions, by language.
CODE_PATTERNS = {
    ("typescript", "javascript", "js", "ts"): (r"^export\s+(?:function|const|class|interface|type|enum|default)", r"(?:^|\s)(?:function|const|let|var)\s+\w+\s*[=(]"),
    ("rust",): (r"^pub\s+(?:async\s+)?fn\s+", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+"),
    ("python",): (None, r"^\s*(?:async\s+)?def\s+"),
    ("go",): (r"^[ \t]*func \p{Lu}", r"^func\s+"),
}


def code_notes(s: Column, rows: Column, language: Column) -> list[Column]:
    exported = functions = F.lit(0).cast("int")
    for names, (public, every) in CODE_PATTERNS.items():
        mine = language.isin(*names)
        exported = F.when(mine, T.matches(s, public) if public else F.lit(0)).otherwise(exported)
        functions = F.when(mine, T.matches(s, every)).otherwise(functions)

    def declares(x: Column) -> Column:
        t = T.trim_start(x)
        return T.starts_with_any(t, ("struct ", "pub struct ", "class ", "export class ", "interface ", "export interface ")) | (t.startswith("type ") & t.contains("=") & t.contains("{"))

    tests = _contains_any(s, ("#[cfg(test)]", "#[test]", "describe(", "it(", "def test_", "func Test"))
    return [_note(exported, "{} exported"), _note(functions, "{} functions"), _note(T.count_lines(rows, declares), "{} types/classes"), _flag(tests, "contains tests")]


def trace_notes(s: Column, rows: Column) -> list[Column]:
    trimmed = F.transform(rows, T.trim)
    frames = T.count_lines(trimmed, lambda t: T.starts_with_any(t, ("at ", "File ")) | t.contains(".go:") | ((F.octet_length(t) > 3) & t.rlike("^[0-9]") & t.contains(": ")))
    error = F.element_at(F.filter(trimmed, lambda t: (t != "") & ~T.starts_with_any(t, ("at ", "File ", "//")) & ~t.contains("truncated")), -1)
    cut = F.call_function("make_valid_utf8", F.substring(error.cast("binary"), 1, 77).cast("string"))
    return [_note(frames, "{} frames"), F.when(F.octet_length(error) > 80, F.concat(F.regexp_replace(cut, "�+\\z", ""), F.lit("..."))).otherwise(error)]


def diff_notes(s: Column, rows: Column) -> list[Column]:
    changed = lambda c: T.count_lines(rows, lambda x: x.startswith(c) & ~x.startswith(c * 3)).cast("string")
    return [
        _note(T.count_lines(rows, lambda x: x.startswith("diff --git")), "{} file(s)"), F.concat(F.lit("+"), changed("+"), F.lit("/-"), changed("-")),
        _flag(T.count_lines(rows, lambda x: x.startswith("rename from ") | x.contains("similarity index")) > 0, "includes renames"),
    ]


def log_notes(s: Column, rows: Column) -> list[Column]:
    upper = F.transform(rows, F.upper)
    errors, warnings = T.count_lines(upper, lambda x: x.rlike("ERROR|FATAL|PANIC")), T.count_lines(upper, lambda x: x.contains("WARN"))
    return [_note(errors, "{} error(s)"), _note(warnings, "{} warning(s)"), _note(F.size(rows), "{} lines", (errors == 0) & (warnings == 0))]


def csv_notes(s: Column, rows: Column) -> list[Column]:
    header = F.coalesce(F.get(rows, F.lit(0)), F.lit(""))
    cells = F.split(header, ",", -1)
    n = F.when(F.size(rows) == 0, F.lit(0)).otherwise(F.size(cells))
    first = F.concat(F.array_join(F.transform(F.slice(cells, 1, 5), T.trim), ", "), F.when(n > 5, ", ...").otherwise(""))
    always = F.lit(True)
    return [_note(F.greatest(F.size(rows) - 1, F.lit(0)), "{} rows", always), _note(n, "{} columns", always), F.when(F.size(rows) > 0, first)]


def sql_notes(s: Column, rows: Column) -> list[Column]:
    upper = F.upper(s)
    counts = [_note(T.occurrences(upper, v), "{} " + v.lower()) for v in ("SELECT", "INSERT", "UPDATE", "DELETE")]
    return [*counts, _flag(upper.contains("JOIN"), "JOIN detected"), _note(T.occurrences(upper, "CREATE TABLE"), "{} table def(s)")]


def docker_notes(s: Column, rows: Column) -> list[Column]:
    stages = _starting(rows, "FROM ")
    exposed = F.filter(F.transform(rows, T.trim), lambda x: x.startswith("EXPOSE "))
    ports = F.flatten(F.transform(exposed, lambda x: F.filter(F.split(F.substring(x, 8, 1 << 30), r"(?U)\s+"), lambda p: p != "")))
    return [_note(stages, "{} stages", stages > 1), F.when(F.size(exposed) > 0, F.concat(F.lit("exposes "), F.array_join(ports, ", "))), _note(_starting(rows, "RUN "), "{} RUN commands")]


def annotations(s: Column, label: Column) -> Column:
    """Notes of a cleaned text as an array."""
    return T.let(T.lines(s), lambda rows: _annotations(s, rows, label))


def _annotations(s: Column, rows: Column, label: Column) -> Column:
    """The notes, from a text and its lines."""
    kind = family(label)
    containing = lambda p: T.count_lines(rows, lambda x: x.contains(p))
    always = F.lit(True)
    notes = {
        "json": json_notes(s, rows),
        "code": code_notes(s, rows, variant(label)),
        "trace": trace_notes(s, rows),
        "git-diff": diff_notes(s, rows),
        "log": log_notes(s, rows),
        "build": [_note(containing("error"), "{} error(s)"), _note(containing("warning"), "{} warning(s)")],
        "markdown": [
            _note(T.words(s), "~{} words", always), _note(T.count_lines(rows, lambda x: x.startswith("#")), "{} sections"),
            _note(F.floor(_starting(rows, "```") / 2), "{} code blocks"),
        ],
        "text": [_note(T.words(s), "~{} words", always)],
        "html": [
            _note(containing("<form"), "{} form(s)"), _note(containing("<input"), "{} input(s)"), _note(containing("<script"), "{} script(s)"), _flag(s.contains("<table"), "contains table"),
            _flag(_contains_any(s, ("<nav", "<header")), "has navigation"),
        ],
        "sql": sql_notes(s, rows),
        "csv": csv_notes(s, rows),
        "dockerfile": docker_notes(s, rows),
        "env": [_note(T.count_lines(rows, lambda x: (T.trim(x) != "") & ~T.trim(x).startswith("#") & x.contains("=")), "{} vars", always), _note(containing("=***"), "{} secrets masked")],
        "terraform": [_note(_starting(rows, f'{word} "'), "{} " + name) for word, name in (("resource", "resources"), ("data", "data sources"), ("module", "modules"), ("variable", "variables"), ("output", "outputs"))],
    }
    case = F.when(kind == "yaml", yaml_notes(s, rows))
    for name, found in notes.items():
        case = case.when(kind == name, F.array_compact(F.array(*found)))
    return case.otherwise(F.array().cast("array<string>"))


def header(s: Column, label: Column) -> Column:
    """`[label | n lines | notes]`."""
    parts = lambda rows: F.concat(F.array(label, F.concat(F.size(rows).cast("string"), F.lit(" lines"))), _annotations(s, rows, label))
    return F.concat(F.lit("["), F.array_join(T.let(T.lines(s), parts), " | "), F.lit("]"))


def frame(s: Column, label: Column, focus: str | None = None) -> Column:
    """The text under its header, with the focus on a line of its own."""
    extra = [F.lit(f"\n[Focus: {focus}]")] if focus else []
    return F.concat(header(s, label), *extra, F.lit("\n"), s)
