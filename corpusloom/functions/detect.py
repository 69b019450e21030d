"""Classification of a text as one of fifteen families, as one CASE over its first 8 KB.

The order of the rules is part of the meaning: the first that holds wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .tables import DOCKER_SIGNS, FORCED, HTML_LINE_STARTS, SQL_SIGNS, TERRAFORM_SIGNS

# Patterns by which traces, build output and logs are known.
DIFF = r"^(diff --git|--- a/|\+\+\+ b/)"
GO_TRACE = r"^goroutine \d+ \["
JAVA_TRACE = r"^\s+at\s+[\w\.$]+\([\w]+\.java:\d+\)"
PYTHON_TRACE = r"^Traceback \(most recent call last\):"
RUST_PANIC = r"^thread '.+' panicked at"
JS_TRACE = r"^\s+at\s+(?:async\s+)?[\w.<>\[\]$]+(?:\.[\w<>\[\]$]+)*\s+\("
RUST_FRAME = r"^\s{1,6}\d+:\s+\S"
CARGO = r"(?:^ {0,3}(?:Compiling|Checking|Downloading|Downloaded|Fresh|Updating|Locking)\s|^error\[E\d+\]|^warning:\n|^(?:Finished (?:dev|release|test)|error: could not compile))"
TSC = r"\w+\.tsx?\(\d+,\d+\): (?:error|warning) TS\d+:"
ESLINT = r"^\s+\d+:\d+\s+(?:error|warning)\s+\S"
LOG = r"(?:\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}|\[(?:INFO|WARN(?:ING)?|ERROR|DEBUG|TRACE|FATAL)\]|(?:level|lvl|severity)=(?:info|warn|error|debug|trace|fatal)|^(?:INFO|WARN|ERROR|DEBUG|TRACE|FATAL)[\s:])"
ANSI = r"\x1b\[[\d;]*[mGKHF]"

#: (label, pattern, least number of matches) in order.
COUNTED = (
    ("git-diff", DIFF, 1), ("trace/go", GO_TRACE, 1), ("trace/java", JAVA_TRACE, 1), ("trace/python", PYTHON_TRACE, 1), ("trace/rust", RUST_PANIC, 1), ("trace/javascript", JS_TRACE, 2),
    ("trace/rust", RUST_FRAME, 2), ("build/cargo", CARGO, 2), ("build/typescript", TSC, 1), ("build/eslint", ESLINT, 3), ("log", LOG, 3),
)


#: For the patterns above, in order: sets of literals of which at least one must stand in the text in full, as a scan for bytes is much cheaper than a pattern.
LITERALS = (
    (("diff --git",), ("--- a/",), ("+++ b/",)), (("goroutine ",),), ((".java:",),), (("Traceback (most recent call last):",),), (("thread '", "' panicked at"),), (("at", "("),),
    ((":",),), (*((w,) for w in ("Compiling", "Checking", "Downloading", "Downloaded", "Fresh", "Updating", "Locking", "error[E", "warning:\n", "Finished ", "error: could not compile")),),
    ((": error TS",), (": warning TS",)), ((":", "error"), (":", "warning")),
    (("-", ":"), *((w,) for w in ("INFO", "WARN", "ERROR", "DEBUG", "TRACE", "FATAL", "level=", "lvl=", "severity="))),
)


def _may_have(text: Column, sets: tuple[tuple[str, ...], ...]) -> Column:
    """Whether all literals of one of the sets stand in a text."""
    found = F.lit(False)
    for literals in sets:
        every = F.lit(True)
        for part in literals:
            every = every & text.contains(part)
        found = found | every
    return found


def _distinct(text: Column, signs) -> Column:
    total = F.lit(0)
    for s in signs:
        total = total + text.contains(s).cast("int")
    return total


def is_json(trimmed: Column) -> Column:
    array = trimmed.startswith("[")
    return (trimmed.startswith("{") | array) & trimmed.contains('"') & (trimmed.contains(":") | array)


def is_yaml(s: Column, trimmed: Column) -> Column:
    def pair(t: Column) -> Column:
        return (t != "") & ~t.startswith("#") & t.contains(":") & ~T.trim(F.substring_index(t, ":", 1)).contains(" ")

    return s.startswith("---") | (T.count_lines(trimmed, pair) >= 4)


def is_markdown(rows: Column) -> Column:
    def signs(head: Column) -> Column:
        found = (
            (T.count_lines(head, lambda x: x.startswith("#")) >= 2, T.count_lines(head, lambda x: x.contains("![") & x.contains("](")) >= 1)
            + (T.count_lines(head, lambda x: x.startswith("```")) >= 1, T.count_lines(head, lambda x: x.contains("](http")) >= 2)
        )
        return sum((s.cast("int") for s in found), F.lit(0)) >= 2

    return T.let(F.slice(rows, 1, 40), signs)


def is_html(s: Column, trimmed: Column) -> Column:
    begin = T.trim_start(s)
    strong = T.starts_with_any(begin, ("<!DOCTYPE", "<!doctype", "<html", "<HTML", "<?xml"))
    pattern = "^(?:" + "|".join(HTML_LINE_STARTS) + ")"
    return strong | (T.count_lines(trimmed, lambda x: x.startswith("<") & x.rlike(pattern)) >= 3)


def is_dockerfile(trimmed: Column) -> Column:
    some = lambda k: F.exists(trimmed, lambda x: x.startswith(k))
    return some("FROM ") & (sum((some(k).cast("int") for k in DOCKER_SIGNS), F.lit(0)) >= 3)


def is_env(trimmed: Column) -> Column:
    total = T.count_lines(trimmed, lambda x: (x != "") & ~x.startswith("#"))
    pairs = T.count_lines(trimmed, lambda x: x.contains("=") & x.rlike(r"(?U)^(?:export\s+)?[A-Z][A-Z0-9_]+="))
    return (total >= 2) & (pairs >= 2) & (pairs / total >= 0.6)


def is_csv(rows: Column) -> Column:
    def alike(fields: Column) -> Column:
        first = F.get(fields, F.lit(0))
        return (F.size(fields) >= 2) & (first >= 3) & (F.size(F.filter(fields, lambda n: n == first)) >= 3)

    return T.let(F.transform(F.slice(rows, 1, 10), lambda x: T.occurrences(x, ",") + 1), alike)


def code_language(rows: Column) -> Column:
    """Tag of a fence among the first five lines, else by words of the first twenty; null if it is no code."""
    fence = F.filter(F.transform(F.slice(rows, 1, 5), T.trim), lambda x: x.startswith("```") & (T.trim(F.regexp_replace(x, r"\A`+", "")) != ""))
    tag = T.trim(F.regexp_replace(F.get(fence, F.lit(0)), r"\A`+", ""))

    def by_words(head: Column) -> Column:
        both = lambda a, b: head.contains(a) & head.contains(b)
        return (
            F.when(both("fn ", "let "), "rust")
            .when(both("def ", "import "), "python")
            .when(head.contains("function") | both("const ", "=>"), "typescript")
            .when(both("func ", "package "), "go")
            .when(head.contains("public class") | head.contains("import java"), "java")
            .when(head.contains("#include") | head.contains("int main("), "c")
        )

    return F.coalesce(tag, T.let(F.array_join(F.slice(rows, 1, 20), "\n"), by_words))


def detect(text: Column, force_type: str | None = None, force_diff: bool = False) -> Column:
    """Label of a text: a family, with the language or tool behind a slash where there is one. Null texts are empty ones."""
    if force_diff:
        return F.lit("git-diff")
    if force_type is not None:
        return F.lit(FORCED.get(force_type.lower(), "text"))
    return T.let(T.sample(F.coalesce(text, F.lit(""))), lambda s: T.let(T.lines(s), lambda rows: _rules(s, rows)))


def _rules(s: Column, rows: Column) -> Column:
    """The rules over the sample and its lines. Those that look at trimmed lines stand together, so that lines are trimmed once."""
    head = F
    for (label, p, n), literals in zip(COUNTED, LITERALS, strict=True):
        head = head.when(_may_have(s, literals) & (T.has(s, p) if n == 1 else T.matches(s, p) >= n), F.lit(label))
    head = head.when(T.let(T.trim(s), is_json), F.lit("json"))
    return head.otherwise(T.let(F.transform(rows, T.trim), lambda lines: _line_rules(s, rows, lines)))


def _line_rules(s: Column, rows: Column, trimmed: Column) -> Column:
    case = F
    for test, label in (
        (is_yaml(s, trimmed), F.lit("yaml")),
        (is_markdown(rows), F.lit("markdown")),
        (is_html(s, trimmed), F.lit("html")),
        (T.let(F.upper(s), lambda x: _distinct(x, SQL_SIGNS) >= 2), F.lit("sql")),
        (is_dockerfile(trimmed), F.lit("dockerfile")),
        (_distinct(s, TERRAFORM_SIGNS) >= 2, F.lit("terraform")),
        (is_env(trimmed), F.lit("env")),
        (is_csv(rows), F.lit("csv")),
    ):
        case = case.when(test, label)
    rest = F.when(s.contains("\x1b") & T.has(s, ANSI), "log").otherwise("text")
    return case.otherwise(T.let(code_language(rows), lambda language: F.when(language.isNotNull(), F.concat(F.lit("code/"), language)).otherwise(rest)))


def family(label: Column) -> Column:
    return F.substring_index(label, "/", 1)


def variant(label: Column) -> Column:
    """What stands behind the slash, or the empty text."""
    return F.when(label.contains("/"), F.regexp_replace(label, r"\A[^/]*/", "")).otherwise("")
