"""Cleaners whose rules depend on the lines before: pure functions from text to text.

They hold no Spark code, so they can be tested alone; the dispatcher in `clean` runs them over
Arrow batches. Cuts by bytes fall on character borders."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

from ..functions.tables import (
    ACCESSOR_LANGUAGES, ATTRIBUTE_MARKS, HASH_LANGUAGES, IMPORT_WORDS, JAVA_INTERNAL, JSON_ERROR_KEYS, JSON_ID_KEYS, JSON_NOISE_KEYS, RUST_INTERNAL, SIDE_SECTIONS, SLASH_LANGUAGES, SQL_WORDS,
    YAML_DEFAULTS, YAML_DOC_KEYS,
)
from ..functions.text import SPACE


def lines(s: str) -> list[str]:
    rows = s.split("\n")
    if rows[-1] == "":
        rows.pop()
    return [r[:-1] if r.endswith("\r") else r for r in rows]


def strip(s: str) -> str:
    return s.strip(SPACE)


def indent_of(line: str) -> int:
    return len(line.encode()) - len(line.lstrip(SPACE).encode())


def head_bytes(s: str, n: int) -> str:
    return s.encode()[:n].decode("utf-8", "ignore")


def size(s: str) -> int:
    return len(s.encode())


def squeeze(rows: Iterable[str], most: int) -> Iterator[str]:
    """Blank lines are emptied, and at most `most` of a run stay."""
    for blank, run in groupby(rows, lambda r: not strip(r)):
        if blank:
            yield from [""] * min(most, sum(1 for _ in run))
        else:
            yield from run


def even(n: int) -> int:
    return n + n % 2


def quoted_cut(line: str, comment: str, quotes: str, allowed: Callable[[int], bool] = lambda i: True) -> str:
    """The line up to the first comment mark outside quotes. comment is a pattern; an unclosed quote runs to the end."""
    pattern = "|".join([*(rf"{q}(?:\\.|[^\\{q}])*(?:{q}|\\?\Z)" for q in quotes), f"(?P<mark>{comment})"])
    for m in re.finditer(pattern, line, re.S):
        if m.lastgroup == "mark" and allowed(m.start()):
            return line[: m.start()].rstrip(SPACE)
    return line


# ---- stack traces ------------------------------------------------------------------------------

# Patterns of frames and paths.
_PYTHON_FRAME = re.compile(r'^\s+File ".+", line \d+, in .+$')
_LONG_PATH = re.compile(r"(?:[A-Za-z]:[/\\]|/)(?:[^/\\():\s]+[/\\]){3,}")


@dataclass(frozen=True)
class Trace:
    """How frames of a language are known and how many stay, by default and in aggressive mode."""

    frame: Callable[[str], bool]
    limits: tuple[int, int]
    marker: str | None
    opens: Callable[[str], bool] = lambda line: False
    anywhere: bool = True  # frames count outside an opened block too
    internal: tuple[str, ...] = ()
    shorten: bool = False

    def clean(self, s: str, aggressive: bool) -> str:
        out, limit = [], self.limits[aggressive]
        inside, seen = self.anywhere, 0
        for line in lines(s):
            if self.opens(line):
                inside, seen = True, 0
            elif inside and self.frame(line):
                if any(p in line for p in self.internal):
                    continue
                seen += 1
                if seen > limit:
                    if seen == limit + 1 and self.marker:
                        out.append(self.marker)
                    continue
                if self.shorten:
                    line = _LONG_PATH.sub(".../", line)
            elif not strip(line):
                inside, seen = self.anywhere, 0
            out.append(line)
        return "\n".join(out)


def _go_frame(line: str) -> bool:
    t = strip(line)
    return t.endswith(")") or ".go:" in t


TRACES = {
    "javascript": Trace(re.compile(r"^\s+at\s+.+$").search, (12, 5), "    ... [frames truncated]", shorten=True),
    "rust": Trace(re.compile(r"^\s+\d+:\s+.+$").search, (15, 8), "   ... [backtrace truncated]", lambda x: strip(x).startswith(("stack backtrace:", "thread '")), False, RUST_INTERNAL),
    "go": Trace(_go_frame, (10, 5), None, re.compile(r"^goroutine \d+ \[").search, False),
    "java": Trace(re.compile(r"^\s+at\s+[\w.$]+\(\w+\.java:\d+\)$").search, (15, 8), "\t... [frames truncated]", lambda x: strip(x).startswith(("Caused by:", "Exception in thread")), True, JAVA_INTERNAL),
}


def python_trace(s: str, aggressive: bool) -> str:
    """Each traceback keeps its first frames with their source lines; blank lines between frames go."""
    limit, out = (5 if aggressive else 10), []
    inside, seen, source = False, 0, False
    for line in lines(s):
        if strip(line).startswith("Traceback (most recent call last):"):
            inside, seen, source = True, 0, False
        elif inside and _PYTHON_FRAME.search(line):
            seen, source = seen + 1, True
            if seen > limit:
                if seen == limit + 1:
                    out.append("  ... [frames truncated]")
                continue
        elif inside and source:
            source = False
            if seen > limit:
                continue
        elif inside:
            if not strip(line):
                continue
            inside = False
        out.append(line)
    return "\n".join(out)


def stack_trace(s: str, variant: str, aggressive: bool) -> str:
    return python_trace(s, aggressive) if variant == "python" else TRACES.get(variant, TRACES["javascript"]).clean(s, aggressive)


# ---- diffs -------------------------------------------------------------------------------------

# Patterns of diffs.
_DIFF_HEADER = re.compile(r"^(?:diff --git|--- |\+\+\+ |index |Binary files)")
_HUNK = re.compile(r"^@@ .+ @@")


def git_diff(s: str, variant: str, aggressive: bool) -> str:
    """Context lines stay near changes only, where at least three would go; hunks without a change lose their context."""
    keep = 1 if aggressive else 2
    in_hunk = False
    kinds: list[tuple[str, str]] = []  # kind of each line: c(ontext), +, b(order)
    for line in lines(s):
        if _DIFF_HEADER.search(line):
            in_hunk, kind = False, "b"
        elif _HUNK.search(line):
            in_hunk, kind = True, "b"
        elif not in_hunk:
            kind = "o"
        else:
            kind = "+" if line[:1] in ("+", "-") and line else "c" if line[:1] == " " else "b"
        kinds.append((kind, line))
    runs = [(k, [x for _, x in g]) for k, g in groupby(kinds, lambda p: p[0])]
    out: list[str] = []
    changed = False
    for i, (kind, rows) in enumerate(runs):
        if kind == "c":
            before_change = i + 1 < len(runs) and runs[i + 1][0] == "+"
            gone = len(rows) - keep
            if before_change:
                rows = [f" ... [{gone} context lines omitted]", *rows[gone:]] if gone >= 3 else rows
            elif changed:
                rows = [*rows[:keep], f" ... [{gone} context lines omitted]"] if gone >= 3 else rows
            else:
                rows = []
        elif kind == "+":
            changed = True
        elif kind == "b":
            changed = False
        out += rows
    return "\n".join(out)


# ---- logs and plain text -----------------------------------------------------------------------

# What is put in place of the parts of a log line that vary, in this order.
VARYING = (
    (re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?"), "TS"),
    (re.compile(r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"), "UUID"),
    (re.compile(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?\b"), "IP"),
    (re.compile(r"\b0x[0-9a-fA-F]{4,}\b"), "ADDR"),
    (re.compile(r"\b\d{4,}\b"), "NUM"),
)
PROGRESS = re.compile(r"\r[^\n]|\[=*[=> ]*\]\s*\d+%|\d+%\s*\[")


def normal_log_line(line: str) -> str:
    for pattern, name in VARYING:
        line = pattern.sub(name, line)
    return line


def _fold(rows: Iterable[str], key: Callable[[str], str], keep: int, note: str) -> Iterator[str]:
    """Runs of lines with one key keep their first lines and a note; blank lines never fold."""
    for k, run in groupby(rows, key):
        run = list(run)
        if not strip(k) or len(run) <= keep:
            yield from run
        else:
            yield from run[:keep]
            yield note.format(len(run) - keep)


def log(s: str, variant: str, aggressive: bool) -> str:
    rows = (r for r in lines(s) if not r.startswith("\r") and not PROGRESS.search(r))
    return "\n".join(_fold(rows, normal_log_line, 1 if aggressive else 2, "  [... {} identical lines suppressed]"))


_BORDER = re.compile(r"[-=+|_* ]{3,}")


def plain(s: str, variant: str = "", aggressive: bool = False) -> str:
    rows = [r.rstrip(SPACE) for r in lines(s)]
    rows = [r for r in rows if not (r and _BORDER.fullmatch(strip(r))) and not r.startswith(("> >", ">>>"))]
    out = list(_fold(squeeze(rows, 2), lambda r: r, 2, "  [... {} identical lines]"))
    first = next((i for i, r in enumerate(out) if r), len(out))
    last = next((i for i in range(len(out), first, -1) if out[i - 1]), first)
    return "\n".join(out[first:last])


# ---- JSON --------------------------------------------------------------------------------------


def _whole(text: str) -> int | float:
    n = int(text)
    return n if -(2**63) <= n < 2**64 else float(n)


def _refuse(name: str):
    raise ValueError(name)


def _decimal(x: float) -> str:
    """Shortest form of a double: plain for exponents from -5 to 15, else with an exponent without sign and zeros."""
    if x == 0:
        return "-0.0" if math.copysign(1, x) < 0 else "0.0"
    mantissa, _, exponent = f"{x!r}".lower().partition("e")
    sign = "-" if mantissa.startswith("-") else ""
    whole, _, part = mantissa.lstrip("-").partition(".")
    digits = (whole + part).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + part) - len(digits))
    digits = digits.rstrip("0") or "0"
    if -5 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    if 0 < point <= 16:
        return f"{sign}{digits[:point].ljust(point, '0')}.{digits[point:] or '0'}"
    return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{point - 1}"


def pretty(v, depth: int = 0) -> str:
    """JSON with sorted keys and an indent of two."""
    pad, end = "  " * (depth + 1), "  " * depth
    if isinstance(v, dict) and v:
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {pretty(v[k], depth + 1)}" for k in sorted(v, key=str.encode)) + f"\n{end}}}"
    if isinstance(v, list) and v:
        return "[\n" + ",\n".join(pad + pretty(x, depth + 1) for x in v) + f"\n{end}]"
    if isinstance(v, float):
        return _decimal(v)
    return json.dumps(v, ensure_ascii=False)


def _deep(v, change: Callable):
    """change applied to every value from the leaves up."""
    if isinstance(v, dict):
        v = {k: _deep(x, change) for k, x in v.items()}
    elif isinstance(v, list):
        v = [_deep(x, change) for x in v]
    return change(v)


def json_errors(v):
    if isinstance(v, dict) and v.keys() & JSON_ERROR_KEYS:
        kept = {k: x for k, x in v.items() if k in JSON_ERROR_KEYS or k in JSON_ID_KEYS}
        if len(kept) < len(v):
            kept["_omitted"] = f"{len(v) - len(kept)} non-error fields omitted"
        return kept
    return v


def json_prune(v):
    """Without null and empty members; a member that pruning empties stays."""
    if isinstance(v, dict):
        return {k: json_prune(x) for k, x in v.items() if x is not None and x != [] and x != {}}
    return [json_prune(x) for x in v] if isinstance(v, list) else v


def json_repeats(v, keep: int):
    if isinstance(v, list):
        alike = len(v) > keep + 1 and all(isinstance(x, dict) for x in v) and len({frozenset(x) for x in v}) == 1
        if alike:
            return [json_repeats(x, keep) for x in v[:keep]] + [f"... {len(v) - keep} more objects with same structure"]
        return [json_repeats(x, keep) for x in v]
    return {k: json_repeats(x, keep) for k, x in v.items()} if isinstance(v, dict) else v


def _chain(v):
    if isinstance(v, dict) and len(v) == 1:
        ((k, inner),) = v.items()
        if isinstance(inner, dict) and len(inner) == 1:
            ((k2, leaf),) = inner.items()
            return {f"{k}.{k2}": leaf}
    return v


def _short(v):
    return f"{head_bytes(v, 100)}...[{size(v)} chars]" if isinstance(v, str) and size(v) > 200 else v


def _two_places(v):
    return math.copysign(math.floor(abs(v) * 100 + 0.5) / 100, v) if isinstance(v, float) and math.isfinite(v) and v != int(v) else v


def json_text(s: str, variant: str, aggressive: bool) -> str:
    try:
        v = json.loads(s, parse_int=_whole, parse_constant=_refuse)
        v = json_prune(json_errors(v))
        if aggressive:
            v = _deep(v, lambda x: {k: y for k, y in x.items() if k not in JSON_NOISE_KEYS} if isinstance(x, dict) else x)
        v = _deep(v, _short)
        v = _deep(v, _two_places) if aggressive else v
        return pretty(_deep(json_repeats(v, 1 if aggressive else 2), _chain))
    except (ValueError, RecursionError, OverflowError):
        return plain(s)


# ---- YAML and Terraform ------------------------------------------------------------------------

_YAML_DOC = re.compile("(?:" + "|".join(map(re.escape, YAML_DOC_KEYS)) + r")(?: ?:.*)?\Z", re.S)
_YAML_DEFAULT = re.compile("|".join(rf"{re.escape(k)}: (?:{v}|\"{v}\"|'{v}')" for k, v in YAML_DEFAULTS))


def _after_colon(t: str) -> str:
    return strip(t.partition(":")[2])


def yaml(s: str, variant: str, aggressive: bool) -> str:
    rows = [(strip(r), indent_of(r)) for r in lines(s)]
    out: list[str] = []
    blanks, i = 0, 0

    def deeper(i: int, than: int) -> int:
        while i < len(rows) and (not rows[i][0] or rows[i][1] > than):
            i += 1
        return i

    while i < len(rows):
        t, depth = rows[i]
        i += 1
        if t.startswith("#"):
            continue
        if not t:
            blanks += 1
            if blanks == 1:
                out.append("")
            continue
        blanks = 0
        t = quoted_cut(t, "#", "\"'", lambda at, t=t: at > 0 and t[at - 1] == " ")
        if _YAML_DOC.match(t):
            if _after_colon(t) in ("|", ">", ""):
                i = deeper(i, depth)
            continue
        if aggressive and depth == 0 and t == "status:":
            out.append("status: # [omitted]")
            i = deeper(i, 0)
            continue
        if aggressive and "&" not in t and _YAML_DEFAULT.fullmatch(t):
            continue
        out.append(" " * even(depth) + t)
        if _after_colon(t) in ("|", ">", "|+", ">-"):
            end = deeper(i, depth)
            out += [" " * even(d) + x for x, d in rows[i : min(end, i + 3)]]
            if end - i > 3:
                out.append(" " * even(depth + 2) + f"# ... [{end - i - 3} more lines]")
            i = end
    return "\n".join(out)


def _balance(t: str) -> int:
    return sum((c in "{[") - (c in "}]") for c in t)


def terraform(s: str, variant: str, aggressive: bool) -> str:
    out: list[str] = []
    blanks, open_default = 0, 0
    for r in lines(s):
        t, depth = strip(r), indent_of(r)
        if not t:
            blanks += 1
            if blanks == 1:
                out.append("")
            continue
        blanks = 0
        if open_default > 0:
            open_default += _balance(t)
            continue
        if t.startswith(("#", "//")):
            continue
        t = quoted_cut(t, "#|//", '"')
        if aggressive and strip(t).startswith("default") and "{" in t and _balance(t) > 0:
            open_default = _balance(t)
            out.append(" " * depth + "default = { ... }")
        elif not strip(t).startswith("description"):
            out.append(" " * even(depth) + strip(t))
    return "\n".join(out)


# ---- code --------------------------------------------------------------------------------------

_ACCESSOR = re.compile(r"(?i)^\s+(?:public\s+|private\s+|protected\s+)?(?:get|set)\s+\w+\s*\(")
_ACCESSOR_NAME = re.compile(r"(?i)(?:get|set)\s+(\w+)\s*\(")


def _without_doc_blocks(rows: Iterable[str]) -> Iterator[str]:
    inside = False
    for r in rows:
        t = strip(r)
        if inside:
            inside = "*/" not in t
        elif t.startswith(("/**", "/*!")):
            inside = not (t.endswith("*/") and size(t) > 4)
        else:
            yield r


def _whole_line_comment(language: str) -> Callable[[str], bool]:
    marks = {"rust": ("///", "//!"), "python": ("#",)}.get(language, ("//",) if language in SLASH_LANGUAGES else None)
    return (lambda r: strip(r).startswith(marks)) if marks else (lambda r: False)


def _without_trailing_comment(r: str, mark: str) -> str:
    t = strip(r)
    return r if not t or t.startswith(mark) else quoted_cut(r, re.escape(mark), "\"'`")


def _list_of(names: list[str], total: int) -> str:
    return ", ".join(names[:4]) + (", ..." if total > 4 else "")


def fold_imports(rows: Iterable[str], language: str) -> Iterator[str]:
    words = IMPORT_WORDS.get(language)
    if not words:
        yield from rows
        return
    for imports, run in groupby(rows, lambda r: r.lstrip(SPACE).startswith(words)):
        run = list(run)
        if not imports or len(run) < 3:
            yield from run
            continue
        names = []
        for r in run[:4]:
            r = r.lstrip(SPACE)
            rest = r[len(next(w for w in words if r.startswith(w))) :]
            names.append(re.match(r"[\w:]*", rest).group())
        yield f"// [{len(run)} imports: {_list_of([n for n in names if n], len(run))}]"


def _block_end(rows: list[str], at: int, begun: Callable[[str], bool] = lambda r: True) -> int:
    """The line behind the braces that open at or after a line; begun tells from which line on they may end it."""
    depth, started = 0, False
    while at < len(rows):
        started = started or begun(rows[at])
        depth += rows[at].count("{") - rows[at].count("}")
        at += 1
        if started and depth <= 0:
            break
    return at if started else -1


def without_test_modules(rows: list[str]) -> list[str]:
    out, i = [], 0
    while i < len(rows):
        if strip(rows[i]) == "#[cfg(test)]":
            end = _block_end(rows, i + 1, lambda r: strip(r).startswith("mod "))
            if end > 0:
                out.append(" " * indent_of(rows[i]) + "// [test module omitted]")
                i = end
                continue
        out.append(rows[i])
        i += 1
    return out


def fold_accessors(rows: list[str]) -> list[str]:
    """Three and more accessors in a row become a note; fewer stay as they are."""
    out, held, names, i = [], [], [], 0

    def flush() -> None:
        if len(names) >= 3:
            out.append(f"  // [{len(names)} getters/setters: {_list_of(names, len(names))}]")
        else:
            out.extend(held)
        held.clear()
        names.clear()

    while i < len(rows):
        if _ACCESSOR.search(rows[i]):
            name = _ACCESSOR_NAME.search(rows[i]).group(1).lower()
            names += [name] if name not in names else []
            end = _block_end(rows, i)
            held += rows[i:end]
            i = end
        else:
            flush()
            out.append(rows[i])
            i += 1
    flush()
    return out


def code(s: str, variant: str, aggressive: bool) -> str:
    body, language = strip(s), variant
    if body.startswith("```"):
        first, _, rest = body.partition("\n")
        language = strip(first.lstrip("`")) or language
        body = rest.rstrip("`").rstrip(SPACE)
    comment = _whole_line_comment(language)
    rows = [r for r in _without_doc_blocks(lines(body)) if not comment(r)]
    mark = "#" if language in HASH_LANGUAGES else "//" if language in SLASH_LANGUAGES else None
    if mark:
        rows = [_without_trailing_comment(r, mark) for r in rows]
    rows = list(fold_imports((r.rstrip(SPACE) for r in rows), language))
    if aggressive:
        rows = without_test_modules(rows) if language == "rust" else rows
        marks = ATTRIBUTE_MARKS.get(language)
        rows = [r for r in rows if not (marks and strip(r).startswith(marks))]
    rows = fold_accessors(rows) if language in ACCESSOR_LANGUAGES else rows
    return f"```{language}\n" + "\n".join(squeeze(rows, 1 if aggressive else 2)) + "\n```"


# ---- build output ------------------------------------------------------------------------------

# Patterns of build output.
_CARGO_NOISE = re.compile(r"^ {0,3}(?:Compiling|Checking|Downloading|Downloaded|Fresh|Updating|Locking|Blocking|Fetching)\s")
_TSC_LINE = re.compile(r"^(.+\.tsx?)\((\d+),(\d+)\): (error|warning) (TS\d+): (.+)$")
_ESLINT_LINE = re.compile(r"^\s+(\d+):(\d+)\s+(error|warning)\s+(.+?)\s{2,}([\w/@-]+(?:/[\w-]+)*)\s*$")


def cargo(s: str, aggressive: bool) -> str:
    """Diagnostics by file. One counts if a location follows it; warnings before the first error do not count."""
    found: list[list] = []  # [is error, message, file]
    finished = failed = None
    live = False
    for line in lines(s):
        t = strip(line)
        if _CARGO_NOISE.search(line):
            continue
        if t.startswith("Finished "):
            finished, live = t, False
        elif t.startswith("error: could not compile"):
            failed, live = t, False
        elif t.startswith(("error[", "error: ")):
            live = True
            found.append([True, t, ""])
        elif live and t.startswith("warning:"):
            found.append([False, t, ""])
        elif live and re.match(r"\s+-->\s+", line):
            found[-1][2] = strip(t[3:].partition(":")[0])
    by_file: dict[bool, dict[str, list[str]]] = {True: defaultdict(list), False: defaultdict(list)}
    for error, message, file in found:
        if file:
            by_file[error][file].append(message)
    errors, warnings = (sum(map(len, by_file[k].values())) for k in (True, False))
    out = [f"// Build: {errors} error(s), {warnings} warning(s)"]
    for error, name in ((True, "error(s)"), (False, "warning(s)")):
        if error or not aggressive or not errors:
            for file in sorted(by_file[error], key=str.encode):
                out += [f"\n{file} ({len(by_file[error][file])} {name}):", *(f"  {m}" for m in by_file[error][file])]
    return "\n".join(out + ([f"\n{finished}"] if finished else []) + ([failed] if failed else []))


def tsc(s: str, aggressive: bool) -> str:
    by_code: dict[str, list[tuple[str, str]]] = defaultdict(list)
    rest = []
    for line in lines(s):
        m = _TSC_LINE.match(line)
        if m:
            by_code[m[5]].append((f"{m[1]}:{m[2]}", m[6]))
        elif strip(line):
            rest.append(line)
    out = [f"// TypeScript: {sum(map(len, by_code.values()))} error(s)"]
    for key in sorted(by_code, key=str.encode):
        places = by_code[key]
        if len(places) == 1:
            out.append(f"\n{key}: {places[0][0]} -- {places[0][1]}")
        else:
            out += [f"\n{key} ({len(places)}x): {places[0][1].split(' -- ')[0]}", *(f"  {p}" for p, _ in places)]
    return "\n".join(out + rest)


def eslint(s: str, aggressive: bool) -> str:
    by_rule: dict[str, list[str]] = defaultdict(list)
    file, summary = "", None
    for line in lines(s):
        t = strip(line)
        if not t:
            continue
        if t.startswith(("✖", "✓")) or "problem" in t:
            summary = t
        elif not line.startswith((" ", "\t")):
            file = t
        elif (m := _ESLINT_LINE.match(line)) and not (aggressive and m[3] == "warning"):
            by_rule[m[5]].append(f"{file}:{m[1]} {m[4]}")
    out = [f"// ESLint: {sum(map(len, by_rule.values()))} violation(s)"]
    for rule in sorted(by_rule, key=str.encode):
        places = by_rule[rule]
        if len(places) == 1:
            out.append(f"  {rule}: {places[0]}")
        else:
            more = [f"    ... {len(places) - 3} more"] if len(places) > 3 else []
            out += [f"  {rule} ({len(places)}x):", *(f"    {p}" for p in places[:3]), *more]
    return "\n".join(out + ([f"\n{summary}"] if summary else []))


def build(s: str, variant: str, aggressive: bool) -> str:
    tool = {"cargo": cargo, "typescript": tsc, "eslint": eslint}.get(variant)
    return tool(s, aggressive) if tool else log(s, "", aggressive)


# ---- Markdown, SQL, Dockerfiles ----------------------------------------------------------------

# Patterns of Markdown.
_BADGE = re.compile(r"\[?!\[[^\]]*\]\([^)]*\)\]?(?:\([^)]*\))?")
_COMMENT = re.compile(r"<!--.*?-->", re.S)


def is_badge_line(t: str) -> bool:
    return "![" in t and not strip(_BADGE.sub("", t.replace("\\!", "!")))


def markdown(s: str, variant: str, aggressive: bool) -> str:
    out, skipped = [], 0  # level of the section that is left out
    for line in lines(_COMMENT.sub("", s)):
        t = strip(line)
        level = len(t) - len(t.lstrip("#"))
        if skipped and 0 < level <= skipped:
            skipped = 0
        title = strip(t.lstrip("#"))
        if not skipped and aggressive and level >= 2 and title.lower().startswith(SIDE_SECTIONS):
            skipped = level
        if skipped or is_badge_line(t):
            continue
        out.append(f"- **{title}**" if level >= 3 else line)
    return "\n".join(squeeze(out, 1))


_SQL = re.compile(r"\b(?:" + "|".join(sorted(map(re.escape, SQL_WORDS), key=lambda w: -len(w))) + r")\b", re.I)


def fold_insert_rows(rows: list[str]) -> Iterator[str]:
    """Of the rows behind VALUES three stay, with a note and their number."""
    n = 0  # rows so far of the list that is open, counted from 1 to tell an open list without rows
    for r in rows:
        t = strip(r)
        if "VALUES" in t.upper():
            n = 1
        elif n and t.startswith("("):
            n += 1
            if n == 5:
                yield "  -- ... [VALUES rows truncated]"
            if n <= 4:
                yield r
            if not t.endswith((",", "),(")):
                if n > 4:
                    yield f"  -- ({n - 1} total rows)"
                n = 0
            continue
        elif n:
            if n > 4:
                yield f"  -- ({n - 1} total rows)"
            n = 0
        yield r
    if n > 4:
        yield f"  -- ({n - 1} total rows)"


def sql(s: str, variant: str, aggressive: bool) -> str:
    rows, blanks = [], 0
    for r in lines(s):
        t = strip(r)
        blanks = 0 if t else blanks + 1
        if blanks <= 1 and not t.startswith("--") and not (t.startswith("/*") and t.endswith("*/")):
            rows.append(_SQL.sub(lambda m: m[0].upper(), t))
    return "\n".join(fold_insert_rows(lines("\n".join(rows)) if rows else []))


def _run(commands: list[str], aggressive: bool) -> list[str]:
    if aggressive and len(commands) > 5:
        commands = [commands[0], commands[1], f"# ... [{len(commands) - 3} more commands]", commands[-1]]
    return [("RUN " if i == 0 else "    ") + c + (" && \\" if i < len(commands) - 1 else "") for i, c in enumerate(commands)]


def dockerfile(s: str, variant: str, aggressive: bool) -> str:
    out: list[str] = []
    blanks = 0
    commands: list[str] | None = None  # of the RUN that is open
    part = lambda t: strip(re.sub(r"&&\s*\Z", "", strip(t.rstrip("\\"))))
    for line in lines(s):
        t = strip(line)
        if commands is not None:
            c = part(t)
            commands += [c] if c and not c.startswith("#") else []
            if not t.endswith("\\"):
                out += _run(commands, aggressive)
                commands = None
            continue
        blanks = 0 if t else blanks + 1
        if t.startswith("#") or blanks > 1:
            continue
        if t.startswith("RUN ") and (t.endswith("\\") or aggressive):
            found = [c for c in map(strip, t[4:].rstrip("\\").split("&&")) if c]
            if t.endswith("\\"):
                commands = found
            else:
                out += _run(found, True) if len(found) > 5 else [t]
        else:
            out.append(t)
    if commands:
        out += ["RUN " + commands[0], *("    " + c for c in commands[1:])]
    return "\n".join(out)


# ---- the dispatcher ----------------------------------------------------------------------------

CLEANERS: dict[str, Callable[[str, str, bool], str]] = {
    "trace": stack_trace, "git-diff": git_diff, "log": log, "json": json_text, "yaml": yaml, "code": code, "build": build, "markdown": markdown, "sql": sql,
    "dockerfile": dockerfile, "terraform": terraform, "text": plain,
}


def clean(text: str, family: str, variant: str, aggressive: bool) -> str:
    """The cleaned text of a family; a text on which a cleaner fails stays as it is."""
    try:
        return CLEANERS.get(family, plain)(text, variant, aggressive)
    except Exception:  # a broken document must not stop a corpus
        return text
