"""Cleaning of texts by family.

Tables, environments and HTML are cleaned with column expressions; the families whose rules look
back go through one Python function. Its input is null for rows of other families, so rows that need
no Python cost only their place in the batch. Batches are of a hundred texts, as the function works on
one text at a time: batches of Arrow hold ten thousand, which fill a worker's memory as tables grow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.detect import family as family_of
from ..functions.detect import variant as variant_of
from ..functions.tables import LAYOUT_ATTRIBUTES, LAYOUT_TAGS, SECRET_PARTS

NATIVE = ("csv", "env", "html")


def strip_ansi(text: Column) -> Column:
    """Without terminal escape sequences; tabs and carriage returns stay."""
    return F.when(~text.contains("\x1b"), text).otherwise(_without_ansi(text))


def _without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])", "")


def squeeze(rows: Column, most: int) -> Column:
    """Lines joined, with blank lines emptied and at most `most` of a run."""

    def joined(s: Column) -> Column:
        some = F.regexp_replace(s, f"\n{{{most + 2},}}", "\n" * (most + 1))
        some = F.regexp_replace(F.regexp_replace(some, rf"\A\n{{{most + 1},}}", "\n" * most), rf"\n{{{most + 1},}}\z", "\n" * most)
        return F.when(F.ltrim(s, F.lit("\n")) == "", F.substring(s, 1, most - 1)).when(s.contains("\n" * (most + 1)), some).otherwise(s)

    return T.let(F.array_join(F.transform(rows, lambda r: F.when(T.trim_start(r) == "", "").otherwise(r)), "\n"), joined)


def head_bytes(text: Column, n: int) -> Column:
    """At most the first n bytes, cut on a character border."""
    cut = F.call_function("make_valid_utf8", F.substring(text.cast("binary"), 1, n).cast("string"))
    return F.when(F.octet_length(text) <= n, text).otherwise(F.regexp_replace(cut, "�+\\z", ""))


def clean_csv(text: Column, aggressive: bool = False) -> Column:
    """The header, the first rows, and how many more there are."""
    return T.let(T.lines(text), lambda rows: _csv_head(text, rows, aggressive))


def _csv_head(text: Column, rows: Column, aggressive: bool) -> Column:
    most = 3 if aggressive else 5
    more = F.size(rows) - 1 - most
    out = F.concat(F.slice(rows, 1, most + 1), F.when(more > 0, F.array(F.concat(F.lit("... ["), more.cast("string"), F.lit(" more rows]")))).otherwise(F.array().cast("array<string>")))
    if aggressive:

        def cell(x: Column) -> Column:
            return T.let(T.trim(x), lambda t: F.when(F.octet_length(t) > 50, F.concat(head_bytes(t, 47), F.lit("..."))).otherwise(t))

        out = F.transform(out, lambda r: F.array_join(F.transform(F.split(r, ",", -1), cell), ","))
    return F.when(F.size(rows) == 0, text).otherwise(F.array_join(out, "\n"))


def clean_env(text: Column, aggressive: bool = False) -> Column:
    """Values of secrets are masked; comments, quotes and the word export go."""
    pattern = r"\A(?U)(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)=(.*)\z"
    secret = "|".join(SECRET_PARTS)

    def shown(value: Column) -> Column:
        n = F.octet_length(value)
        return F.when(n > 100, F.concat(head_bytes(value, 50), F.lit("...["), n.cast("string"), F.lit(" chars]"))).otherwise(value)

    def line(t: Column) -> Column:
        raw = F.substr(t, F.instr(t, "=") + 1)  # names hold no "="
        value = F.btrim(F.btrim(raw, F.lit('"')), F.lit("'"))
        value = T.let(value, shown) if aggressive else value
        pair = lambda key: F.when(key != "", F.concat(key, F.lit("="), F.when(F.upper(key).rlike(secret), "***").otherwise(value))).otherwise(t)
        return F.when(t.contains("="), T.let(F.regexp_extract(t, pattern, 1), pair)).otherwise(t)

    kept = T.lines(F.concat(squeeze(F.transform(T.lines(text), T.trim), 1), F.lit("\n")))
    return F.array_join(F.transform(F.filter(kept, lambda t: ~t.startswith("#")), line), "\n")


# Blocks of HTML that go with their content, in this order.
HTML_BLOCKS = (r"(?si)<script[^>]*>.*?</script>", r"(?si)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?si)<head[^>]*>.*?</head>", r"(?si)<svg[^>]*>.*?</svg>", r"(?si)<noscript[^>]*>.*?</noscript>")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
LAYOUT = r"(?i)</?(?:" + "|".join(LAYOUT_TAGS) + r")(?:\s[^>]*)?>"
ATTRIBUTES = r"\s+(?:" + "|".join(LAYOUT_ATTRIBUTES) + r')\s*=\s*"[^"]*"'


def clean_html(text: Column, aggressive: bool = False) -> Column:
    """Content without scripts, styles, comments and head; without layout tags and attributes, or without all tags."""
    for pattern in HTML_BLOCKS:
        text = F.regexp_replace(text, pattern, "")

    def line(t: Column) -> Column:
        if aggressive:
            t = T.trim(F.regexp_replace(t, "<[^>]+>", " "))
            for name, char in ENTITIES:
                t = F.replace(t, F.lit(name), F.lit(char))
            return t
        marked = F.regexp_replace(F.regexp_replace(t, LAYOUT, ""), "(?U)" + ATTRIBUTES, "")
        marked = T.trim(F.regexp_replace(marked, r"(<[a-zA-Z][a-zA-Z0-9]*)(?U)\s+[^>]*(>)", "$1$2"))
        return F.when(t.contains("<") | t.contains("="), marked).otherwise(t)  # t is trimmed

    # a blank line is kept as a mark, a line that is emptied goes
    rows = F.transform(F.transform(T.lines(text), T.trim), lambda t: F.when(t == "", F.lit("\x00")).otherwise(line(t)))
    rows = F.transform(F.filter(rows, lambda t: t != ""), lambda t: F.when(t == "\x00", "").otherwise(t))
    return T.let(rows, lambda kept: F.when(F.size(kept) == 0, "").otherwise(squeeze(kept, 1)))


@F.udf(StringType(), useArrow=False)
def _by_lines(text: str | None, label: str | None, aggressive: bool) -> str | None:
    from .line_cleaners import clean

    family, _, variant = (label or "text").partition("/")
    return None if text is None else clean(text, family, variant, bool(aggressive))


def clean(text: Column, label: Column, aggressive: bool = False) -> Column:
    """The cleaned form of a text of the given label; null stays null."""
    plain = strip_ansi(text)
    kind = family_of(label)
    rest = F.when(~kind.isin(*NATIVE), plain)
    return (
        F.when(kind == "csv", clean_csv(plain, aggressive))
        .when(kind == "env", clean_env(plain, aggressive))
        .when(kind == "html", clean_html(plain, aggressive))
        .otherwise(_by_lines(rest, F.concat(kind, F.lit("/"), variant_of(label)), F.lit(aggressive)))
    )
