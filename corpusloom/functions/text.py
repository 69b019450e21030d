"""Column helpers for text: lines, trimming, words, byte lengths and the sample that is classified.

Lines end at a line feed; one carriage return before it goes, and an empty part behind the last
line feed is no line. White space is Unicode white space. Lengths are bytes of UTF-8."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SAMPLE_BYTES = 8192
#: Unicode white space, for engines without a Unicode \\s.
SPACE = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def lines(text: Column) -> Column:
    """Lines of a text as an array. The text is split once, however long the expression it comes from."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.transform(let(F.split(text, "\n", -1), cut), lambda x: F.when(x.endswith("\r"), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def trim_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(SPACE))


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Number of runs of other than white space: each leaves its first character."""
    return F.length(F.regexp_replace(text, r"(?U)\s*+(\S)\S*+|\s++", "$1")).cast("long")


def matches(text: Column, pattern: str) -> Column:
    """Number of matches; ^ stands behind line feeds only, classes are Unicode."""
    return F.regexp_count(text, F.lit(f"(?dmU){pattern}"))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?dmU){pattern}")


def count_lines(rows: Column, test) -> Column:
    """Number of elements of an array of lines for which test(line) is true."""
    return F.size(F.filter(rows, test)).cast("long")


def starts_with_any(text: Column, starts) -> Column:
    found = F.lit(False)
    for s in starts:
        found = found | text.startswith(s)
    return found


def occurrences(text: Column, part: str) -> Column:
    """Number of places of a literal, none overlapping."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))
    return gone if len(part.encode()) == 1 else (gone / F.lit(len(part.encode()))).cast("int")


def sample(text: Column) -> Column:
    """At most the first 8192 bytes, cut before a character that would be split."""
    data = text.cast("binary")
    cut = F.call_function("make_valid_utf8", F.substring(data, 1, SAMPLE_BYTES).cast("string"))
    whole = F.octet_length(text) <= SAMPLE_BYTES
    return F.when(whole, text).otherwise(F.regexp_replace(cut, "�+\\z", ""))


def line_indent(line: Column) -> Column:
    """Bytes of white space at the start of a line."""
    return F.octet_length(line) - F.octet_length(trim_start(line))


def indents(text: Column) -> Column:
    """Bytes of white space at the starts of all lines together; a carriage return that ends a line is none of it."""
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, r"(?dmU)^[\s&&[^\n]]+(?<!\r(?=\n|\z))", ""))
