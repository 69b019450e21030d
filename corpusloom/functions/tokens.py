"""Token estimates from words, punctuation, line feeds and indentation, and expected savings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .tables import PRICE_PER_1K_TOKENS, SAVINGS_RATE, TOKEN_PUNCTUATION, TOKENS_PER_WORD


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())]), key)


def estimate(text: Column, family: Column) -> Column:
    """Estimated tokens of a text of a family; at least 1."""
    text = F.coalesce(text, F.lit(""))
    removed = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    indent = T.indents(text) / F.lit(4.0)
    total = T.words(text) * lookup(TOKENS_PER_WORD, family) + removed(TOKEN_PUNCTUATION) * F.lit(0.6) + removed("\n") * F.lit(0.3) + indent * F.lit(0.2)
    return F.greatest(F.round(total).cast("long"), F.lit(1).cast("long"))


def simple_estimate(text: Column) -> Column:
    """1.3 tokens a word."""
    return F.round(T.words(F.coalesce(text, F.lit(""))) * F.lit(1.3)).cast("long")


def expected_savings(tokens: Column, family: Column) -> Column:
    return F.round(tokens * lookup(SAVINGS_RATE, family)).cast("long")


def savings_percent(original: Column, cleaned: Column) -> Column:
    """Whole percents saved, cut towards zero; 0 for an empty original."""
    return F.when(original > 0, F.try_divide((original - cleaned) * 100, original).cast("long")).otherwise(F.lit(0).cast("long"))


def savings_label(original: Column, cleaned: Column) -> Column:
    p = savings_percent(original, cleaned)
    return (
        F.when(original == cleaned, "no change")
        .when(p > 0, F.concat(F.lit("-"), p.cast("string"), F.lit("%")))
        .when(p < 0, F.concat(F.lit("+"), F.abs(p).cast("string"), F.lit("%")))
        .when(cleaned < original, "-<1%")
        .otherwise("+<1%")
    )


def saved(original: Column, cleaned: Column) -> Column:
    """Tokens saved, never below 0."""
    return F.greatest(original - cleaned, F.lit(0).cast("long"))


def cost(tokens: Column) -> Column:
    return tokens / F.lit(1000.0) * F.lit(PRICE_PER_1K_TOKENS)


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def stats_header(label: Column, original: Column, cleaned: Column, brand: str = "stats") -> Column:
    """A comment line with label, tokens before and after, and the saving."""
    return F.concat(F.lit(f"# {brand} ["), label, F.lit("]: "), original.cast("string"), F.lit(" -> "), cleaned.cast("string"), F.lit(" tokens ("), savings_label(original, cleaned), F.lit(")\n"))


# Names in old ledgers and what they are called now, in the order of replacement.
OLD_NAMES = (
    ("StackTrace(", "trace/"), ('Code("', "code/"), ('BuildOutput("', "build/"), ("LogFile", "log"), ("GitDiff", "git-diff"), ("PlainText", "text"), ("Markdown", "markdown"), ("Html", "html"),
    ("Sql", "sql"), ("Csv", "csv"), ("Dockerfile", "dockerfile"), ("EnvFile", "env"), ("Terraform", "terraform"), ("Json", "json"), ("Yaml", "yaml"), ("Unknown", "unknown"), ('")', ""), (")", ""),
)


def friendly_name(label: Column) -> Column:
    for old, new in OLD_NAMES:
        label = F.replace(label, F.lit(old), F.lit(new))
    return F.lower(label)
