"""The document pipeline: classify, clean, frame, prompt, estimate tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import annotate, prompt, tokens
from ..functions import text as T
from ..functions.detect import detect, family
from ..operators.clean import clean
from .options import Options


def is_blank(text: Column) -> Column:
    """Whether a text is null or white space only."""
    return F.coalesce(T.trim_start(text) == "", F.lit(True))


def process(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None, through: Sequence[str] = ()) -> DataFrame:
    """One row for each document: id, label, original, cleaned, output, tokens before and after, savings.

    A text of white space only, or null, passes through as its own output; its tokens are null, and it
    enters no ledger. through: labels whose texts pass through likewise, for callers that have no use for them."""
    o = options or Options()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("original"))
    base = base.withColumn("blank", is_blank(F.col("original")))
    base = base.withColumn("label", F.when(~F.col("blank"), detect(F.col("original"), o.force_type, o.force_diff)))
    if through:
        base = base.withColumn("blank", F.col("blank") | F.col("label").isin(*through))
    work = base.withColumn("cleaned", F.when(F.col("blank"), F.col("original")).otherwise(clean(F.when(~F.col("blank"), F.col("original")), F.col("label"), o.effective_aggressive)))
    shown = F.col("cleaned") if o.no_frame else annotate.frame(F.col("cleaned"), F.col("label"), o.focus)
    if o.prompt:
        shown = prompt.wrap(shown, o.prompt, F.col("label"))
    kind = family(F.col("label"))
    work = work.withColumns({"original_tokens": F.when(~F.col("blank"), tokens.estimate(F.col("original"), kind)), "cleaned_tokens": F.when(~F.col("blank"), tokens.estimate(F.col("cleaned"), kind))})
    before, after = F.col("original_tokens"), F.col("cleaned_tokens")
    if o.stats:
        shown = F.concat(tokens.stats_header(F.col("label"), before, after, o.brand), shown)
    return work.select(
        "id", "label", "original", "cleaned", F.when(F.col("blank"), F.col("original")).otherwise(shown).alias("output"), "original_tokens", "cleaned_tokens",
        F.when(~F.col("blank"), 100.0 - after / before * 100.0).alias("savings_pct"), F.when(~F.col("blank"), tokens.savings_label(before, after)).alias("savings_label"),
    )


def preview(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", options: Options | None = None) -> DataFrame:
    """What a run would give; nothing is written."""
    return process(docs, id_col, text_col, options).select("id", "label", "output", "original_tokens", "cleaned_tokens", "savings_label")


def restore(processed: DataFrame) -> DataFrame:
    """The originals of processed rows."""
    return processed.select("id", F.col("original").alias("text"))
