"""What cleaning would have saved in the user messages of transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.detect import detect, family

LEAST_BYTES = 300


def messages(texts: DataFrame, text_col: str = "text", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Label, family, tokens and expected savings of each message that is long enough."""
    found = texts.where(F.octet_length(text_col) >= least_bytes).select(detect(F.col(text_col)).alias("label"), tokens.simple_estimate(F.col(text_col)).alias("est_tokens"))
    return found.withColumn("est_savings", tokens.expected_savings(F.col("est_tokens"), family(F.col("label"))))


def by_label(texts: DataFrame, text_col: str = "text", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Messages, tokens, expected savings and their whole percents for each label but plain text, with the total (label null) of all of them.

    Messages are classified in one pass: plain text is left out of the few rows of each label, by a copy of the label that is no
    grouping column, so that the condition isn't put before the aggregate, where every message would be classified again for it."""
    each = messages(texts, text_col, least_bytes).groupBy("label").agg(F.max("label").alias("name"), F.count(F.lit(1)).alias("messages"), F.sum("est_tokens").alias("est_tokens"), F.sum("est_savings").alias("est_savings"))
    sums = ("messages", "est_tokens", "est_savings")
    row = lambda name, is_total, of: F.struct(name.alias("label"), F.lit(is_total).alias("is_total"), *[of(c).alias(c) for c in sums])
    found = each.where(F.col("name") != "text").agg(F.collect_list(row(F.col("name"), 0, F.col)).alias("rows"), *[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in sums])  # a row for each label
    found = found.select(F.inline(F.concat("rows", F.array(row(F.lit(None).cast("string"), 1, F.col)))))
    percent = F.when(F.col("est_tokens") > 0, F.round(F.col("est_savings") / F.col("est_tokens") * 100)).otherwise(F.lit(0.0)).cast("long")
    return found.withColumn("percent", percent)


def summary(texts: DataFrame, text_col: str = "text", session_col: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Sessions, messages that are long enough, and those among them that cleaning would shorten."""
    long = F.octet_length(text_col) >= least_bytes
    sessions = F.countDistinct(session_col) if session_col else F.lit(None).cast("long")
    label = F.when(long, detect(F.col(text_col)))
    return texts.select(*([session_col] if session_col else []), label.alias("label")).agg(
        sessions.alias("sessions"), F.count("label").alias("messages"), F.count(F.when(F.col("label") != "text", 1)).alias("optimizable")
    )
