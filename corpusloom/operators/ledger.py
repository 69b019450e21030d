"""The ledger of runs: an append-only table, and the reports over it.

Reports take `as_of`, the moment they speak of, so that they give the same rows whenever they run.
Time predicates are on the column itself, so that files and partitions can be skipped."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tokens

SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType(), False), T.StructField("ts", T.TimestampNTZType(), False), T.StructField("content_type", T.StringType(), False),
        T.StructField("original_tokens", T.LongType(), False), T.StructField("cleaned_tokens", T.LongType(), False), T.StructField("savings_pct", T.DoubleType(), False),
    ]
)


def savings_pct(original: Column, cleaned: Column) -> Column:
    return F.when(original > 0, F.lit(100.0) - cleaned / original * F.lit(100.0)).otherwise(F.lit(0.0))


def entries(processed: DataFrame, at: datetime) -> DataFrame:
    """Ledger rows of processed documents; texts that were passed through have none."""
    rows = processed.where(F.col("label").isNotNull())
    return rows.select(
        F.col("id").cast("long").alias("run_id"), F.lit(at).cast("timestamp_ntz").alias("ts"), F.col("label").alias("content_type"), "original_tokens", "cleaned_tokens",
        savings_pct(F.col("original_tokens"), F.col("cleaned_tokens")).alias("savings_pct"),
    )


def create(spark: SparkSession, path: str) -> None:
    """An empty ledger, if there is none."""
    spark.createDataFrame([], SCHEMA).withColumn("day", F.to_date("ts")).write.mode("ignore").partitionBy("day").parquet(path)


def append(runs: DataFrame, path: str) -> None:
    """Add rows; the table is partitioned by day, so that a report reads its days only."""
    runs.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def scan(spark: SparkSession, path: str, since: datetime | None = None) -> DataFrame:
    found = spark.read.schema(T.StructType([*SCHEMA.fields, T.StructField("day", T.DateType())])).parquet(path)
    if since is not None:
        found = found.where((F.col("day") >= F.lit(since.date())) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))
    return found.drop("day")


def since_days(runs: DataFrame, as_of: datetime, days: int) -> DataFrame:
    return runs.where(F.col("ts") >= F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz"))


def today(runs: DataFrame, as_of: datetime) -> DataFrame:
    return runs.where(F.col("ts") >= F.lit(as_of.replace(hour=0, minute=0, second=0, microsecond=0)).cast("timestamp_ntz"))


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0).cast("long"))


def totals(runs: DataFrame) -> DataFrame:
    """Runs, tokens before and after, and the unweighted mean saving."""
    return runs.agg(F.count(F.lit(1)).alias("runs"), _sum("original_tokens").alias("original_tokens"), _sum("cleaned_tokens").alias("cleaned_tokens"), F.coalesce(F.avg("savings_pct"), F.lit(0.0)).alias("avg_savings_pct"))


def by_type(runs: DataFrame) -> DataFrame:
    """Runs and mean saving of each type, most runs first, then by name."""
    found = runs.groupBy("content_type").agg(F.count(F.lit(1)).alias("runs"), F.avg("savings_pct").alias("avg_savings_pct"))
    return found.orderBy(F.desc("runs"), "content_type")


def daily(runs: DataFrame) -> DataFrame:
    found = runs.groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("original_tokens").alias("original_tokens"), F.sum("cleaned_tokens").alias("cleaned_tokens"), F.avg("savings_pct").alias("avg_savings_pct"))
    return found.orderBy(F.desc("day"))


def daily_with_total(runs: DataFrame) -> DataFrame:
    """Days and a row for all of them (day null), whose saving is weighted by tokens: saved, never below 0, over original."""
    found = runs.rollup(F.to_date("ts").alias("day")).agg(
        F.grouping_id().alias("is_total"), F.count(F.lit(1)).alias("runs"), F.sum("original_tokens").alias("original_tokens"), F.sum("cleaned_tokens").alias("cleaned_tokens"), F.avg("savings_pct").alias("_avg"),
    )
    o, c = F.col("original_tokens"), F.col("cleaned_tokens")
    weighted = F.when(o > 0, tokens.saved(o, c) / o * F.lit(100.0)).otherwise(F.lit(0.0))
    return found.select("day", F.col("is_total").cast("int").alias("is_total"), "runs", o, c, tokens.saved(o, c).alias("saved_tokens"), F.when(F.col("is_total") == 1, weighted).otherwise(F.col("_avg")).alias("savings_pct"))


def history(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs, latest first."""
    return runs.orderBy(F.desc("run_id")).limit(limit)


def export(runs: DataFrame) -> DataFrame:
    """All runs in the order of their ids, with the saving to one decimal."""
    return runs.orderBy("run_id").select("ts", "content_type", "original_tokens", "cleaned_tokens", F.round("savings_pct", 1).alias("savings_pct"))


def write_export(runs: DataFrame, path: str, form: str = "json") -> None:
    """The export as JSON lines or as CSV with a header."""
    writer = export(runs).write.mode("overwrite")
    writer.json(path) if form == "json" else writer.option("header", True).csv(path)


def with_savings(runs: DataFrame) -> DataFrame:
    """Runs with tokens saved, whole percents, label and cost of what was saved."""
    o, c = F.col("original_tokens"), F.col("cleaned_tokens")
    saved = tokens.saved(o, c)
    return runs.withColumns({"saved_tokens": saved, "percent": tokens.savings_percent(o, c), "savings_label": tokens.savings_label(o, c), "saved_cost": tokens.cost(saved)})
