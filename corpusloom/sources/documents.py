"""Reading texts: whole files, transcripts, columns; and writing results."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USER_MARK = '"type":"user"'
MOST_DEPTH = 3


def files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its path and its whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def texts(spark: SparkSession, rows: list[str]) -> DataFrame:
    """In-memory texts, numbered in their order."""
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def project_folder(directory: str) -> str:
    """Name of the folder that holds the transcripts of a working directory."""
    return directory.replace("/", "-").replace("\\", "-").replace(":", "")


def user_text(line: Column) -> Column:
    """Text of a user message in a JSON line: a string, or its parts of type text joined by line feeds; empty where there is none."""
    content = F.try_variant_get(F.try_parse_json(line), "$.message.content", "string")
    parts = F.from_json(F.get_json_object(line, "$.message.content"), "array<struct<type string, text string>>")
    is_array = F.trim(F.get_json_object(line, "$.message.content")).startswith("[")
    raw = F.schema_of_variant(F.try_variant_get(F.try_parse_json(line), "$.message.content", "variant"))
    joined = F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), "\n")
    return F.coalesce(F.when(raw == "STRING", content).when(is_array & raw.startswith("ARRAY"), joined), F.lit(""))


def transcripts(spark: SparkSession, path: str, *, project: str | None = None, as_of: datetime | None = None, days: int | None = None, most_depth: int = MOST_DEPTH) -> DataFrame:
    """User messages of the JSONL files below a folder: session (the file) and text.

    Files deeper than most_depth folders, and files that were not changed in the last days before as_of,
    are left out. Lines are tested for the user mark before they are parsed."""
    root = f"{path.rstrip('/')}/{project_folder(project)}" if project else path.rstrip("/")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    if as_of is not None and days is not None:
        reader = reader.option("modifiedAfter", (as_of - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S")).option("timeZone", "UTC")
    rows = reader.text(root).withColumn("session", F.col("_metadata.file_path"))
    below = F.regexp_replace(F.col("session"), r"\A[a-z]+:/+", "/")
    base = root.split(":", 1)[-1] if ":/" in root else root
    base = "/" + base.lstrip("/")
    depth = F.size(F.split(F.substring(below, len(base) + 2, 1 << 30), "/")) - 1
    rows = rows.where(depth <= most_depth).where(F.col("value").contains(USER_MARK))
    return rows.select("session", user_text(F.col("value")).alias("text")).where(F.col("text") != "")


def write_text(results: DataFrame, path: str, column: str = "output") -> None:
    """One text file a task, a result after the other, each ended by a line feed."""
    results.select(F.regexp_replace(F.col(column), r"\n\z", "").alias("value")).write.mode("overwrite").text(path)
