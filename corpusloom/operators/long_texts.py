"""Line cleaners for texts of any size: a text is a table of lines, and its blocks are worked on by many tasks.

Logs and plain texts fold runs of equal lines, and what becomes of a line depends on how much of its run lies before it and
how long the whole run is. Both are found block by block: within a block by windows, and across blocks from the
first and last run of each block alone, which are a table of the same kind with two rows a block, and so are folded in
the same way. A row of a block then gets what its edge has. Blocks hold at most `block` lines, so no task holds a text; the result
does not depend on the size of blocks.

Lines are rows of `key` (which text), `i` (a whole number that orders the lines of a text; gaps do no harm) and `line`. Null lines are
empty ones; lines of a null key are a text of their own; a table without lines gives none."""

from __future__ import annotations

import atexit

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import delete, shared_folder
from .line_cleaners import PROGRESS, VARYING

BLOCK = 1 << 16
#: Blocks of so many lines or more, so that there are fewer edges than lines.
LEAST_BLOCK = 8
_POSITION = (1 << 33) - 1  # monotonically_increasing_id: the row's place in its partition


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files at a path, read in splits: key (the file), i (grows with the place in the file) and line.

    The first line of a split gets the place of its first byte, and those behind it the numbers after; a split has more bytes than lines."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("key"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line")).withColumn("at", F.monotonically_increasing_id())
    firsts = rows.groupBy("key", "start").agg(F.min("at").alias("first"))  # a row for each split
    return rows.join(firsts, ["key", "start"]).select("key", (F.col("start") + (F.col("at") - F.col("first"))).alias("i"), "line")


def run_places(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (key, i, k, size, alone, and more) with `before`, the sizes of the rows of its run before a row, and `total`, those of the whole run.

    A run is a sequence of rows with one k; a row that is `alone` begins a new one."""
    spark = rows.sparkSession
    at = shared_folder(spark, "runs")
    atexit.register(delete, spark, at)
    most = rows.groupBy("key").agg((F.max("i") - F.min("i")).alias("n")).agg(F.max("n")).first()[0]
    return _places(rows.withColumn("key", F.struct("key")), most or 0, max(LEAST_BLOCK, block), at).withColumn("key", F.col("key.key"))  # a struct is never null


def _places(rows: DataFrame, most: int, block: int, at: str) -> DataFrame:
    """most: how far apart the rows of a text are at most; at: where the edges of blocks are written, which are read by both passes over them."""
    rows = rows.withColumn("block", F.expr(f"i div {block}"))
    order = Window.partitionBy("key", "block").orderBy("i")
    last = F.lag("k").over(order)
    rows = rows.withColumn("begins", (F.col("alone") | last.isNull() | (last != F.col("k"))).cast("int"))
    rows = rows.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("begins")
    run = Window.partitionBy("key", "block", "run")
    rows = rows.withColumns({"before": F.coalesce(F.sum("size").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("size").over(run)})
    runs = rows.groupBy("key", "block").agg(
        F.max("run").alias("runs"), F.min_by("k", "i").alias("first_k"), F.min_by("alone", "i").alias("first_alone"), F.min_by("total", "i").alias("first_size"), F.max_by("k", "i").alias("last_k"), F.max_by("total", "i").alias("last_size")
    )
    runs.write.parquet(f"{at}/{most}")
    runs = rows.sparkSession.read.schema(runs.schema).parquet(f"{at}/{most}")
    edge = lambda place, k, size, alone: F.struct((F.col("block") * 2 + place).alias("i"), F.col(k).alias("k"), F.col(size).alias("size"), alone.alias("alone"))
    first, last_one = edge(0, "first_k", "first_size", F.col("first_alone")), edge(1, "last_k", "last_size", F.lit(True))
    edges = runs.select("key", F.inline(F.when(F.col("runs") > 1, F.array(first, last_one)).otherwise(F.array(first))))
    blocks = most // block + 2
    if blocks <= block:  # all edges of a text in one window
        order = Window.partitionBy("key").orderBy("i")
        last = F.lag("k").over(order)
        edges = edges.withColumn("run", F.sum((F.col("alone") | last.isNull() | (last != F.col("k"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        run = Window.partitionBy("key", "run")
        edges = edges.withColumns({"before": F.coalesce(F.sum("size").over(run.orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("size").over(run)})
    else:
        edges = _places(edges, 2 * blocks, block, at)
    found = edges.groupBy("key", F.expr("i div 2").alias("block")).agg(
        F.max(F.when(F.col("i") % 2 == 0, F.col("before"))).alias("carried"), F.max(F.when(F.col("i") % 2 == 0, F.col("total"))).alias("first_total"), F.max(F.when(F.col("i") % 2 == 1, F.col("total"))).alias("last_total")
    )
    rows = rows.join(runs.select("key", "block", "runs").join(found, ["key", "block"]), ["key", "block"])
    in_first, in_last = F.col("run") == 1, (F.col("run") == F.col("runs")) & (F.col("runs") > 1)
    total = F.when(in_first, F.col("first_total")).when(in_last, F.col("last_total")).otherwise(F.col("total"))
    before = F.col("before") + F.when(in_first, F.col("carried")).otherwise(F.lit(0))
    return rows.withColumns({"before": before, "total": total}).drop("block", "run", "runs", "carried", "first_total", "last_total")


def _blank(text: Column) -> Column:
    return text.rlike(r"(?U)\A\s*\z")


def _folded(rows: DataFrame, keep: int, note: str, most_blank: int | None, block: int) -> DataFrame:
    """Lines with `k` their key; runs of one key keep their first lines and a note, blank ones at most `most_blank` lines (all, if None)."""
    blank = _blank(F.col("k"))
    placed = run_places(rows.select("key", "i", "line", "k", F.lit(1).cast("long").alias("size"), (blank if most_blank is None else F.lit(False)).alias("alone")), block)
    before, _, tail = F.col("before"), *note.partition("{}")[1:]
    shown = F.when(blank | (before < keep), F.col("line")).otherwise(F.concat(F.lit(note.partition("{}")[0]), (F.col("total") - keep).cast("string"), F.lit(tail)))
    stays = F.when(blank, F.lit(True) if most_blank is None else before < most_blank).otherwise(before <= keep)
    return placed.where(stays).select("key", "i", shown.alias("line"))


def log_lines(lines: DataFrame, aggressive: bool = False, block: int = BLOCK) -> DataFrame:
    """(key, i, line) of cleaned logs: no progress lines, and runs of lines that are equal but for times, ids and numbers keep their first two (one) and a note."""
    rows = lines.select("key", "i", F.coalesce("line", F.lit("")).alias("line")).where(~F.col("line").startswith("\r") & ~F.col("line").rlike("(?U)" + PROGRESS.pattern))
    k = F.col("line")
    for pattern, name in VARYING:
        k = F.regexp_replace(k, "(?U)" + pattern.pattern, name)
    return _folded(rows.withColumn("k", k), 1 if aggressive else 2, "  [... {} identical lines suppressed]", None, block)


def plain_lines(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, i, line) of cleaned plain texts: no borders and deep quotes, no white space at ends of lines, at most two blank lines in a row and none at the ends, runs of equal lines folded."""
    rows = lines.select("key", "i", F.regexp_replace(F.coalesce("line", F.lit("")), r"(?U)\s+\z", "").alias("line"))
    border = (F.col("line") != "") & F.trim("line").rlike(r"\A[-=+|_* ]{3,}\z")
    rows = rows.where(~border & ~F.col("line").startswith("> >") & ~F.col("line").startswith(">>>"))
    out = _folded(rows.withColumn("k", F.col("line")), 2, "  [... {} identical lines]", 2, block)
    ends = out.where(F.col("line") != "").groupBy(F.struct("key").alias("whole")).agg(F.min("i").alias("low"), F.max("i").alias("high"))
    return out.withColumn("whole", F.struct("key")).join(ends, "whole").where(F.col("i").between(F.col("low"), F.col("high"))).select("key", "i", "line")


def write_lines(lines: DataFrame, path: str) -> None:
    """Text files, whose names in order have the lines of all texts in the order of key and i."""
    lines.repartitionByRange(lines.sparkSession.sparkContext.defaultParallelism * 4, "key", "i").sortWithinPartitions("key", "i").select("line").write.mode("overwrite").text(path)
