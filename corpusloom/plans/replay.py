"""Queries that write and read on their way: a replayed stream, transcripts, and ledgers with several writers.

What they write lies in the folder that driver and executors share and goes when the application ends."""

from __future__ import annotations

import atexit
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import long_texts
from ..sources import ledger_table, transcript_source
from ..sources.shared import delete, shared_folder
from ..streaming import watch
from .process import process

#: A stream is replayed in so many runs of the query, by the number of the turn.
PARTS = ((0, 1), (2, 3), (4, 1 << 40))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession, name: str) -> str:
    at = shared_folder(spark, name)
    atexit.register(delete, spark, at)
    return at


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, text): two of three turns as CSV of their words' lengths, the third as it is."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \n]+"), lambda w: w != "")
    row = lambda w, i: F.concat_ws(",", F.col("turn").cast("string"), (i + 1).cast("string"), F.length(w).cast("string"))
    sheet = F.concat(F.lit("turn,place,size\n"), F.array_join(F.transform(words, row), "\n"))
    return conversations.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, F.coalesce("text", F.lit(""))).otherwise(sheet).alias("text"))


def clipboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, seq, text): each turn's text twice, then the turn before it again, then what was written for that."""
    turns = turn_texts(_table(spark, sf_dir, "conversations"))
    done = process(turns.select(F.struct("conv_id", "turn").alias("key"), "text"), "key", through=("text",))
    made = done.select("id.conv_id", "id.turn", F.col("original").alias("text"), F.when(F.col("label") == "csv", F.col("output")).alias("made"))
    after = turns.groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.count(F.lit(1)).cast("int").alias("after"))  # rows of the turn after
    at = lambda k, turn, text: F.struct(F.col("conv_id").cast("string").alias("session_id"), (turn * 4 + k).alias("seq"), F.col(text).alias("text"), turn.alias("part_turn"))
    own, later, n = F.col("turn"), F.col("turn") + 1, F.coalesce("after", F.lit(0))
    shown = F.concat(F.array(at(0, own, "text"), at(1, own, "text")), F.array_repeat(at(2, later, "text"), n), F.array_repeat(at(3, later, "made"), F.when(F.col("made").isNull(), 0).otherwise(n)))
    return made.join(after, ["conv_id", "turn"], "left").select(F.inline(shown))


def replay(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The stream in parts, the query stopped and started again between them; what it wrote, and its checkpoint."""
    at = _folder(spark, "replay")
    clipboard(spark, sf_dir).write.parquet(f"{at}/all")
    rows = spark.read.parquet(f"{at}/all")
    for low, high in PARTS:
        rows.where(F.col("part_turn").between(low, high)).drop("part_turn").write.mode("append").parquet(f"{at}/source")
        stream = spark.readStream.schema(rows.drop("part_turn").schema).parquet(f"{at}/source")
        query = watch.start(stream, f"{at}/out", f"{at}/ledger", f"{at}/checkpoint", at=datetime(2024, 1, 1), availableNow=True)
        query.awaitTermination()
    return spark.read.parquet(f"{at}/out"), f"{at}/checkpoint"


def watch_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, _ = replay(spark, sf_dir)
    return written.select("session", "seq", "label", F.md5("output").alias("output_md5"), "original_tokens", "cleaned_tokens", "saved", "runs", "total_saved")


def watch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of each session and the texts that can be taken back, from the state of the last micro-batch."""
    _, checkpoint = replay(spark, sf_dir)
    undo = watch.state(spark, checkpoint, "undo").groupBy("session").agg(F.array_join(F.sort_array(F.collect_list("seq")), ",").alias("undo"))  # WAYS_BACK at most
    return watch.state(spark, checkpoint, "totals").join(undo, "session", "left").select("session", "runs", "saved", "last_seq", F.coalesce("undo", F.lit("")).alias("undo"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as the lines of one log: key, i, line."""
    level = F.when(F.col("event_id") % 7 == 0, "ERROR").when(F.col("event_id") % 5 == 0, "WARN").otherwise("INFO")
    kind = F.when(F.col("event_id") % 1000 < 300, F.lit("beat")).otherwise(F.col("event_type"))  # long runs, which cross blocks
    line = F.concat(F.lit("2024-01-01T00:00:00Z "), F.when(F.col("event_id") % 1000 < 300, F.lit("INFO")).otherwise(level), F.lit(" "), kind, F.lit(" id=1"), (F.col("event_id") + 1000).cast("string"))
    return _table(spark, sf_dir, "events").select(F.lit("events").alias("key"), F.col("event_id").alias("i"), line.alias("line"))


def clean_log_one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one log, cleaned in blocks of 256 lines, so that runs cross them at every size of the tables."""
    return long_texts.log_lines(event_log(spark, sf_dir), block=256).select("i", "line")


def clean_plain_one_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of all events, some left out, as one plain text."""
    rows = event_log(spark, sf_dir).select("key", "i", F.when(F.col("i") % 11 < 4, F.lit("")).when(F.col("i") % 1000 < 300, F.lit("beat")).otherwise(F.element_at(F.split("line", " "), 3)).alias("line"))
    return long_texts.plain_lines(rows, block=256).select("i", "line")


def ledger_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger after a write whose task fails half-way, the same again, once more by mistake, and a second commit: each run once."""
    from .registry import runs

    at, rows = _folder(spark, "ledger"), runs(spark, sf_dir)
    first, second = rows.where("run_id % 2 = 0"), rows.where("run_id % 2 = 1")
    late = first.agg(F.max("run_id")).first()[0]
    broken = first.withColumn("cleaned_tokens", F.when(F.col("run_id") == late, F.raise_error(F.lit("a task fails")).cast("long")).otherwise(F.col("cleaned_tokens")))
    try:
        ledger_table.write(broken, at, "even")
    except PySparkException as e:  # as asked for above
        if "a task fails" not in str(e):
            raise
    for part, name in ((first, "even"), (first, "even"), (second, "odd")):
        ledger_table.write(part, at, name)
    return ledger_table.read(spark, at).withColumn("savings_pct", F.round("savings_pct", 6))


def transcripts_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as transcripts, one folder for each of seven projects, and read by the source: user messages of four projects, from ranges of 16 KB."""
    at, turns = _folder(spark, "transcripts"), _table(spark, sf_dir, "conversations")
    text = F.coalesce("text", F.lit(""))
    part = F.struct(F.lit("text").alias("type"), text.alias("text"))
    message = lambda content: F.to_json(F.struct(F.col("role").alias("type"), F.struct("role", content.alias("content")).alias("message"), "conv_id", "turn"))
    line = F.when(F.col("turn") % 4 == 2, message(F.array(part, F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), part))).otherwise(message(text))
    turns.select(F.concat(F.lit("p"), F.pmod("conv_id", F.lit(7)).cast("string")).alias("project"), line.alias("value")).write.partitionBy("project").text(at)
    transcript_source.register(spark)
    found = spark.read.format(transcript_source.NAME).option("suffix", ".txt").option("range_bytes", 16 << 10).load(at)
    found = found.where(F.col("project").isin("project=p1", "project=p2", "project=p4", "project=p5") & (F.col("depth") == 1) & (F.col("modified") >= F.lit(datetime(2000, 1, 1))))
    return found.select(F.substring("project", 9, 9).alias("project"), F.md5("text").alias("text_md5"), F.octet_length("text").cast("long").alias("bytes"))


QUERIES = {f.__name__: f for f in (watch_conversations, watch_state, clean_log_one_text, clean_plain_one_text, ledger_exactly_once, transcripts_conversations)}
