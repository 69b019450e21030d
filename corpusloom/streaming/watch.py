"""Continuous cleaning of a stream of texts by session.

A text is handled unless it equals the session's text before it, or the output that was written for
that one. Short texts, plain ones and such that cleaning does not shorten are passed over, but still
count as the text before. Texts of a session are ordered by their sequence number in a micro-batch.

Each session has three pieces of typed state: the hashes of the text before and of what was written for it, the totals of
the session, and the sequence numbers of the last texts that were written, for the way back. They can be given an expiry,
a first value, and be read from a checkpoint as tables."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from operator import itemgetter

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import tokens
from ..operators import ledger
from ..plans.options import Options
from ..plans.process import process

LEAST_BYTES = 200
#: How many written texts of a session can be taken back.
WAYS_BACK = 10
RESULT = "session string, seq long, label string, original string, output string, original_tokens long, cleaned_tokens long, saved long, runs long, total_saved long"
BEFORE, TOTALS, UNDO = "own long, made long", "runs long, saved long, last_seq long", "seq long"
CARRIED = [c.split(" ")[0] for c in RESULT.split(", ")][:-2]
WRITTEN = Row(*CARRIED, "runs", "total_saved")
INITIAL = f"session string, {BEFORE}, {TOTALS}"
#: A micro-batch commits its changes of state; whole snapshots are written beside the work.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


class Watcher(StatefulProcessor):
    """The state machine of one session."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.before = handle.getValueState("before", BEFORE, self.ttl_ms)
        self.totals = handle.getValueState("totals", TOTALS, self.ttl_ms)
        self.undo = handle.getListState("undo", UNDO, self.ttl_ms)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        if initialState["own"] is not None:
            self.before.update((initialState["own"], initialState["made"]))
        self.totals.update((initialState["runs"], initialState["saved"], initialState["last_seq"]))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each look at state is a way to Spark and back, so none is taken twice. Totals are written whenever anything is: without them there is nothing else.
        held = self.totals.get()
        before = (self.before.get() if held else None) or (None, None)  # hashes of the text before and of what was written for it
        runs, total, last = held or (0, 0, -1)
        taken = []
        for row in sorted(rows, key=itemgetter("seq")):
            if row["own_hash"] in before:
                continue
            before = (row["own_hash"], row["output_hash"] if row["wanted"] else row["own_hash"])
            last = max(last, row["seq"])
            if row["wanted"]:
                runs, total = runs + 1, total + row["saved"]
                taken.append(WRITTEN(*(row[c] for c in CARRIED), runs, total))
        if before[0] is not None:
            self.before.update(before)
        self.totals.update((runs, total, last))
        if taken:
            kept = list(self.undo.get()) if held and len(taken) < WAYS_BACK else []
            self.undo.put([*kept, *((row["seq"],) for row in taken)][-WAYS_BACK:])
        yield from taken

    def close(self) -> None:
        pass


def watch(
    stream: DataFrame, options: Options | None = None, *, session_col: str = "session_id", seq_col: str = "seq", text_col: str = "text", least_bytes: int = LEAST_BYTES, ttl_ms: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Rows that are written: session, seq, label, original (the way back), output, tokens and saving, and the session's totals so far.

    Null sequence numbers come last in their micro-batch, and null texts are passed over like empty ones. ttl_ms: state of a session that
    is not written for so long goes. initial: rows of INITIAL, at most one a session, from which sessions go on."""
    spark = stream.sparkSession
    for name, value in STORE.items():
        spark.conf.set(name, value)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key = F.struct(F.col(f"`{session_col}`").cast("string").alias("session"), F.col(f"`{seq_col}`").cast("long").alias("seq"), F.xxhash64(text).alias("own"))
    # short texts are not classified, plain ones not cleaned, and texts that are not written stay behind
    done = process(stream.select(key.alias("key"), F.when(F.octet_length(text) >= least_bytes, text).alias("text")), "key", "text", options, through=("text",))
    saved = tokens.saved(F.col("original_tokens"), F.col("cleaned_tokens"))
    done = done.withColumn("wanted", F.coalesce((F.col("label") != "text") & (saved > 0), F.lit(False)))
    shown = [F.when(F.col("wanted"), F.col(c)).alias(c) for c in ("label", "original", "output", "original_tokens", "cleaned_tokens")]
    rows = done.select(
        F.col("id.session").alias("session"), F.coalesce("id.seq", F.lit((1 << 63) - 1)).alias("seq"), *shown, F.when(F.col("wanted"), saved).alias("saved"),
        F.col("id.own").alias("own_hash"), F.when(F.col("wanted"), F.xxhash64("output")).alias("output_hash"), "wanted",
    )
    first = initial.groupBy("session") if initial is not None else None
    return rows.groupBy("session").transformWithState(Watcher(ttl_ms), RESULT, "append", "ProcessingTime" if ttl_ms else "None", first)


def totals(written: DataFrame) -> DataFrame:
    """Runs and tokens saved of each session."""
    return written.groupBy("session").agg(F.count(F.lit(1)).alias("runs"), F.sum("saved").alias("saved"))


def state(spark: SparkSession, checkpoint: str, name: str = "totals", batch: int | None = None) -> DataFrame:
    """A piece of state as a table, by the last micro-batch or a given one: `before` and `totals` have a row for each session, `undo` one for each text that can be taken back."""
    reader = spark.read.format("statestore").option("stateVarName", name)
    if batch is not None:
        reader = reader.option("batchId", batch)
    found = reader.load(checkpoint)
    value = "list_element" if name == "undo" else "value"
    held = found.schema[value].dataType
    value = f"{value}.value" if "ttlExpirationMs" in getattr(held, "names", []) else value
    return found.select(F.col("key.session").alias("session"), f"{value}.*")


def start(stream: DataFrame, sink_path: str, ledger_path: str, checkpoint: str, options: Options | None = None, at: datetime | None = None, *, ttl_ms: int | None = None, initial: DataFrame | None = None, **trigger):
    """Write outputs and ledger rows of each micro-batch; returns the query, which stop() ends. trigger: of writeStream, by default 250 ms."""

    def sink(batch: DataFrame, number: int) -> None:
        place = f"{sink_path}/batch={number}"
        batch.write.mode("overwrite").parquet(place)  # a batch that is run again replaces itself
        runs = batch.sparkSession.read.schema(batch.schema).parquet(place).select(F.xxhash64("session", "seq").alias("id"), "label", "original_tokens", "cleaned_tokens")
        ledger.entries(runs, at or datetime.now()).write.mode("overwrite").parquet(f"{ledger_path}/batch={number}")

    writer = watch(stream, options, ttl_ms=ttl_ms, initial=initial).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(sink)
    return writer.trigger(**(trigger or {"processingTime": "250 milliseconds"})).start()


def daily(written: DataFrame, ts_col: str = "ts", late: str = "1 day") -> DataFrame:
    """Runs and tokens of each day of a stream of ledger rows, final when the watermark has passed the day."""
    return written.withWatermark(ts_col, late).groupBy(F.window(ts_col, "1 day").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum("original_tokens").alias("original_tokens"), F.sum("cleaned_tokens").alias("cleaned_tokens"))
