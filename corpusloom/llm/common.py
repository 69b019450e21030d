"""Shared pieces of the training-data operators: tables, shared scratch space, Arrow helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


BATCH_ROWS = 2048
#: What a Python worker keeps from task to task, by name; a task of another operator lets it go.
HELD: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set; intermediate tables need a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpusloom-")  # one process: there is nobody to share with
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Scratch tables that have not been dropped, in order of their making.
LIVE: list[Scratch] = []


def drop_made_after(count: int) -> None:
    """Drop the scratch tables that were made when there were already `count`; for when what was derived from them is written."""
    for scratch in LIVE[count:]:
        scratch.drop()


class Scratch:
    """Written tables in the shared folder; they cut lineage, survive lost executors, and go at the end of the application."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/corpusloom-{name}-{uuid.uuid4().hex[:12]}"
        LIVE.append(self)
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df and return what was written. options: of the writer."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").options(**options).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        if not name and self in LIVE:
            LIVE.remove(self)
            atexit.unregister(self.drop)
        try:
            jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
            at.getFileSystem(conf).delete(at, True)
        except Exception:  # the application has ended; what is left lies in the scratch folder only
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def release() -> None:
    """Give freed memory back to the system: Python workers are used again, and what one operator leaves would add to the next one's.

    What the worker's modules hold, some 80,000 objects, is looked through once and set aside: it takes 40 ms each time, and a task releases after each batch."""
    import ctypes
    import gc

    gc.collect()
    if not gc.get_freeze_count():
        gc.freeze()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_arrow(df: DataFrame, func: Callable[..., Iterable[pa.RecordBatch] | pa.RecordBatch], schema: str | StructType, state: Callable[[], object] | None = None, holds: str = "") -> DataFrame:
    """mapInArrow with a function of one batch, and of what `state` makes for each task; `holds` names what it keeps in HELD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # what is freed can be given back
        for name in set(HELD) - {holds}:
            del HELD[name]
        more = () if state is None else (state(),)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):  # what a function derives from a batch stays small
                made = func(batch.slice(at, BATCH_ROWS), *more)
                if isinstance(made, pa.RecordBatch):
                    yield made
                else:
                    yield from made
                del made
            del batch
            release()

    if any("." in c for c in df.columns):  # mapInArrow looks its columns up by name
        df = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that df does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k = 0
        while f"_{name}_{k}" in taken:
            k += 1
        out.append(f"_{name}_{k}")
    return out


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def bounded_sample(keyed: DataFrame, id_col: str, group: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group, those with the smallest hash of the id; the same rows on every run.

    Counts come from a partial aggregate, and a threshold on the hash leaves the ranking about
    2 x most rows a group, whatever the size of the group."""
    from pyspark.sql import Window

    span = 1 << 40
    h = F.pmod(F.xxhash64(id_col), F.lit(span))
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*group).orderBy("_h", id_col)
    return (
        keyed.withColumn("_h", h)
        .join(counts, group)
        .where(F.col("_h").cast("double") * F.col("_n") <= 2.0 * most * span + 64.0 * span)
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= most)
        .drop("_h", "_n", "_r")
    )


def labelled_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(key, label, text) of at most `most` documents of each class: hash of the id, 0 or 1, text.

    Null labels and ids are left out; of rows with one id the largest label and the smallest text count."""
    id_name, label, text = (F.col(f"`{c}`") for c in (id_col, label_col, text_col))
    rows = labels.where(label.isNotNull() & id_name.isNotNull()).groupBy(id_name.alias("id")).agg(F.max((label > 0).cast("int")).alias("label"))
    sample = bounded_sample(rows, "id", ["label"], most)
    got = docs.select(id_name.alias("id"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id")  # 2 x most rows
    return got.groupBy("id").agg(F.max("label").alias("label"), F.min("text").alias("text")).select(F.xxhash64("id").alias("key"), "label", "text")
