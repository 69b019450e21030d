"""The ledger as a data source: rows become visible by commits, each of them once.

    runs.write.format("corpusloom_ledger").option("path", p).option("commit", "batch-17").mode("append").save()
    spark.read.format("corpusloom_ledger").load(p)

Each task writes a Parquet file of its own and hands its name to the driver, which lists the files of all tasks that succeeded in a
manifest, the commit. What a failed, retried or speculative task has left is in no manifest, so no reader sees it. A commit has a
name; to write one of a name that is there already changes nothing, so a batch can be written again when it isn't known whether it
came through. Manifests have the span of times of each file, and readers skip files by conditions on `ts`. One driver at a time writes
a commit of one name. Paths are those that pyarrow opens (local and shared folders, hdfs, s3)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "corpusloom_ledger"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    found, base = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return found, base.rstrip("/")


def commits(path: str) -> list[dict]:
    """Manifests in the order of their names."""
    files, base = _at(path)
    found = files.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True))
    return [json.loads(files.open_input_stream(f.path).read()) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".json")]


def vacuum(path: str) -> int:
    """Delete data files that no commit names; to be run when nobody writes. Returns their number."""
    files, base = _at(path)
    named = {f["file"] for c in commits(path) for f in c["files"]}
    lost = [f.path for f in files.get_file_info(fs.FileSelector(f"{base}/data", allow_not_found=True)) if f.path.rpartition("/")[2] not in named]
    for f in lost:
        files.delete_file(f)
    return len(lost)


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int
    low: str | None
    high: str | None


@dataclass
class Part(InputPartition):
    file: str


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("a ledger is only appended to")
        self.path, self.commit_name = options["path"], options.get("commit") or uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, base = _at(self.path)
        name, rows, low, high = f"{uuid.uuid4().hex}.parquet", 0, None, None
        files.create_dir(f"{base}/data")
        writer = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            writer = writer or pq.ParquetWriter(files.open_output_stream(f"{base}/data/{name}"), batch.schema)
            writer.write_batch(batch)
            rows += batch.num_rows
            span = pc.min_max(batch.column(batch.schema.get_field_index("ts"))).as_py()
            low, high = (f(x for x in (a, b) if x is not None) if a or b else None for f, a, b in ((min, low, span["min"]), (max, high, span["max"])))
        if writer:
            writer.close()
        return Written(name if rows else "", rows, low and low.isoformat(), high and high.isoformat())

    def commit(self, messages: list[Written | None]) -> None:
        files, base = _at(self.path)
        made = [m for m in messages if m and m.rows]
        final = f"{base}/commits/{self.commit_name}.json"
        files.create_dir(f"{base}/commits")
        if files.get_file_info(final).type != fs.FileType.NotFound:
            return self.abort(messages)  # this commit came through before
        held = f"{base}/commits/.{uuid.uuid4().hex}"
        with files.open_output_stream(held) as out:
            out.write(json.dumps({"commit": self.commit_name, "rows": sum(m.rows for m in made), "files": [{"file": m.file, "rows": m.rows, "low": m.low, "high": m.high} for m in made]}).encode())
        files.move(held, final)  # a reader sees all of the manifest or none

    def abort(self, messages: list[Written | None]) -> None:
        files, base = _at(self.path)
        for m in messages:
            if m and m.file:
                files.delete_file(f"{base}/data/{m.file}")


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.spans = options["path"], []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on ts skip files; rows are tested by Spark still."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("ts",) and isinstance(f.value, datetime):
                self.spans.append((type(f), f.value.replace(tzinfo=None)))
            yield f

    def _may_have(self, low: str | None, high: str | None) -> bool:
        if low is None or high is None:
            return not self.spans
        low_at, high_at = datetime.fromisoformat(low), datetime.fromisoformat(high)
        return all({EqualTo: low_at <= v <= high_at, GreaterThan: high_at > v, GreaterThanOrEqual: high_at >= v, LessThan: low_at < v, LessThanOrEqual: low_at <= v}[kind] for kind, v in self.spans)

    def partitions(self) -> list[Part]:
        return [Part(f["file"]) for c in commits(self.path) for f in c["files"] if self._may_have(f["low"], f["high"])] or [Part("")]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.file:
            files, base = _at(self.path)
            with files.open_input_file(f"{base}/data/{partition.file}") as f:
                yield from pq.ParquetFile(f).iter_batches()


class LedgerTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        from ..operators.ledger import SCHEMA

        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LedgerTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(runs: DataFrame, path: str, commit: str | None = None) -> None:
    """Add rows under the name of a commit; of commits of one name the first counts."""
    register(runs.sparkSession)
    names = [f.name for f in LedgerTable({}).schema().fields]
    runs.select(*names).write.format(NAME).option("path", path).option("commit", commit or uuid.uuid4().hex).mode("append").save()


def read(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).load()
