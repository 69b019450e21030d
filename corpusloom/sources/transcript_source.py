"""User messages of JSONL transcripts as a data source, in batches and as a stream.

    spark.read.format("corpusloom_transcripts").load(root).where("project = 'p' AND modified >= TIMESTAMP '2024-01-01'")
    spark.readStream.format("corpusloom_transcripts").load(root)

Files are read in ranges of bytes (`range_bytes`), so one long transcript is shared by many tasks: a range has the lines that begin in it.
Conditions on `project` (first folder below the root), `session` (file), `depth` (folders between) and `modified` are pushed to the listing, so other files are not
opened. Files deeper than `most_depth` folders are left out, and lines are tested for the user mark before they are parsed. A stream's offset is the size of
each file up to its last whole line; what is appended later is read from there. Names of files end in `suffix`. Paths are those that
pyarrow opens (local and shared folders, hdfs, s3)."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .documents import MOST_DEPTH, USER_MARK

NAME = "corpusloom_transcripts"
SCHEMA = "project string, session string, depth int, modified timestamp, at long, text string"
RANGE_BYTES = 8 << 20
_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}
_ARROW = pa.schema([("project", pa.string()), ("session", pa.string()), ("depth", pa.int32()), ("modified", pa.timestamp("us", "UTC")), ("at", pa.int64()), ("text", pa.string())])


def user_text(line: bytes) -> str | None:
    """Text of a user message: a string, or its parts of type text joined by line feeds; None where there is none."""
    try:
        content = json.loads(line)["message"]["content"]
        if isinstance(content, list):
            content = "\n".join(p["text"] for p in content if isinstance(p, dict) and p.get("type") == "text" and isinstance(p.get("text"), str))
    except (ValueError, KeyError, TypeError):
        return None
    return content if isinstance(content, str) and content else None


@dataclass
class Range(InputPartition):
    path: str
    project: str
    session: str
    depth: int
    modified: datetime
    start: int
    end: int


class Files:
    def __init__(self, options: dict):
        path = options["path"]
        self.files, base = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        self.base, self.path = base.rstrip("/"), path
        self.suffix, self.most_depth, self.range_bytes = options.get("suffix", ".jsonl"), int(options.get("most_depth", MOST_DEPTH)), int(options.get("range_bytes", RANGE_BYTES))

    def found(self, wanted) -> Iterator[tuple[fs.FileInfo, dict]]:
        for f in sorted(self.files.get_file_info(fs.FileSelector(self.base, recursive=True, allow_not_found=True)), key=lambda f: f.path):
            below = f.path[len(self.base) + 1 :].split("/")
            facts = {"project": below[0] if len(below) > 1 else "", "session": "/".join(below), "depth": len(below) - 1, "modified": f.mtime}
            if f.type == fs.FileType.File and f.path.endswith(self.suffix) and facts["depth"] <= self.most_depth and wanted(facts):
                yield f, facts

    def ranges(self, f: fs.FileInfo, facts: dict, start: int, end: int) -> list[Range]:
        return [Range(f.path, facts["project"], facts["session"], facts["depth"], facts["modified"], at, min(at + self.range_bytes, end)) for at in range(start, end, self.range_bytes)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows, mark = [], USER_MARK.encode()
        with self.files.open_input_file(part.path) as raw:
            raw.seek(max(0, part.start - 1))
            f = io.BufferedReader(raw, 1 << 18)
            at = part.start
            if part.start:
                at = part.start - 1 + len(f.readline())  # a line that begins before belongs to the range before
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                text = user_text(line) if mark in line else None
                if text is not None:
                    rows.append((at, text))
                    if len(rows) == 1024:
                        yield self.batch(part, rows)
                        rows = []
                at += len(line)
        if rows:
            yield self.batch(part, rows)

    @staticmethod
    def batch(part: Range, rows: list[tuple[int, str]]) -> pa.RecordBatch:
        n = len(rows)
        columns = [[part.project] * n, [part.session] * n, [part.depth] * n, [part.modified] * n, [r[0] for r in rows], [r[1] for r in rows]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)], schema=_ARROW)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.tests = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Conditions on what a file's name and time tell are done with; others are left to Spark."""
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in ("project", "session", "depth", "modified"):
                self.tests.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def wanted(self, facts: dict) -> bool:
        return all(_TESTS[kind](facts[name], value) for kind, name, value in self.tests)

    def partitions(self) -> list[Range]:
        files = Files(self.options)
        return [r for f, facts in files.found(self.wanted) for r in files.ranges(f, facts, 0, f.size)] or [Range("", "", "", 0, datetime.min, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from Files(self.options).read(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """For each file the end of its last whole line."""
        files, ends = Files(self.options), {}
        for f, facts in files.found(lambda facts: True):
            with files.files.open_input_file(f.path) as raw:
                end = f.size
                while end > 0:
                    start = max(0, end - (1 << 16))
                    raw.seek(start)
                    place = raw.read(end - start).rfind(b"\n")
                    if place >= 0:
                        ends[facts["session"]] = start + place + 1
                        break
                    end = start
        return ends

    def partitions(self, start: dict, end: dict) -> list[Range]:
        files = Files(self.options)
        known = {facts["session"]: (f, facts) for f, facts in files.found(lambda facts: facts["session"] in end)}
        return [r for name, upto in end.items() if name in known for r in files.ranges(*known[name], start.get(name, 0), upto)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from Files(self.options).read(partition)

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Transcripts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
