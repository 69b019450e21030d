"""Transcripts as a data source: ranges of any size, pushed conditions, and what is appended to a file."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import documents, transcript_source as T


def message(text, kind="user"):
    return json.dumps({"type": kind, "message": {"content": text}}, separators=(",", ":"), ensure_ascii=False)


def write(root, name, lines):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "a", encoding="utf-8", newline="") as f:
        f.write("".join(lines))


@pytest.fixture
def root(tmp_path):
    for k in range(3):
        write(tmp_path, f"p{k}/s.jsonl", [message(f"é{k} {n} " + "x" * (n * 7 % 90)) + "\n" for n in range(50)])
    write(tmp_path, "p0/deep/a/b.jsonl", [message("three down") + "\n"])
    write(tmp_path, "p0/deep/a/b/c.jsonl", [message("too deep") + "\n"])
    write(tmp_path, "top.jsonl", [message([{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]) + "\n", "\n", '{"type":"user" broken\n', message("of the assistant", "assistant") + "\n", message("") + "\n", message(None) + "\n", message(7) + "\n", '["type":"user"]\n', message("last, without an end")])
    write(tmp_path, "p0/other.txt", [message("no transcript") + "\n"])
    return tmp_path


def load(spark, root, **options):
    T.register(spark)
    return spark.read.format(T.NAME).options(**options).load(str(root))


def test_ranges_of_any_size(spark, root):
    want = None
    for size in (1, 17, 100, 4096, 1 << 20):
        df = load(spark, root, range_bytes=size if size > 1 else 30)
        got = sorted((r.session, r.at, r.text) for r in df.collect())
        assert want is None or got == want
        want = got
    assert len(want) == 153 and {t for s, _, t in want if s == "top.jsonl"} == {"a\nb", "last, without an end"}
    assert ("p0/deep/a/b.jsonl", 0, "three down") in want
    assert sorted(t for _, _, t in want) == sorted(r.text for r in documents.transcripts(spark, str(root)).collect())


def test_conditions_skip_files(spark, root):
    os.utime(root / "p2/s.jsonl", (1_000_000_000, 1_000_000_000))
    df = load(spark, root)
    assert {r.project for r in df.where("project IN ('p1', 'p2')").collect()} == {"p1", "p2"}
    recent = df.where((F.col("modified") >= F.lit("2020-01-01").cast("timestamp")) & (F.col("depth") == 1))
    assert {r.session for r in recent.collect()} == {"p0/s.jsonl", "p1/s.jsonl"} and recent.rdd.getNumPartitions() == 2
    assert df.where("depth > 2").collect()[0].text == "three down"
    assert df.where("text = 'three down' AND project = 'p0'").count() == 1
    assert df.where("project = 'none'").count() == 0 and load(spark, root / "nothing").count() == 0


def test_stream_goes_on_where_it_stopped(spark, root, tmp_path):
    T.register(spark)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stream = spark.readStream.format(T.NAME).option("range_bytes", "64").load(str(root))
        stream.writeStream.option("checkpointLocation", cp).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
        return sorted(r.text for r in spark.read.parquet(out).collect())

    first = run()
    assert len(first) == 152 and "last, without an end" not in first  # a line without an end may not be whole yet
    write(root, "top.jsonl", ["\n", message("half ")[:-4]])
    write(root, "p9/new.jsonl", [message("of a new file") + "\n"])
    second = run()
    assert sorted(set(second) - set(first)) == ["last, without an end", "of a new file"] and len(second) == 154
    write(root, "top.jsonl", [message("half ")[-4:] + "\n"])
    assert len(run()) == 155
