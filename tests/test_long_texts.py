"""Cleaning by blocks against the cleaners of whole texts, for any size of blocks."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import line_cleaners as L
from corpusloom.operators import long_texts

SCHEMA = "key string, i long, line string"


def texts(seed: int) -> dict[str, list[str]]:
    rnd = random.Random(seed)
    kinds = ["2024-01-01T00:00:00Z INFO up id=12345", "2024-01-01T00:00:00Z WARN x", "", " ", "a", "a", "=====", "> > q", "b  ", "\rspin", "[==> ] 5%", "c 10.0.0.1:80", "--- b"]
    out = {}
    for name in ("one", "two", None, "empty"):
        rows = []
        while name != "empty" and len(rows) < 120:
            rows += [rnd.choice(kinds)] * rnd.choice([1, 1, 1, 2, 3, 5, 40])
        out[name] = rows
    out["same"] = ["x"] * 64
    return out


@pytest.mark.parametrize("block", [8, 13, 1 << 16])
def test_blocks_equal_whole_texts(spark, block):
    given = texts(1)
    rnd = random.Random(2)
    rows = []
    for key, lines in given.items():
        i = rnd.randrange(100)
        for line in lines:
            rows.append((key, i, line))
            i += rnd.choice([1, 1, 1, 4])
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    for got, whole in ((long_texts.log_lines(df, False, block), lambda s: L.log(s, "", False)), (long_texts.log_lines(df, True, block), lambda s: L.log(s, "", True)), (long_texts.plain_lines(df, block), L.plain)):
        found = {key: [] for key in given}
        for r in sorted(got.collect(), key=lambda r: r.i):
            found[r.key].append(r.line)
        assert {k: "\n".join(v) for k, v in found.items()} == {k: whole("".join(x + "\n" for x in v)) for k, v in given.items()}


def test_lines_of_split_files(spark, tmp_path):
    lines = [("line %d" % (k // 3)) * (k % 4) for k in range(5000)]
    path = tmp_path / "a.log"
    path.write_text("".join(x + "\n" for x in lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = long_texts.file_lines(spark, str(path))
        assert df.select("i").distinct().count() == 5000 and spark.read.text(str(path)).rdd.getNumPartitions() > 5
        assert [r.line for r in sorted(df.collect(), key=lambda r: r.i)] == lines
        long_texts.write_lines(long_texts.log_lines(df, False, 64), str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    written = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert written.rstrip("\n") == L.log("".join(x + "\n" for x in lines), "", False).rstrip("\n")


def test_no_lines(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert long_texts.log_lines(none).collect() == [] and long_texts.plain_lines(none).collect() == []
    odd = spark.createDataFrame([("k", 1, None), ("k", 2, "x"), ("k", 3, None)], SCHEMA)
    assert [r.line for r in long_texts.log_lines(odd).orderBy("i").collect()] == ["", "x", ""] and [r.line for r in long_texts.plain_lines(odd).collect()] == ["x"]
