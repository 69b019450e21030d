"""What near-duplicate lines cost: words are counted in buckets, a round looks only where an open line has more, and memory is given back cheaply."""

import gc

import numpy as np
import pyarrow as pa

from corpusloom.llm import linededup
from corpusloom.llm.common import Scratch, in_arrow
from corpusloom.llm.sketch import bucket_counts


def test_workers_set_aside_what_modules_hold(spark):
    def run(batch):
        return pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()] * batch.num_rows)], ["n"])

    def counted():
        return [r.n for r in in_arrow(spark.range(8).repartition(2), run, "n long").collect()]

    counted()
    assert max(counted()) > 10_000


def test_bucket_counts_outgrow_a_task(spark):
    """Counts of a task fit 8 bits, their sums need 16; a large one stands beside small ones."""
    rows = spark.sparkContext.parallelize([(k,) for k in [3] * 2000 + [5] + [7] * 70_000], 10).toDF("k long")
    found = bucket_counts(rows, lambda batch: iter([batch.column(0).to_numpy()]), 20)
    assert {int(k): int(found[k]) for k in np.flatnonzero(found)} == {3: 2000, 5: 1, 7: 70_000}


def test_frequent_words_are_counted_exactly(spark):
    lines = spark.createDataFrame([([1, 2],)] * 6 + [([2, -3],)] * 5 + [(None,)], "prefix array<int>")
    n, full = linededup.group_sizes(lines.select("prefix"), 5)
    rows = lines.selectExpr("explode(prefix) AS word")
    assert (n, sorted(full)) == (22, sorted(linededup.bucket(pa.array([1, 2], pa.int32())))) and linededup.group_sizes(rows, 5)[0] == 22
    both = np.append(full, linededup.bucket(pa.array([-3], pa.int32())))  # as if -3 shared a bucket with one of them
    assert sorted(map(tuple, linededup.frequent(rows, both, 5).collect())) == [(1, 6), (2, 11)]


def test_a_round_looks_where_lines_have_more(spark):
    """Line 9 has three candidates by word 1 and one by word 2: with two handed on, only word 1 is looked at again."""
    bits = linededup.bitmaps(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.array([5]))[0].tobytes()
    lines = [(1, 0, [1]), (2, 0, [1]), (3, 0, [1]), (4, 0, [2]), (9, 0, [1, 2])]
    first = spark.createDataFrame([(d, p, 5, bytearray(bits), w) for d, p, w in lines], linededup.FIRST_SCHEMA)
    pairs, more = linededup.candidates(linededup.prefix_rows(first), first.select("prefix"), 0.5, 2, 100, Scratch(spark, "test"), "pairs")
    assert {(r.doc, r.doc2) for r in pairs.collect()} == {(2, 1), (3, 1), (3, 2), (9, 1), (9, 2), (9, 4)}
    assert [tuple(r) for r in more.collect()] == [(9, 0, 1)]
    around = linededup.touched(first, more).collect()
    assert {(r.doc, r.word, r.probe) for r in around} == {(1, 1, False), (2, 1, False), (3, 1, False), (9, 1, True)}
