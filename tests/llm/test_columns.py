"""Operators that give rows back: the caller's columns keep their values, whatever their names, and ids are whole numbers."""

import pytest

from corpusloom.llm import dartminhash, linededup

NAMES = ("_id", "_hash", "_removed", "_id_0", "_hash_0", "_removed_0", "salt", "hash", "doc", "place", "label", "a.b")


def frame(spark):
    line = "one two three four five six"
    rows = [(1, line), (2, f"keep\n{line.upper()}"), (2, f"keep\n{line.upper()}"), (3, None), (None, ""), (4, line)]
    made = [(i, t, *[f"{n}{k}" for n in NAMES]) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(made, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES)), made


def test_line_dedup_keeps_values(spark):
    df, made = frame(spark)
    want = [(m[0], {1: "keep", 2: "keep", 5: ""}.get(k, m[1]), *m[2:]) for k, m in enumerate(made)]
    out = linededup.dedup_lines(df, least_words=1)
    assert out.columns == df.columns and sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_near_dedup_keeps_values(spark):
    df, made = frame(spark)
    out = dartminhash.keep_first(df)
    got = list(map(tuple, out.collect()))
    assert out.columns == df.columns and all(g in made for g in got)
    assert sorted((g[0] for g in got), key=str) == [1, 2, None]  # the empty texts are copies; a null id comes first


def test_very_long_line_and_ids(spark):
    long = " ".join(f"v{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long), (2, long + " more"), (-(2**63), "a b c d e f")], "doc_id long, text string")
    assert {r._id: r._removed for r in linededup.removals(df, least_words=5).collect()} == {2: [0]}
    for call in (linededup.dedup_lines, dartminhash.keep_first):
        with pytest.raises(TypeError, match="whole numbers"):
            call(df.selectExpr("'x' AS doc_id", "text"))


def test_rounds_find_the_one_match_among_many_candidates(spark):
    """A line with many earlier lines that pass the filters by their number alone: one of the last is the match."""
    base = [f"b{i}" for i in range(40)]
    docs = [(i, " ".join(base[:31] + [f"x{i}y{k}" for k in range(9)])) for i in range(30)]  # 31 of 49 in common
    docs += [(90, " ".join(base[:38] + ["q", "r"])), (99, " ".join(base))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert {r._id: r._removed for r in linededup.removals(df, least_words=5).collect()} == {99: [0]}
