"""Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The top and, for each leaf, its steps."""
    steps, places, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for k, p in enumerate(places):
            run, at = runs[p // 16], p % 16
            steps[k].append(("".join(run[:at]), "".join(run[at + 1 :])))
        places, level = [p // 16 for p in places], [sha("".join(r)) for r in runs]
    return level[0], steps


def brute(rows):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops, kept = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        top, steps = tree([leaf(r) for r in own])
        tops.append(top)
        kept.append(list(zip(own, steps, strict=True)))
    root, upper = tree(tops)
    return sorted((repr(r[0]), leaf(r), top, root, repr(steps + more)) for k, (top, more) in enumerate(zip(tops, upper, strict=True)) for r, steps in kept[k])


def found(df):
    return sorted((repr(r.id), r.leaf, r.subroot, r.root, repr([(s.before, s.after) for s in r.steps])) for r in df.collect())


ROWS = (
    [(k, "hot", "en", k, f"Text {k}") for k in range(300)]  # three levels, a last run of 12 and one of 3
    + [(k, "run", None, None, "") for k in range(17)]  # a last run of one node
    + [(5, "tie", "en", 1, "b"), (5, "tie", "en", 1, "a"), (None, "tie", "en", 1, None), (7, "tie", "de", 2, "same"), (7, "tie", "de", 2, "same")]
    + [(k, None, "fr", 3, "É" * 50) for k in range(2)]
    + [(k, f"s{k}", "en", 0, "x") for k in range(20)]  # more groups than fit one run
    + [(1, "", "en", 0, "long " * 200_000)]
)


def test_trees_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    assert found(merkle.manifest(df)) == brute(ROWS)


@pytest.mark.parametrize("rows", [[(1, "a", "en", 1, "x")], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x")], [(k, "a", "en", 1, "x") for k in range(33)]])
def test_small_tables(spark, rows):
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_folding_shows_changed_rows_only(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    shown = F.when(F.col("doc_id") % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    got = merkle.manifest(df, presented={"text": shown}).select("id", "leaf", "presented", (merkle.fold(F.col("presented"), F.col("steps")) == F.col("root")).alias("ok")).collect()
    assert len(got) == len(ROWS) and all(r.ok == (r.leaf == r.presented) for r in got)
    assert {r.id for r in got if not r.ok} == {k for k in range(300) if k % 3 == 0}  # texts of the hot source alone have A-Z


def test_columns_of_other_names_and_clashes(spark):
    rows = [(k, f"g{k % 2}", f"T{k}", "e") for k in range(40)]
    df = spark.createDataFrame(rows, "`my.id` long, `g` string, digest string, idx string")
    got = merkle.manifest(df, "g", "my.id", ["my.id", "digest"]).collect()
    assert {r.id: r.leaf for r in got} == {k: sha(f"{len(str(k))}:{k}{len(t)}:{t}") for k, _, t, _ in rows}
    assert len({r.root for r in got}) == 1 and {r.group for r in got} == {"g0", "g1"}
