"""Stages of the corpus pipeline: nulls, empty and very long texts, repeated rows, an empty table, columns of clashing names."""

from __future__ import annotations

import pytest

import corpus_pipeline
from corpusloom.llm.common import LIVE

NAMES = ("lang_pred", "score", "fit", "_id", "_hash", "label", "sequence_id", "a.b")
PASSAGE = "which of the following rivers is the longest one that flows through the old town and reaches the northern sea after many bends"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    prose = "The house of the old man stands near the river and the water is cold in the winter."
    texts = [prose, prose, None, "", "12 !!", f"{prose}\nA line of its own about the boats.", f"Some words before it. {PASSAGE} And some more words behind it.", " ".join(f"the man number {k} and the house" for k in range(30_000))]
    rows = [(k, t, "en", "s", 1, *[f"{n}{k}" for n in NAMES]) for k, t in enumerate(texts)]
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES))
    return df, rows, str(at)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, data, name, stage):
    df, rows, at = data
    got = stage(spark, df, at).collect()
    none = stage(spark, df.limit(0), at)
    assert none.collect() == []
    if name == "pack":
        assert {r.doc_id for r in got} == {r[0] for r in rows} and sum(r.start == 0 for r in got) == len(rows)
        return
    assert none.columns == df.columns and stage(spark, df, at).columns == df.columns
    whole = {r[0]: r for r in rows}
    ids = sorted(r.doc_id for r in got)
    want = {"language": [0, 1, 5, 5, 6, 7], "line_dedup": [0, 1, 2, 3, 4, 5, 5, 6, 7], "decontaminate": [0, 1, 2, 3, 4, 5, 5, 7]}.get(name)
    assert want is None or ids == want
    if name == "near_dedup":
        assert 0 in ids and 1 not in ids and ids.count(5) == 1 and {6, 7} <= set(ids)
    for r in got:
        others = [k for k in range(len(r)) if df.columns[k] != "text"]
        assert [r[k] for k in others] == [whole[r.doc_id][k] for k in others]
        assert name == "line_dedup" or r.text == whole[r.doc_id][1]


def test_run_leaves_its_result_only(spark, data, tmp_path):
    df, _, at = data
    df.drop(*[f"`{n}`" if "." in n else n for n in NAMES]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = len(LIVE)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert len(LIVE) == before + 1
