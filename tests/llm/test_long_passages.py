"""Decontamination: passages much longer than a window are found, once each, whatever the blocks."""

import random

import pytest

from corpusloom.llm import decontam


@pytest.mark.parametrize("block_items", [256, 7])
def test_long_passages_are_found(spark, block_items):
    rng = random.Random(13)
    fresh = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    items = [fresh(n) for n in (20, 97, 2500)]
    docs = [(k, " ".join(fresh(150) + p + fresh(150))) for k, p in enumerate(items)]
    docs += [(3, " ".join(fresh(300))), (4, " ".join(items[2][:1000]))]  # two fifths of a passage are no copy
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.covered) for r in decontam.matches(df, bench, block_items=block_items).collect())
    assert got == [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]
    assert {r.doc_id for r in decontam.clean(df, bench, block_items=block_items).collect()} == {3, 4}
