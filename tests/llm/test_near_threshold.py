"""Near-duplicates on both sides of the threshold: links are decided on the runs themselves."""

import random

import numpy as np
import pytest

from corpusloom.llm import dartminhash
from tests.llm.test_sets import jaccard


def close_docs():
    """Pairs with 87 to 90 of their 100 runs in common: similarities of 0.770, 0.786, 0.802 and 0.818."""
    rng, docs = random.Random(2), []
    for i in range(120):
        base = [f"p{i}x{k}" for k in range(104)]
        keep = 87 + i % 4 + 4
        docs += [" ".join(base), " ".join(base[:keep] + [f"q{i}x{k}" for k in range(104 - keep)])]
    order = list(range(len(docs)))
    rng.shuffle(order)
    return [(i, docs[i]) for i in order]


@pytest.mark.parametrize("shard", [1000, 1])
def test_pairs_near_the_threshold(spark, shard):
    docs = close_docs()
    text = dict(docs)
    want = {i: i - i % 2 if jaccard(text[i - i % 2], text[i - i % 2 + 1]) >= 0.8 else i for i in text}
    assert 120 < len(set(want.values())) < 240
    got = dartminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard=shard)
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_numbered_elements_stand_for_weights():
    a, b = [3, 3, 3, 5, 7], [3, 3, 5, 5, 9]  # shared 2 + 1, of 3 + 2 + 1 + 1
    name, first = dartminhash.numbered(np.repeat([0, 2], 5), np.array(a + b, np.uint64), 3)
    one, two = name[first[0] : first[1]], name[first[2] : first[3]]
    assert first.tolist() == [0, 5, 5, 10] and len(np.intersect1d(one, two)) == 3
    assert dartminhash.similar(one, two, 3 / 7) and not dartminhash.similar(one, two, 0.43)
