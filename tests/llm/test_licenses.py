"""License scan: filters against brute force, precision on texts that only sound like a license, odd tables."""

from __future__ import annotations

import random

import numpy as np
import pytest

from corpusloom.llm import licenses

from .test_sets import words

T = licenses.TEMPLATES


def labels(spark, texts):
    got = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: {b.label for b in r.blocks} for r in got}


def test_no_label_without_its_words(spark):
    texts = [
        "The film was released under the license of the studio",
        "a poem released under license from the estate",
        "licensed under the GPL license version 2 0",
        "the license under which it was released is not the one you want",
        "Licensed under a Creative Commons Attribution 4.0 International License.",
        "No part of the journey may be reproduced; all work is copyright.",
        "permission is granted to any person to use the software without charge",
    ]
    assert labels(spark, texts) == {k: set() for k in range(len(texts))}


def test_whole_and_damaged_texts(spark):
    rnd = random.Random(2)
    texts, want = [], {}
    for label, body, needed in T:
        w = words(body)
        free = [k for k in range(len(w)) if w[k] not in needed and w.count(w[k]) == 1]
        lost = set(rnd.sample(free, min(len(free), int(0.15 * len(set(w))))))  # 15 of 100 distinct words are replaced
        for damaged in (w, [f"x{k}" if k in lost else x for k, x in enumerate(w)]):
            pad = [f"z{rnd.randrange(999)}" for _ in range(rnd.randrange(200))]
            want[len(texts)] = label
            texts.append(" ".join(pad + damaged + pad[:20]))
    found = labels(spark, texts)
    assert all(want[k] in found[k] for k in want)


@pytest.mark.parametrize("seed", range(4))
def test_join_equals_brute_force(seed):
    """Any frequencies, so any order: each filter leaves a superset of the matches, and each filters something."""
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    templates = [(f"t{k}", " ".join(rnd.choice(vocab) for _ in range(rnd.randint(3, 25))), ()) for k in range(6)] + [("n", "w1 w2 w3 w4 w5 w6", ("w1",))]
    t = licenses.Templates.of(templates, ())
    plans, rank = licenses.joins(t, np.array([rnd.randrange(50) for _ in t.words]), 0.8)
    number = {w: int(np.searchsorted(t.words, licenses._word_hashes(w)[0])) for w in vocab if licenses._word_hashes(w)[0] in t.words}
    docs = []
    for _ in range(40):
        parts = [rnd.choice(templates)[1].split() if rnd.random() < 0.5 else [rnd.choice(vocab + ["other"] * 30) for _ in range(20)] for _ in range(3)]
        docs.append([w if rnd.random() < 0.9 else "other" for p in parts for w in p])
    flat = [(r, p, number[w]) for r, d in enumerate(docs) for p, w in enumerate(d) if w in number]
    row, place, known = (np.array(x, np.int64) for x in zip(*flat, strict=True))
    seen = dict.fromkeys(licenses.FILTERS, 0)
    for j, (_, body, needed) in zip(plans, templates, strict=True):
        n, s = len(body.split()), set(body.split())
        want = {(r, b // n, len(s & set(d[b : b + 2 * n]))) for r, d in enumerate(docs) for b in range(0, len(d), n) if len(s & set(d[b : b + 2 * n])) >= 0.8 * len(s) - 1e-9 and set(needed) <= set(d[b : b + 2 * n])}
        got = set(zip(*(x.tolist() for x in j.matches(rank[known], place, row, len(rank), seen)), strict=True))
        assert got == want
    assert seen["prefix"] > seen["length"] > seen["positional"] > seen["verified"] > 0


def test_odd_tables(spark):
    schema = "`my.id` long, `my.text` string, spans string"
    assert licenses.scan(spark.createDataFrame([], schema), "my.id", "my.text").collect() == []
    long = "word " * 300_000 + T[0][1] + " word" * 1000
    got = licenses.scan(spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, None, "x"), (3, "", "x")], schema), "my.id", "my.text").collect()
    assert [({b.label for b in r.blocks}, r.n_words > 300_000) for r in sorted(got, key=lambda r: r["my.id"])] == [({"mit"}, True)] * 2 + [(set(), False)] * 2
