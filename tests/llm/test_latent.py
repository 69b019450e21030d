"""Latent semantic retrieval: the decomposition against an exact one, and what it finds against a scan without it."""

import random

import numpy as np
import pytest

from corpusloom.llm import decontam


def passages(spark, parts):
    words = np.unique(np.concatenate(parts))
    table = spark.createDataFrame([(k, p.tobytes()) for k, p in enumerate(parts)], "number int, words binary").repartition(3)
    return decontam.Passages(table, words, np.linspace(1, 2, len(words)))


def dense(p, parts):
    a = np.zeros((len(parts), len(p.words)))
    row, number, value = decontam.weighted_rows(parts, p.words, p.idf)
    a[row, number] = value
    return a


def test_randomised_svd_equals_exact_one(spark):
    rng = np.random.default_rng(4)
    parts = [rng.choice(30 + 100 * (k % 3), 25).astype(np.uint64) for k in range(40)]
    p = passages(spark, parts)
    a = dense(p, parts)
    assert np.allclose(np.linalg.norm(a, axis=1), 1)
    left = rng.normal(size=(len(p.words), 5))
    assert np.allclose(p.gram(left, height=7), a.T @ (a @ left)) and np.allclose(p.small(left), (a @ left).T @ (a @ left))
    assert np.allclose(p.coordinates(left, len(parts)), a @ left, atol=1e-5)
    basis = decontam.randomised_svd(p, 20)
    exact = np.linalg.svd(a)[1]
    assert np.allclose(basis.T @ basis, np.eye(20), atol=1e-8)
    made = np.linalg.norm(a @ basis, axis=0)
    assert np.allclose(made[:8], exact[:8], rtol=0.05) and (made[:20] ** 2).sum() >= 0.95 * (exact[:20] ** 2).sum()


def test_rank_is_cut(spark):
    """Passages that share words need fewer directions than there are passages; each keeps half of its squared length."""
    rng = np.random.default_rng(5)
    parts = [rng.choice(60, 40).astype(np.uint64) for _ in range(50)]
    p = passages(spark, parts)
    basis, place = decontam.latent(p, 50, 0.5)
    assert basis.shape[1] < 25 and ((place**2).sum(1) >= 0.5).all()
    alone = [np.arange(10 * k, 10 * k + 10).astype(np.uint64) for k in range(6)]
    basis, place = decontam.latent(passages(spark, alone), 6, 0.5)
    assert ((place**2).sum(1) >= 0.5).all()


def corpus():
    """Passages and documents over a common vocabulary: copies, paraphrases, and documents without any."""
    rng = random.Random(21)
    vocab = [f"v{i}" for i in range(900)]
    items = [rng.choices(vocab, k=rng.randint(15, 60)) for _ in range(60)]
    docs = []
    for i in range(150):
        w = rng.choices(vocab, k=250)
        if i % 2 == 0:
            p = list(items[i // 2 % 60])
            if i % 4 == 0:
                for j in rng.sample(range(len(p)), len(p) // 4):
                    p[j] = rng.choice(vocab)
            at = rng.randrange(len(w))
            w[at:at] = p
        docs.append((i, " ".join(w)))
    return items, docs


def scan(items, docs, copy=0.8, paraphrase=0.6):
    """All pairs by the longest common subsequence with any stretch of three passage lengths; the answer check is left out."""
    found = set()
    for i, text in docs:
        w = text.split()
        for k, p in enumerate(items):
            share = max(decontam.common_subsequence(np.array(p), np.array(w[a : a + 3 * len(p)])) for a in range(0, len(w), len(p))) / len(p)
            if share >= copy or (share >= paraphrase and i % 4 == 0 and k == i // 2 % 60):
                found.add((i, k))
    return found


@pytest.fixture(scope="module")
def frames(spark):
    items, docs = corpus()
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(items)], "item_id long, text string")
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(4), bench, scan(items, docs)


def test_recall_against_unfiltered_scan(frames):
    df, bench, want = frames
    got = {(r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()}
    assert len(want) >= 75 and len(got & want) >= 0.9 * len(want) and len(got - want) <= 0.02 * len(want)


def test_nothing_is_found_without_the_decomposition(frames, monkeypatch):
    df, bench, want = frames
    monkeypatch.setattr(decontam, "randomised_svd", lambda p, columns: np.full((len(p.words), columns), 1e-3))
    monkeypatch.setattr(decontam, "latent", lambda p, n, kept: (lambda b: (b, p.coordinates(b, n)))(decontam.randomised_svd(p, 15)))
    got = {(r.doc_id, r.item_id) for r in decontam.matches(df, bench, cosine=0.6).collect()}
    assert len(got & want) < 0.5 * len(want)


def test_odd_cases(spark):
    item = "one two three four five six seven eight"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "x")], "item_id long, text string")
    pad = " ".join(f"p{i}" for i in range(100_000))
    docs = spark.createDataFrame([(1, f"{pad} {item} {pad}", "a"), (2, item, "b"), (2, item, "b"), (3, pad, None), (4, None, "c")], "doc_id long, text string, item_id string")
    got = sorted((r.doc_id, r.first_word > 0) for r in decontam.matches(docs.drop("item_id"), bench).collect())
    assert got == [(1, True)] * 2 + [(2, False)] * 4  # the passage is there twice, and so is the row
    clean = decontam.clean(docs, bench)
    assert clean.columns == docs.columns and sorted((r.doc_id, r.item_id) for r in clean.collect()) == [(3, None), (4, "c")]
    with pytest.raises(TypeError):
        decontam.clean(docs, bench, windows=3)
