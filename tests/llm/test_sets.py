"""Line dedup, near-duplicates, license scan, decontamination and rules against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import _bytes as B
from corpusloom.llm import dartminhash, decontam, licenses, linededup, rules
from corpusloom.llm.common import Scratch
from corpusloom.llm.graph import components

VOCAB = [f"w{i}" for i in range(400)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def line_docs():
    rng, docs = random.Random(5), []
    base = [" ".join(rng.choices(VOCAB, k=rng.choice([3, 6, 20, 60, 250]))) for _ in range(25)]
    for i in range(60):
        rows = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(VOCAB)
            rng.shuffle(w)
            rows.append(" ".join(w))
        docs.append((i, "\n".join(rows)))
    return docs


def brute_lines(docs, t=0.8, least=5):
    seen, out = [], {}
    for i, text in sorted(docs):
        for k, row in enumerate((text or "").split("\n")):
            s = frozenset(words(row))
            if len(s) >= least:
                if any(len(s & o) >= t * len(s | o) - 1e-9 for o in seen):
                    out.setdefault(i, []).append(k)
                seen.append(s)
    return out


@pytest.mark.parametrize("hot", [20_000, 5])
def test_line_dedup_equals_brute_force(spark, hot):
    docs = line_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r._id: r._removed for r in linededup.removals(df, least_words=5, hot=hot).collect()}
    assert got == brute_lines(docs)


def test_line_dedup_cases(spark):
    line = "one two three four five six"
    rows = [(1, line + "\nshort one", 1), (2, "keep\n" + line.upper() + "\nshort one", 2), (None, None, 3), (3, "", 4), (2, "keep\n" + line.upper() + "\nshort one", 2), (4, line + "\n" + line, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line int").withColumn("_id", F.lit(7))
    out = linededup.dedup_lines(df, least_words=5)
    assert out.columns == df.columns
    got = sorted((r.doc_id or -1, r.text) for r in out.collect())
    assert got == sorted([(1, line + "\nshort one"), (2, "keep\nshort one"), (2, "keep\nshort one"), (-1, None), (3, ""), (4, "")])
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def weighted(text):
    w = words(text)
    return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)])


def jaccard(a, b):
    a, b = weighted(a), weighted(b)
    return sum((a & b).values()) / sum((a | b).values())


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    n = 300
    e = rng.integers(0, 2**63, n).astype(np.uint64)
    a, b = rng.uniform(0.2, 4, n), rng.uniform(0.2, 4, n)
    row, element = np.repeat([0, 1], n), np.concatenate((e, e))
    s = dartminhash.signatures(row, element, np.concatenate((a, b)), 2, 2048)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
    alone = dartminhash.signatures(np.zeros(n, np.int64), e[::-1].copy(), a[::-1].copy(), 1, 2048)
    assert (alone[0] == s[0]).all()  # a signature depends on the set alone
    assert dartminhash.signatures(np.zeros(1, np.int64), e[:1], np.ones(1), 2, 64)[1].sum() == 0


def near_docs():
    rng, docs = random.Random(9), []
    for g in range(6):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(400)]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            docs.append(" ".join(w))
    docs += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(100)) for _ in range(20)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("shard", [1000, 3])
def test_near_duplicates_equal_brute_force(spark, shard):
    docs = near_docs()
    label = {i: i for i, _ in docs}
    for i, a in docs:
        for j, b in docs:
            if i < j and jaccard(a, b) >= 0.8:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    got = dartminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shard=shard)
    assert {r.doc_id: r.class_id for r in got.collect()} == label


def test_near_duplicate_cases(spark):
    long = " ".join(f"v{i}" for i in range(30000))
    rows = [(5, "a b c d e f"), (3, "A b, c d e f!"), (9, None), (8, ""), (3, "A b, c d e f!"), (7, "one two"), (6, "one two"), (1, long), (2, long + " x"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("class_id", F.lit(2))
    got = sorted(((r.doc_id or -1, r.class_id) for r in dartminhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, None), (3, None), (3, None), (-1, None), (9, 8), (8, 8), (7, 6), (6, 6), (1, 1), (2, 1)], key=str)
    kept = dartminhash.keep_first(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 6, 8]
    assert dartminhash.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (102, 100)]
    got = components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect()
    assert {r.node: r.label for r in got} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_license_scan(spark):
    mit = licenses.TEMPLATES[1][1]
    pad = " ".join(f"z{i}" for i in range(100))
    rows = [(1, f"{pad} Released under THE MIT License. under the mit\nlicense"), (2, None), (3, pad), (4, f"{pad} {mit} {pad}"), (5, f"{pad} {mit[:60]} {pad}"), (6, "cc-by-nc cc by/nc"), (1, "mit license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    one = by[(1, 109)]
    assert [(s.label, s.first_word) for s in one.spans] == [("mit", 101), ("mit", 105)] and {b.label for b in one.blocks} == {"mit"}
    assert by[(2, 0)].spans == [] and by[(3, 100)].blocks == []
    four = next(r for r in got if r.doc_id == 4)
    assert four.spans == [] and {b.label for b in four.blocks} == {"mit"} and max(b.containment for b in four.blocks) == 1.0
    assert next(r for r in got if r.doc_id == 5).blocks == []
    assert [s.first_word for s in by[(6, 6)].spans] == [0, 3]
    # brute force over blocks
    texts = dict((i, t) for i, t in rows[:6])
    for i, t in texts.items():
        w, want = words(t), set()
        for label, body, needed in licenses.TEMPLATES:
            s, n = set(words(body)), len(words(body))
            want |= {label for b in range(0, max(1, len(w)), n) if len(s & (found := set(w[b : b + 2 * n]))) >= 0.8 * len(s) - 1e-9 and found >= set(needed)}
        assert {b.label for b in next(r for r in got if r.doc_id == i).blocks} == want


def brute_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(0, 80))
        assert decontam.common_subsequence(a, b) == brute_lcs(a.tolist(), b.tolist())


def test_decontamination(spark):
    rng = random.Random(4)
    fresh = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    items = [fresh(n) for n in (8, 16, 40, 60, 200)]
    docs, want = [], set()
    for i in range(60):
        w = fresh(300)
        if i % 3 == 0:
            k = i // 3 % len(items)
            p = list(items[k])
            if i % 2:  # a paraphrase: some words differ, the end stands
                for j in range(0, len(p) * 3 // 4, 5):
                    p[j] = "other"
            at = rng.randrange(len(w))
            w[at:at] = p
            want.add((i, k))
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(items)] + [(98, ""), (99, None)], "item_id long, text string")
    df = spark.createDataFrame(docs + [(100, None), (101, ""), (0, docs[0][1])], "doc_id long, text string").withColumn("cosine", F.lit(1))
    got = decontam.matches(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want) + 1
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, *_ in docs + [(100,), (101,)]} - {i for i, _ in want}
    assert decontam.matches(df, bench.limit(0)).count() == 0 and decontam.matches(df.limit(0), bench).count() == 0


def test_hot_passage_is_still_found(spark):
    """A passage in a third of all documents."""
    rng = random.Random(6)
    item = [f"h{i}" for i in range(16)]
    docs = [(i, " ".join([f"n{rng.randrange(10**6)}" for _ in range(120)] + (item if i % 3 == 0 else []))) for i in range(300)]
    bench = spark.createDataFrame([(0, " ".join(item))] + [(k, " ".join(f"b{k}x{j}" for j in range(30))) for k in range(1, 20)], "item_id long, text string")
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {r.doc_id for r in got.collect()} == {i for i, _ in docs if i % 3 == 0}


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    rows = [r for r in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", r)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(rows) - len(set(rows)), len(hit)


def test_rules(spark):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a a a a", "é ü\n\né ü\n x\nx", "# $ | <b>\r\n#", "word " * 5000]
    texts += ["".join(rng.choices("ab  \n\té#$", k=rng.randint(0, 300))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash")).withColumn("kept", F.lit(1))
    got = {r.doc_id: r for r in rules.ledger(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t), t
        assert bool(r.fail_bits & 1) == (r.n_words < 50) and bool(r.fail_bits & 2) == (100 * r.n_repeat_words > 50 * r.n_words)
    entries = rules.ledger(df).cache()
    kept = rules.apply_policy(entries, rules.PROSE).where("kept").count()
    rows = {r.rule: r for r in rules.ablations(entries, rules.PROSE).collect()}
    bits = [got[i].fail_bits & rules.PROSE.mask for i in got]
    for rule in rules.RULES:
        if rule.name in rules.PROSE.rules:
            a = rows[rule.name]
            assert (a.rejected, a.rejected_alone, a.kept, a.kept_without) == (sum(bool(b >> rule.bit & 1) for b in bits), bits.count(1 << rule.bit), kept, kept + bits.count(1 << rule.bit))
    assert rules.ledger(df.limit(0)).count() == 0 and all(r.kept == 0 for r in rules.ablations(entries.limit(0), rules.PROSE).collect())


def test_chunks_and_hashes():
    col = pa.array(["ab cd", None, "", "x" * 100_000, "cd ab"])
    parts = list(B.chunks(col, 10))
    assert [(c.first, c.last) for c in parts][-1][1] == 5 and sum(c.rows for c in parts) == 5
    hashes = [h for c in parts for h in B.words(c, B.NON_SPACE).hash.tolist()]
    assert hashes[0] == hashes[4] and hashes[1] == hashes[3] and len(set(hashes)) == 3
    sliced = pa.array(["skip", "ab cd"])[1:]
    assert B.words(next(B.chunks(sliced)), B.NON_SPACE).hash.tolist() == hashes[:2]
    index = B.HashIndex(np.array(hashes[:2], np.uint64))
    assert index.get(np.array([hashes[1], 5, hashes[0]], np.uint64)).tolist() == [1, -1, 0]
