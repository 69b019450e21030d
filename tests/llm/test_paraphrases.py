"""Decontamination without an answer column: edits spread over the whole passage, its end too."""

import random

from corpusloom.llm import decontam


def test_paraphrases_with_an_edited_end(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    items = [fresh((16, 24, 40, 59)[k % 4]) for k in range(16)]
    docs = []
    for i in range(132):
        w, p = fresh(200), list(items[i % 16])
        for j in range(len(p) - 1, -1, -3 if i < 16 else -4):  # the last word and every third or fourth before it
            p[j] = f"other{rng.randrange(10**6)}"
        if i < 32:
            w[100:100] = p
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in enumerate(items)], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(df, bench).collect()} == {(i, i % 16) for i in range(32)}
    assert {r.doc_id for r in decontam.clean(df, bench).collect()} == set(range(32, 132))
    # with an answer column all words of the answer must be there
    answered = bench.selectExpr("*", "substring_index(text, ' ', -1) AS answer")
    assert decontam.matches(df, answered, answer_col="answer").count() == 0
