"""Line dedup of the query and the pipeline: lines of few words take part."""

import random

import corpus_pipeline
from corpusloom.llm import linededup, queries
from tests.llm.test_sets import brute_lines


def short_docs():
    rng, docs = random.Random(3), []
    for i in range(50):
        rows = [" ".join(rng.choices([f"w{k}" for k in range(7)], k=rng.randint(0, 7))) for _ in range(rng.randint(0, 5))]
        docs.append((i, "\n".join(rows + ["目录", "--"] * (i % 2))))
    return docs


def test_short_lines_equal_brute_force(spark):
    docs = short_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for hot in (20_000, 5):
        assert {r._id: r._removed for r in linededup.removals(df, least_words=1, hot=hot).collect()} == brute_lines(docs, least=1)


def test_query_and_pipeline_take_short_lines(spark, tmp_path):
    docs = [(1, "home\none two three four five"), (2, "Home\nkeep"), (3, "four three two one\n--"), (4, "home\n--")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.removed_lines for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()} == {1: "", 2: "0", 3: "0", 4: "0"}
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, "").collect()} == {1: docs[0][1], 2: "keep", 3: "--", 4: "--"}
