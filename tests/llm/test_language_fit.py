"""Language model: the fit by tasks against the local one, many languages, and texts that are of none."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import langid

from .test_models import rows


def test_fit_by_tasks_equals_the_local_one(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    words = langid.word_table(docs.select("lang", "text")).collect()
    names, languages = sorted({r.word for r in words}), sorted({r.lang for r in words})
    counts = np.zeros((len(names), len(languages)))
    for r in words:
        counts[names.index(r.word), languages.index(r.lang)] += r.n
    local = langid.fit(names, counts, languages, langid.load_pieces(langid.default_vocabulary()))
    model = langid.train(docs.repartition(7))
    assert model.languages == local.languages and np.allclose(model.prob, local.prob, rtol=1e-3, atol=1e-9)
    again = langid.train(docs.repartition(2))
    assert np.array_equal(model.prob, again.prob) and np.array_equal(model.floor, again.floor)


def test_thirty_languages_are_all_learned(spark):
    """1,200 texts of each of 30 languages, 36,000 distinct words in the first ones, and a last language of 20 texts."""
    k, n = F.col("id") % 30, (F.col("id") / 30).cast("long")
    two = lambda x: F.concat(*[F.substring(F.lit("bcdfghjklmnprst"), (x + s).cast("int") % 15 + 1, 1) for s in (0, 7)])
    word = lambda x: F.concat(F.chr(F.lit(97) + k % 26), two(k), F.lpad(F.conv(x.cast("string"), 10, 36), 4, "a"))
    many = spark.range(36_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.translate(word(n * 30 + j), "0123456789", "oieaouyvwz") for j in range(6)]).alias("text"), F.format_string("l%02d", k).alias("lang"))
    few = spark.createDataFrame([(10**6 + i, "žluťoučký kůň úpěl ďábelské ódy", "zz") for i in range(20)], "doc_id long, text string, lang string")
    model = langid.train(many.unionByName(few), rounds=1)
    assert model.languages == [f"l{i:02d}" for i in range(30)] + ["zz"]
    assert {r.lang_pred for r in langid.predict(few, model).collect()} == {"zz"}


def test_random_letters_fit_no_language(spark):
    rnd = random.Random(5)
    noise = [" ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(80)) for _ in range(20)] + ["zzz xqj " * 50, "kjhsdf skdjfh ksjdhf " * 9]
    known = spark.createDataFrame(rows(), "doc_id long, text string, lang string")
    docs = known.unionByName(spark.createDataFrame([(5000 + i, t, None) for i, t in enumerate(noise)], known.schema))
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept == {i for i, _, _ in rows()}
