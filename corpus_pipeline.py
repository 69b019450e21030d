"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import dartminhash, decontam, langid, linededup, packing
from corpusloom.llm.common import LIVE, Scratch, drop_made_after, held_out, table

#: A document is rejected if no language is found, its probability is below this, ...
LEAST_LANGUAGE_SCORE = 0.5
#: ... or its letters are less likely, by so much a letter on average, than any text of the language is expected to be.
LEAST_FIT = -3.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised and whose letters are those of the language.

    Null texts and texts without letters go; with fewer than 20 letters the probability alone decides, and equal rows
    share their fate. A very long text is worked on as a whole. An empty table stays one; columns of any name keep their values."""
    model = langid.train(docs.where(~held_out("doc_id")))
    kept = docs.columns
    clash = {c: f"_own_{c}" for c in langid.RESULTS if c in kept}
    found = langid.predict(docs.withColumnsRenamed(clash), model)
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE) & F.coalesce(F.col("fit") >= LEAST_FIT, F.lit(True))
    return found.where(known).drop(*langid.RESULTS).withColumnsRenamed({v: k for k, v in clash.items()}).select(*[F.col(f"`{c}`") for c in kept])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that an earlier line resembles, short ones too.

    Lines are ordered by document and place; of equal rows all keep the same lines. Null texts and lines without words stay
    as they are, a text may become empty, and no row is dropped. A line of any length is compared as a whole. An empty table
    stays one; columns of any name keep their values."""
    return linededup.dedup_lines(docs, least_words=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near-duplicates.

    That is the one with the smallest id, null first; of equal rows one stays. Null and empty texts are copies of each
    other. A very long text takes part as a whole. An empty table stays one; columns of any name keep their values."""
    return dartminhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage.

    Null and empty texts stay, equal rows share their fate, and a very long text is searched to its end. Without passages all
    rows stay. An empty table stays one; columns of any name keep their values."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their place in a sequence.

    A null or empty text is its end mark alone, equal rows are packed each, and a very long text is cut into many pieces. An
    empty table gives no pieces; other columns do not take part."""
    return packing.tokenize_and_pack(docs)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can express neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written and read again; what a stage wrote for itself goes with its end."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = len(LIVE)
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        drop_made_after(before)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
