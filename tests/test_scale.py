"""What grows with the tables: batches that go to Python, how often a text is split, patterns that run in vain."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import annotate, detect, tokens
from corpusloom.functions import text as T
from corpusloom.functions.sqltext import sql_text
from corpusloom.operators import clean

SPACES = ["\n", "\r\n", "\r", " ", "\t", "\x85", "\xa0", " ", "　", "\x0b"]


def odd_texts(n=300):
    r = random.Random(5)
    return ["", "\n", "\r", " \r", "\n\r", "a\n\r", " \r\r\n x", *("".join(r.choice([*SPACES, "a", "é", "😀", "B=1", "\x1c"]) for _ in range(r.randrange(1, 25))) for _ in range(n))]


@pytest.mark.parametrize("label", ["markdown", "text", "log"])
def test_texts_go_to_python_in_small_batches(spark, label):
    """Arrow batches of 10,000 texts filled the workers."""
    docs = spark.range(3).select(F.lit("# a\n\n\n\nb").alias("text"))
    plan = docs.select(clean.clean(F.col("text"), F.lit(label), True))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_a_text_is_split_once():
    """What lines are made of was repeated in the expression, and again for each step over it: 4 times, then 48 for an environment."""
    assert sql_text(T.lines(F.col("t"))).count("split(") == 1
    assert sql_text(clean.clean_env(F.col("t"), True)).count("split(") == 2
    assert sql_text(clean.clean_html(F.col("t"))).count("split(") == 1
    assert sql_text(clean.clean_csv(F.col("t"))).count("split(") == 1
    assert sql_text(tokens.estimate(F.col("t"), F.lit("text"))).count("split(") == 0
    assert sql_text(annotate.header(F.col("t"), F.lit("env"))).count("split(`t`, '\\n'") == 1


def test_white_space_words_and_indents(spark):
    texts = odd_texts()

    def indents(t):
        rows = t.split("\n")
        rows = rows[:-1] if rows[-1] == "" else rows
        rows = [x[:-1] if x.endswith("\r") else x for x in rows]
        return sum(len(x.encode()) - len(x.lstrip(T.SPACE).encode()) for x in rows)

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, trimmed, words, indent in df.select("t", T.trim(F.col("t")), T.words(F.col("t")), T.indents(F.col("t"))).collect():
        assert (trimmed, words, indent) == (t.strip(T.SPACE), len([w for w in re.split(f"[{T.SPACE}]+", t) if w]), indents(t))


EXAMPLES = {
    "git-diff": ["x\ndiff --git a/f b/f", "--- a/f", "+++ b/f"], "trace/go": ["goroutine 7 [running]:"], "trace/java": ["\tat a.b.C(C.java:7)"], "trace/python": ["Traceback (most recent call last):"],
    "trace/rust": ["thread 'a' panicked at x", "  1: a\n  2: b"], "trace/javascript": ["\n at f (x)\n at async f.g (y)"],
    "build/cargo": ["   Compiling a\n Checking b", "Fresh a\nUpdating b", "Locking a\nDownloaded b", "Downloading a\nerror[E1]", "warning:\nFinished dev", "Finished release\nerror: could not compile"],
    "build/typescript": ["a.ts(1,2): error TS1:", "a.tsx(1,2): warning TS1:"], "build/eslint": ["\n 1:2 error a\n 1:2 warning b\n 1:2 error c"],
    "log": ["2024-01-01T00:00 2024-01-01 00:00 2024-01-01 00:00", "[INFO] [WARN] [WARNING]", "level=info lvl=warn severity=fatal", "TRACE \nDEBUG:\nFATAL ", "[ERROR] [TRACE] [DEBUG]"],
}


def test_literals_stand_in_what_patterns_find(spark):
    """A pattern is tried only where its literals stand, and none of its texts is lost."""
    assert len(detect.LITERALS) == len(detect.COUNTED)
    rows = [(label, t) for label, texts in EXAMPLES.items() for t in texts]
    for label, t, found in spark.createDataFrame(rows, "label string, t string").select("label", "t", detect.detect(F.col("t"))).collect():
        assert found == label, t


def test_rules_are_measured_in_small_chunks():
    import pyarrow as pa

    from corpusloom.llm import _bytes, rules

    parts = list(_bytes.chunks(pa.array(["word " * 200] * 1000), rules.CHUNK_BYTES))
    assert len(parts) > 1 and max(len(c.buf) for c in parts) <= 1 << 18 and sum(c.rows for c in parts) == 1000
