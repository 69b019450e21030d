"""SQL names of the engine, for a session.

`detect_type(text)`, `est_tokens(text, family)`, `simple_tokens(text)`, `frame_text(text, label)`, `wrap_prompt(text,
template, label)` and `clean_text(text, label, aggressive)` have SQL bodies, made from the column expressions, so
Catalyst sees through them; `clean_lines(text, label, aggressive)` is the Python function that `clean_text` calls for
families whose rules look back; `doc_lines(text)` is a table function."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import annotate, tokens
from .detect import detect
from .sqltext import sql_text


def _clean_text() -> str:
    from ..operators import clean

    plain, kind = clean.strip_ansi(F.col("p_text")), sql_text(F.coalesce(F.substring_index(F.col("p_label"), "/", 1), F.lit("text")))
    native = {"csv": clean.clean_csv, "env": clean.clean_env, "html": clean.clean_html}
    cases = [f"WHEN {kind} = '{name}' AND {'' if how else 'NOT '}p_aggressive THEN {sql_text(make(plain, how))}" for name, make in native.items() for how in (False, True)]
    return f"CASE {' '.join(cases)} ELSE clean_lines({sql_text(plain)}, p_label, p_aggressive) END"


def _wrap_prompt() -> str:
    from .prompt import wrap
    from .tables import ANSWERS, TASKS

    text, label, wrapped = F.col("p_text"), F.col("p_label"), F
    for name in dict.fromkeys(x for x in (*TASKS, *ANSWERS) if x):
        wrapped = wrapped.when(F.lower(F.col("p_template")) == name, wrap(text, name, label))
    return sql_text(wrapped.otherwise(wrap(text, "", label)))


#: Parameters, type and maker of the body by name. A parameter is called p_ and something, so that no column of a query is meant by it.
FUNCTIONS = {
    "detect_type": ("p_text STRING", "STRING", lambda: sql_text(detect(F.col("p_text")))),
    "est_tokens": ("p_text STRING, p_family STRING", "BIGINT", lambda: sql_text(tokens.estimate(F.col("p_text"), F.col("p_family")))),
    "simple_tokens": ("p_text STRING", "BIGINT", lambda: sql_text(tokens.simple_estimate(F.col("p_text")))),
    "frame_text": ("p_text STRING, p_label STRING", "STRING", lambda: sql_text(annotate.frame(F.col("p_text"), F.col("p_label")))),
    "wrap_prompt": ("p_text STRING, p_template STRING, p_label STRING", "STRING", _wrap_prompt),
    "clean_text": ("p_text STRING, p_label STRING, p_aggressive BOOLEAN", "STRING", _clean_text),
}


def register(spark: SparkSession, names: Iterable[str] = tuple(FUNCTIONS)) -> None:
    """The two Python functions, and those of FUNCTIONS that are named: a long body takes some seconds to parse."""
    from ..operators import clean, line_cleaners

    @F.udtf(returnType="pos int, line string")
    class DocLines:
        def eval(self, text: str) -> Iterator:
            yield from enumerate(line_cleaners.lines(text or ""))

    spark.udf.register("clean_lines", clean._by_lines)
    spark.udtf.register("doc_lines", DocLines)
    for name in names:
        parameters, kind, body = FUNCTIONS[name]
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body()}")
