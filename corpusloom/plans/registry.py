"""Registered queries of the text engine and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import annotate, prompt, tokens
from ..functions.detect import detect, family
from ..operators import clean, discover, ledger
from . import rendered, replay
from .oracle import ORACLE_SQL
from .options import Options
from .process import is_blank, process

AS_OF = datetime(2024, 1, 31)
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes a core is dealt to all cores where work on a row is heavy; larger ones come in enough splits of their own.
SMALL_BYTES_A_CORE = 16 << 20


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose texts are to be classified or cleaned. One file of one row group would be a single task."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < SMALL_BYTES_A_CORE * cores else df


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger derived from events: tokens before from the value, after as 40 to 119 percent of them."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("content_type"), F.floor(F.col("value") * 100).cast("long").alias("original_tokens"))
    rows = rows.withColumn("cleaned_tokens", F.expr("original_tokens * (40 + run_id % 80) div 100"))
    return rows.withColumn("savings_pct", ledger.savings_pct(F.col("original_tokens"), F.col("cleaned_tokens")))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def ledger_total(spark, sf_dir):
    return _rounded(ledger.totals(runs(spark, sf_dir)), "avg_savings_pct")


def ledger_range_7d(spark, sf_dir):
    return _rounded(ledger.totals(ledger.since_days(runs(spark, sf_dir), AS_OF, 7)), "avg_savings_pct")


def ledger_today(spark, sf_dir):
    return _rounded(ledger.totals(ledger.today(runs(spark, sf_dir), datetime(2024, 1, 30, 12))), "avg_savings_pct")


def ledger_by_type(spark, sf_dir):
    return _rounded(ledger.by_type(runs(spark, sf_dir)), "avg_savings_pct")


def ledger_daily(spark, sf_dir):
    return _rounded(ledger.daily(ledger.since_days(runs(spark, sf_dir), AS_OF, 14)), "avg_savings_pct")


def ledger_daily_rollup(spark, sf_dir):
    return _rounded(ledger.daily_with_total(runs(spark, sf_dir)), "savings_pct")


def ledger_history50(spark, sf_dir):
    return _rounded(ledger.history(runs(spark, sf_dir)), "savings_pct")


def ledger_history_since(spark, sf_dir):
    return _rounded(ledger.history(ledger.since_days(runs(spark, sf_dir), AS_OF, 7), 100), "savings_pct")


def ledger_export(spark, sf_dir):
    return ledger.export(runs(spark, sf_dir))


def ledger_savings_label(spark, sf_dir):
    return ledger.with_savings(runs(spark, sf_dir)).select("run_id", "saved_tokens", "percent", "savings_label")


def ledger_cost(spark, sf_dir):
    found = ledger.with_savings(runs(spark, sf_dir)).groupBy("content_type").agg(F.sum("saved_tokens").alias("saved_tokens"))
    return found.withColumn("saved_cost", F.round(tokens.cost(F.col("saved_tokens")), 6))


def token_estimate_documents(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", tokens.estimate(F.col("text"), F.lit("text")).alias("est_tokens"), tokens.simple_estimate(F.col("text")).alias("simple_tokens"))


def token_estimate_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", tokens.estimate(F.col("html"), F.lit("html")).alias("est_tokens"))


def detect_documents(spark, sf_dir):
    return texts(spark, sf_dir, "documents").select("doc_id", detect(F.col("text")).alias("label"))


def detect_conversations(spark, sf_dir):
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", detect(F.col("text")).alias("label"))


def detect_pages(spark, sf_dir):
    return texts(spark, sf_dir, "pages").select("page_id", detect(F.col("html")).alias("label"))


def detect_events_props(spark, sf_dir):
    return texts(spark, sf_dir, "events").select("event_id", detect(F.col("props")).alias("label"))


def detect_rendered(spark, sf_dir):
    return rendered.corpus(spark, sf_dir).select("kind", "doc_key", detect(F.col("text")).alias("label"))


def detect_forced(spark, sf_dir):
    names = ("diff", "LOGS", "yml", "py", "tsc", "lint", "xml", "hcl", "docker", "trace", "nonsense")
    d = table(spark, sf_dir, "documents").select("doc_id")
    each = F.array(*[F.struct(F.lit(n).alias("forced"), detect(F.lit(""), n).alias("label")) for n in names], F.struct(F.lit("force_diff").alias("forced"), detect(F.lit(""), force_diff=True).alias("label")))
    return d.select("doc_id", F.inline(each))


def discover_conversations(spark, sf_dir):
    return discover.by_label(texts(spark, sf_dir, "conversations").where(F.col("role") == "user"))


def discover_summary(spark, sf_dir):
    return discover.summary(texts(spark, sf_dir, "conversations").where(F.col("role") == "user"), session_col="conv_id")


def _forced(column: Callable, aggressive: bool, name: str = "documents", key: str = "doc_id", text: str = "text") -> Query:
    return lambda spark, sf_dir: texts(spark, sf_dir, name).select(key, column(F.col(text), aggressive).alias("cleaned"))


def _labelled(label: str, aggressive: bool = False, name: str = "documents", key: str = "doc_id", text: str = "text") -> Query:
    return lambda spark, sf_dir: texts(spark, sf_dir, name).select(key, clean.clean(F.col(text), F.lit(label), aggressive).alias("cleaned"))


def _of_kind(kind: str, label: str, aggressive: bool = False) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rendered.corpus(spark, sf_dir, kind)
        cleaned = docs.select("doc_key", clean.clean(F.col("text"), F.lit(label), aggressive).alias("cleaned"))
        return cleaned.withColumn("framed", annotate.header(F.col("cleaned"), F.lit(label)))

    return query


def frame_of(label: str, name: str = "documents", key: str = "doc_id", text: str = "text") -> Query:
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(key, annotate.header(F.coalesce(F.col(text), F.lit("")), F.lit(label)).alias("header"))


PROMPTS = ("fix", "explain", "refactor", "review", "debug", "test", "optimize", "convert", "document", "migrate", "security", "other")
PROMPT_LABELS = ("trace/python", "git-diff", "log", "json", "yaml", "code/rust", "code/ts", "code/ruby", "build/cargo", "markdown", "html", "sql", "csv", "dockerfile", "env", "terraform", "text")


def prompt_wrap(spark, sf_dir):
    """Every text under every template; the labels take turns by document."""
    label = F.get(F.array(*map(F.lit, PROMPT_LABELS)), F.pmod("doc_id", F.lit(len(PROMPT_LABELS))).cast("int"))
    rows = texts(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), label.alias("label"))
    each = F.array(*[F.struct(F.lit(t).alias("template"), F.md5(prompt.wrap(F.col("text"), t, F.col("label"))).alias("wrapped_md5")) for t in PROMPTS])
    return rows.select("doc_id", "label", F.inline(each))


def clean_json_props(spark, sf_dir):
    return texts(spark, sf_dir, "events").select("event_id", clean.clean(F.col("props"), F.lit("json")).alias("cleaned"))


def all_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, pages and conversation turns as one corpus."""
    parts = [
        texts(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text"),
        texts(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("doc_id"), F.col("html").alias("text")),
        texts(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"), "text"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def pipeline_full(spark, sf_dir):
    done = process(all_texts(spark, sf_dir), options=Options(prompt="review"))
    return done.select("id", "label", F.md5("output").alias("output_md5"), "original_tokens", "cleaned_tokens", "savings_label")


def pipeline_by_type(spark, sf_dir):
    """Per family: texts, tokens before and after cleaning."""
    done = process(all_texts(spark, sf_dir).where(~is_blank(F.col("text"))), options=Options(no_frame=True))
    found = done.groupBy(family(F.col("label")).alias("family")).agg(F.count(F.lit(1)).alias("texts"), F.sum("original_tokens").alias("original_tokens"), F.sum("cleaned_tokens").alias("cleaned_tokens"))
    return found.withColumn("saved_tokens", tokens.saved(F.col("original_tokens"), F.col("cleaned_tokens")))


def queries() -> dict[str, Query]:
    page = {"name": "pages", "key": "page_id", "text": "html"}
    found: dict[str, Query] = {f.__name__: f for f in (
        ledger_total, ledger_range_7d, ledger_today, ledger_by_type, ledger_daily, ledger_daily_rollup, ledger_history50, ledger_history_since, ledger_export, ledger_savings_label, ledger_cost,
        token_estimate_documents, token_estimate_pages, detect_documents, detect_conversations, detect_pages, detect_events_props, detect_rendered, detect_forced, discover_conversations,
        discover_summary, prompt_wrap, clean_json_props, pipeline_full, pipeline_by_type,
    )}
    found |= {
        "clean_csv_default": _forced(clean.clean_csv, False), "clean_csv_aggressive": _forced(clean.clean_csv, True),
        "clean_html_default": _forced(clean.clean_html, False, **page), "clean_html_aggressive": _forced(clean.clean_html, True, **page),
        "clean_log_dedup": _labelled("log"), "clean_plain": _labelled("text"), "clean_plain_conversations": lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", clean.clean(F.col("text"), F.lit("text")).alias("cleaned")),
        "clean_markdown_forced": _labelled("markdown", True), "frame_text": frame_of("text"), "frame_csv": frame_of("csv"), "frame_log": frame_of("log"), "frame_sql": frame_of("sql"),
        "frame_html": frame_of("html", **page),
    }
    found |= replay.QUERIES
    for kind, label in rendered.KINDS.items():
        name = label.replace("/", "_").replace("-", "_")
        found[f"clean_{name}_rendered"] = _of_kind(kind, label)
        found[f"clean_{name}_rendered_aggressive"] = _of_kind(kind, label, True)
    return found


def oracle_sql() -> dict[str, str]:
    from . import oracle_rendered, oracle_replay
    from .oracle import prompts

    return {**ORACLE_SQL, **oracle_rendered.ORACLE_SQL, **oracle_replay.ORACLE_SQL, "prompt_wrap": prompts(PROMPTS, PROMPT_LABELS)}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_by_type(spark, sf_dir)
