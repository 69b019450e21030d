"""Rule bitmask ledger: quality rules evaluated once, policies applied later (operator 9).

`ledger` measures every text once and stores the measurements with one failure bit for each rule.
A policy is a versioned set of rules; applying it, or comparing policies, reads bits only:
`apply_policy` keeps rows whose failure bits miss the policy's mask, and `ablations` counts for
each rule how many rows it rejects, how many it alone rejects, and how many would be kept without
it, from one aggregation over the distinct bit patterns (at most 2^rules of them).

Defined results: a null text has no words and fails `few_words`; equal rows give equal rows; an
empty table gives an empty ledger and no ablations; other columns pass through `ledger` untouched
unless they carry a measurement's name, in which case the measurement replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import in_arrow

#: What measuring derives from a chunk is many times its size, in each worker.
CHUNK_BYTES = 1 << 18

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_alpha_words"]

_SYMBOL = B.byte_table(b"#*$%&|<>")
_UPPER = B.byte_table(range(0x41, 0x5B))
_LETTER = B.byte_table([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_ALPHA = _LETTER | B.byte_table(range(0x80, 0x100))


@dataclass(frozen=True)
class Rule:
    """A rule fails where `fails` is true of the measurements; bit is its place in the mask and never changes."""

    name: str
    bit: int
    fails: str


#: Bits are permanent: a rule whose threshold changes gets a new bit, and old policies keep their meaning.
RULES = (
    Rule("few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > n_words"),
    Rule("word_length", 3, "n_words > 0 AND (word_chars < 3 * n_words OR word_chars > 12 * n_words)"),
    Rule("repeated_lines", 4, "2 * n_dup_lines > n_lines"),
    Rule("capitals", 5, "10 * n_upper > 4 * n_letters"),
    Rule("no_letters", 6, "10 * n_alpha_words < 8 * n_words"),
    Rule("many_words", 7, "n_words > 100000"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base-1", ("few_words", "repeated_words"))
PROSE = Policy("prose-1", ("few_words", "repeated_words", "symbols", "word_length", "repeated_lines", "capitals", "no_letters"))
STRICT = Policy("strict-1", tuple(r.name for r in RULES))


def measure(chunk: B.Chunk) -> dict[str, np.ndarray]:
    """Measurements of each row of a chunk."""
    n, buf, offs = chunk.rows, chunk.buf, chunk.offs

    def per_row(flag: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flag, dtype=np.int64)))
        return np.diff(total[offs])

    w = B.words(chunk, B.NON_SPACE)
    alpha = np.concatenate(([0], np.cumsum(_ALPHA[buf], dtype=np.int64)))
    has_alpha = (alpha[w.end] > alpha[w.start]).astype(np.int64)
    count = lambda rows, weights=None: np.bincount(rows, weights, minlength=n).astype(np.int64)

    inside = np.ones(len(buf), bool)
    inside[buf == 0x0A] = False
    start, end = B.spans(inside, offs)
    word_at = np.concatenate(([0], np.cumsum(B.NON_SPACE[buf], dtype=np.int64)))
    real = word_at[end] > word_at[start]
    start, end = start[real], end[real]
    row = np.searchsorted(offs, start, "right") - 1
    line = B.hash_spans(buf, start, end) + B.mix(row.astype(np.uint64))
    lines = count(row)
    distinct = count(row[np.unique(line, return_index=True)[1]])

    repeated = np.zeros(len(w), bool)
    if len(w) > 2:
        whole = w.row[2:] == w.row[:-2]
        h = B.mix(w.hash[:-2] + np.uint64(1)) + B.mix(w.hash[1:-1] + np.uint64(2)) + B.mix(w.hash[2:] + np.uint64(3)) + B.mix(w.row[2:].astype(np.uint64))
        codes, uniques = pd.factorize(h[whole])
        twice = np.flatnonzero(whole)[np.bincount(codes, minlength=len(uniques))[codes] > 1]
        for k in range(3):
            repeated[twice + k] = True
    return {
        "n_words": count(w.row),
        "word_chars": per_row(B.NON_SPACE[buf] & ((buf & 0xC0) != 0x80)),
        "n_symbols": per_row(_SYMBOL[buf]),
        "n_dup_lines": lines - distinct,
        "n_repeat_words": count(w.row, repeated),
        "n_lines": lines,
        "n_upper": per_row(_UPPER[buf]),
        "n_letters": per_row(_LETTER[buf]),
        "n_alpha_words": count(w.row, has_alpha),
    }


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("long")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns (all but the text by default), the measurements, and `fail_bits`."""
    kept = [c for c in (keep if keep is not None else docs.columns) if c != text_col and c not in MEASURES and c != "fail_bits"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), *(f"{m} long" for m in MEASURES)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [measure(c) for c in B.chunks(batch.column(len(kept)), CHUNK_BYTES)]
        columns = [pa.array(np.concatenate([p[m] for p in parts])) for m in MEASURES]
        return pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, [*kept, *MEASURES])

    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("_text"))
    return in_arrow(source, run, schema).withColumn("fail_bits", failure_bits(rules))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept: no failure bit of the policy is set."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: rows it rejects, rows it alone rejects, rows kept with it and without it."""
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rules = [r for r in RULES if r.name in policy.rules]
    sums = [F.coalesce(F.sum(F.when(F.col("p") == 0, F.col("n"))), F.lit(0)).alias("kept")]
    for r in rules:
        bit = F.lit(1 << r.bit)
        sums.append(F.coalesce(F.sum(F.when(F.col("p").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias(f"hit_{r.name}"))
        sums.append(F.coalesce(F.sum(F.when(F.col("p") == bit, F.col("n"))), F.lit(0)).alias(f"only_{r.name}"))
    each = F.array(*[F.struct(F.lit(policy.version).alias("policy"), F.lit(r.name).alias("rule"), F.col(f"hit_{r.name}").alias("rejected"), F.col(f"only_{r.name}").alias("rejected_alone"), F.col("kept"), (F.col("kept") + F.col(f"only_{r.name}")).alias("kept_without")) for r in rules])
    return patterns.agg(*sums).select(F.inline(each))
