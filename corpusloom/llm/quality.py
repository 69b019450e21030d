"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 3).

Every text becomes a fixed set of statistics (lengths, shares of symbols, capitals, digits and
repeated words, lines and word variety), computed with numpy over batches. Trees are grown on
quantile bins: for each node one gradient and one hessian histogram for all features, the other
child by subtraction. The forest is flattened into arrays (feature, threshold, left child, value),
and scoring moves all rows of a batch down all trees at once, one level a step.

Training takes at most `max_train` labelled rows of each class, those with the smallest hash of
their id; the bound is a parameter, and scoring covers every text whole.

Defined results: a null or empty text has the statistics 0 and the score of those; without labels
of both classes every score is the share of label 1 (0.5 without labels); equal rows give equal
scores, and texts with equal statistics too; of splits with equal gain the first statistic and the
lowest bin count; of labelled rows with one id the largest label and the smallest text count; a very
long text is one chunk and needs memory in proportion; an empty table gives no rows; other columns,
those named like a result too, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from . import rules
from .common import in_arrow, labelled_texts

STATISTICS = ("log_words", "word_length", "symbols", "marks", "digits", "capitals", "letters", "outside_ascii", "repeated_words", "repeated_lines", "line_length", "distinct_words", "top_word")

_MARK = B.byte_table(b"!?.,;:")
_DIGIT = B.byte_table(range(0x30, 0x3A))


def statistics(chunk: B.Chunk) -> np.ndarray:
    """One row of STATISTICS for each text of a chunk."""
    m = {k: v.astype(float) for k, v in rules.measure(chunk).items()}
    w = B.words(chunk, B.NON_SPACE)
    n, words = chunk.rows, np.maximum(1, m["n_words"])

    def share(table: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(table[chunk.buf], dtype=np.int64)))[chunk.offs]).astype(float)

    keys, counts = np.unique(w.hash + B.mix(w.row.astype(np.uint64)), return_inverse=True)[1], None
    counts = np.bincount(keys) if len(keys) else np.zeros(0, np.int64)
    first = np.zeros(len(counts), np.int64)
    first[keys] = w.row
    distinct = np.bincount(first, minlength=n).astype(float) if len(counts) else np.zeros(n)
    top = np.zeros(n)
    np.maximum.at(top, first, counts)
    chars = np.maximum(1, m["word_chars"])
    return np.column_stack(
        (
            np.log1p(m["n_words"]), m["word_chars"] / words, m["n_symbols"] / words, share(_MARK) / words, share(_DIGIT) / chars, m["n_upper"] / np.maximum(1, m["n_letters"]), m["n_alpha_words"] / words,
            share(np.arange(256) >= 0x80) / chars, m["n_repeat_words"] / words, m["n_dup_lines"] / np.maximum(1, m["n_lines"]), m["n_words"] / np.maximum(1, m["n_lines"]), distinct / words, top / words,
        )
    )


@dataclass
class Forest:
    """All trees in arrays; node i's children are left[i] and left[i] + 1, and leaves lead to themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.tile(self.roots, (len(part), 1))
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                step = part[rows, self.feature[node]] > self.threshold[node]
                node = np.where(self.left[node] < 0, node, self.left[node] + step)
            out[at : at + 4096] = self.start + self.value[node].sum(1)
        return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least_hessian: float = 1.0) -> Forest:
    n, d = x.shape
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    start = float(np.log(mean / (1 - mean)))
    feature, threshold, left, value, roots = [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)] if n else []
    binned = np.column_stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(d)]) if n else np.zeros((0, d), int)
    flat = binned + np.arange(d) * bins
    z = np.full(n, start)

    def histogram(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = flat[rows].ravel()
        return np.stack([np.bincount(at, np.repeat(v[rows], d), d * bins).reshape(d, bins) for v in (g, h)])

    def leaf(total: np.ndarray) -> float:
        return float(-rate * total[0] / (total[1] + ridge))

    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        root = len(feature)
        roots.append(root)
        feature.append(0), threshold.append(np.inf), left.append(-1), value.append(0.0)
        level = [(root, np.arange(n), histogram(np.arange(n), g, h))]
        for deep in range(depth + 1):
            after = []
            for node, rows, hist in level:
                total = hist[:, 0].sum(1)
                value[node] = leaf(total)
                best = None
                if deep < depth and len(rows) > 1:
                    low = np.cumsum(hist, 2)[:, :, :-1]
                    high = total[:, None, None] - low
                    gain = low[0] ** 2 / (low[1] + ridge) + high[0] ** 2 / (high[1] + ridge) - total[0] ** 2 / (total[1] + ridge)
                    gain[(low[1] < least_hessian) | (high[1] < least_hessian)] = 0
                    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[j, b] > 1e-6 and b < len(edges[j]):
                        best = (int(j), int(b))
                if best is None:
                    z[rows] += value[node]
                    continue
                j, b = best
                right = binned[rows, j] > b
                feature[node], threshold[node], left[node] = j, float(edges[j][b]), len(feature)
                for _ in range(2):
                    feature.append(0), threshold.append(np.inf), left.append(-1), value.append(0.0)
                rows_low, rows_high = rows[~right], rows[right]
                less = len(rows_low) <= len(rows_high)
                made = histogram(rows_low if less else rows_high, g, h)
                after.append((left[node], rows_low, made if less else hist - made))
                after.append((left[node] + 1, rows_high, hist - made if less else made))
            level = after
    return Forest(np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(value), np.array(roots, np.int64), depth, start)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, max_train: int = 5000, **options) -> Forest:
    """Fit on at most max_train labelled documents of each class; the driver gets their statistics only."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([statistics(c) for c in B.chunks(batch.column(2))])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x[:, j]) for j in range(len(STATISTICS)))], ["key", "label", *STATISTICS])

    schema = "key long, label int, " + ", ".join(f"{s} double" for s in STATISTICS)
    rows = sorted(map(tuple, in_arrow(labelled_texts(docs, labels, id_col, text_col, label_col, max_train), run, schema).collect()))
    made = np.array(rows, float).reshape(len(rows), 2 + len(STATISTICS))
    return fit(made[:, 2:], made[:, 1], **options)


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, a score from 0 to 1 and the statistics of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.concatenate([statistics(c) for c in B.chunks(batch.column(1))])
        columns = [batch.column(0), pa.array(shared.value.score(x)), *(pa.array(x[:, j]) for j in range(len(STATISTICS)))]
        return pa.RecordBatch.from_arrays(columns, [id_col, "score", *STATISTICS])

    schema = f"`{id_col}` {kind}, score double, " + ", ".join(f"{s} double" for s in STATISTICS)
    return in_arrow(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), run, schema)
