"""Toxicity: a character n-gram linear classifier on naive Bayes log-count ratios (operator 7).

A text's features are the character n-grams (3 to 8 characters of the lower-cased words with a mark
at each end) of its words, hashed to a table of fixed size; a feature counts once in a text. Each
feature is scaled by its log-count ratio log((p + a) / |p|) - log((q + a) / |q|) of the toxic and
other labelled texts, and a logistic regression is trained on the scaled features. Scaling and
weights are folded into one table: the score is the logistic function of the bias and the sum over
the distinct n-grams of the whole text. Sums are not divided by the text's length, so one insult
weighs as much in a long text as in a short one.

Training takes at most `max_train` labelled rows of each class, those with the smallest hash of
their id, and the `max_features` n-grams that depend most on the label; both bounds are parameters, and scoring covers every text whole. N-grams are counted where the texts lie; what the
driver gets is two counts a bucket and one bit a feature and labelled text.

Defined results: a null or empty text has the score of the bias alone; without labels of both
classes every score is 0; equal rows give equal scores, and equal sums equal scores; of labelled
rows with one id the largest label and the smallest text count; a very long text is one chunk and
needs memory in proportion; an empty table gives no rows; other columns, those named `score` or
`label` too, are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import Scratch, in_arrow, labelled_texts
from .sketch import bucket_counts

BITS = 20
SIZES = (3, 4, 5, 6, 7, 8)
MARK = 0x20


@dataclass
class Model:
    weight: np.ndarray  # one weight for each hashed n-gram
    bias: float


def lowered(column: pa.Array) -> Iterator[B.Chunk]:
    return B.chunks(pc.utf8_lower(column))


def word_grams(chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk: for each word of the chunk its distinct word and its row; for each n-gram its number and distinct word."""
    w = B.words(chunk, B.WORDLIKE, lower=True)
    codes, uniques = pd.factorize(w.hash)
    first = np.empty(len(uniques), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    if len(uniques) == 0:
        return codes, w.row, np.zeros(0, np.int32), np.zeros(0, np.int32)
    start, size = w.start[first], w.end[first] - w.start[first] + 1
    ends = np.cumsum(size)
    source = np.arange(int(ends[-1])) - np.repeat(ends - size - start, size)
    raw = B.LOWER[chunk.buf[np.minimum(source, len(chunk.buf) - 1)]]
    raw[ends - 1] = MARK  # the words one after the other, a mark behind each
    char = np.frombuffer((chr(MARK) + raw.tobytes().decode("utf-8", "replace")).encode("utf-32-le"), np.uint32)
    n = len(char)
    mark = np.flatnonzero(char == MARK)
    owner = np.repeat(np.arange(len(mark)), np.diff(np.append(mark, n)))
    left = np.append(mark, n)[np.minimum(owner + 1, len(mark))] - np.arange(n) + 1  # characters up to the word's last mark
    left[mark[-1] :] = 0
    value = char.astype(np.uint64)
    grams, owners = [], []
    h = np.zeros(n, np.uint64)
    for k in range(max(SIZES)):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - k)] = value[k:]
        h = (h + shifted + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if k + 1 in SIZES:
            ok = left > k
            grams.append((h[ok] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32))
            owners.append(owner[ok].astype(np.int32))
    return codes, w.row, np.concatenate(grams), np.concatenate(owners)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def text_grams(chunk: B.Chunk, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each n-gram that a row has, each once; of the wanted ones only."""
    codes, rows, grams, owners = word_grams(chunk)
    if wanted is not None:
        some = wanted[grams]
        grams, owners = grams[some], owners[some]
    order = np.unique(codes.astype(np.int64) * chunk.rows + rows)  # a word counts once in a text
    word, row = order // chunk.rows, order % chunk.rows
    by_word = np.argsort(owners, kind="stable")
    grams = grams[by_word]
    n_words = int(codes.max()) + 1 if len(codes) else 0
    low = np.searchsorted(owners[by_word], np.arange(n_words + 1))
    count = np.diff(low)[word]
    ends = np.cumsum(count)
    flat = grams[np.repeat(low[:-1][word] - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)]
    pair = np.unique(np.repeat(row, count) << BITS | flat)
    return pair >> BITS, (pair & ((1 << BITS) - 1)).astype(np.int32)


def ratios(positive: np.ndarray, negative: np.ndarray, texts: tuple[int, int], alpha: float) -> np.ndarray:
    """Log-count ratios of n-grams that stand in so many toxic and other texts, of `texts` toxic and other ones."""
    return np.log((positive + alpha) / (texts[0] + 2 * alpha)) - np.log((negative + alpha) / (texts[1] + 2 * alpha))


def select(positive: np.ndarray, negative: np.ndarray, texts: tuple[int, int], ratio: np.ndarray, least_ratio: float, least_count: int, most: int) -> np.ndarray:
    """Numbers of the n-grams that become features: frequent enough, with a ratio far enough from 0, those of the largest chi-square of label and n-gram."""
    count = positive + negative
    some = np.flatnonzero((count >= least_count) & (np.abs(ratio) >= least_ratio))
    expected = count[some] * (texts[0] / sum(texts))
    telling = (positive[some] - expected) ** 2 / expected
    return np.sort(some[np.lexsort((some, -telling))[:most]])


def regress(row: np.ndarray, feature: np.ndarray, ratio: np.ndarray, labels: np.ndarray, *, epochs: int = 200, rate: float = 0.05, ridge: float = 1e-4, scale: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features of labelled texts, both classes weighing the same, by gradient steps with
    moments; the weights of the n-grams and the bias. A weight keeps the sign of its n-gram's ratio."""
    value = ratio[feature] * scale
    theta, bias = np.zeros(len(ratio)), 0.0
    first, second = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    balance = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for t in range(1, epochs + 1):
        z = np.bincount(row, theta[feature] * value, minlength=len(labels)) + bias
        error = balance * (sigmoid(z) - labels)
        gradient = np.append(np.bincount(feature, error[row] * value, minlength=len(ratio)) / len(labels) + ridge * theta, error.mean())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        step = rate * first / (1 - 0.9**t) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        theta, bias = np.maximum(0, theta - step[:-1]), bias - step[-1]
    return theta * ratio * scale, float(bias)


def score_chunk(model: Model, chunk: B.Chunk) -> np.ndarray:
    row, gram = text_grams(chunk, model.weight != 0)
    return sigmoid(np.bincount(row, model.weight[gram], minlength=chunk.rows) + model.bias)


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, max_train: int = 4000, max_features: int = 8192,
    alpha: float = 1.0, least_ratio: float = 1.0, least_count: int = 3, **options,
) -> Model | None:
    """Fit on at most max_train labelled documents of each class; None without both classes."""
    scratch = Scratch(docs.sparkSession, "toxic")
    texts = scratch.keep(labelled_texts(docs, labels, id_col, text_col, label_col, max_train), "texts")
    n = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    if len(n) < 2:
        return None

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        label = batch.column(1).to_numpy().astype(np.int64)
        for chunk in lowered(batch.column(2)):
            row, gram = text_grams(chunk)
            yield label[chunk.first + row] << BITS | gram

    negative, positive = bucket_counts(texts, buckets, BITS + 1).reshape(2, -1)
    ratio = ratios(positive, negative, (n[1], n[0]), alpha)
    used = select(positive, negative, (n[1], n[0]), ratio, least_ratio, least_count, max_features)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for chunk in lowered(batch.column(2)):
            row, gram = text_grams(chunk, shared.value >= 0)
            has = np.zeros((chunk.rows, len(used)), bool)
            has[row, shared.value[gram]] = True
            cut = slice(chunk.first, chunk.last)
            yield pa.RecordBatch.from_arrays([batch.column(0)[cut], batch.column(1)[cut], pa.array([x.tobytes() for x in np.packbits(has, axis=1)], pa.binary())], ["key", "label", "bits"])

    rows = sorted(in_arrow(texts, features, "key long, label int, bits binary").collect())  # max_features bits a row
    shared.destroy()
    scratch.drop()
    has = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1, count=len(used))
    row, feature = np.nonzero(has)
    weight = np.zeros(1 << BITS, np.float32)
    weight[used], bias = regress(row, feature, ratio[used], np.array([r["label"] for r in rows], float), **options)
    return Model(weight, bias)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and a score from 0 to 1 of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scores = [score_chunk(m, c) if m is not None else np.zeros(c.rows) for c in lowered(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores))], [id_col, "score"])

    return in_arrow(docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")), run, f"`{id_col}` {kind}, score double")


def folded_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, folds: int = 4, **options) -> DataFrame:
    """(id, label, score) of all labelled texts, each scored by a model that was fitted on the other folds; to choose options by."""
    fold = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.lit("fold")), F.lit(folds))
    known = labels.where(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull())
    parts = []
    for k in range(folds):
        model = train(docs, known.where(fold != k), id_col, text_col, label_col, **options)
        out = known.where(fold == k).groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max((F.col(f"`{label_col}`") > 0).cast("int")).alias("label"))
        texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        parts.append(score(texts.join(out.select("id"), "id", "left_semi"), model, "id").join(out, "id").select("id", "label", "score"))
    return functools.reduce(DataFrame.unionByName, parts)
