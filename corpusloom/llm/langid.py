"""Language identification by segmentation-marginalised unigrams (operator 1).

Each language has one probability for each piece of a fixed public subword vocabulary. The
probability of a word is the sum over all ways to cut it into pieces of the product of their
probabilities, found by a forward algorithm; a text's score for a language is the sum of its
words' log-probabilities. The piece probabilities are fitted by expectation maximisation: the
expected number of uses of each piece, over all segmentations of the labelled words, from the
forward and backward sums.

Words are runs of letters and combining marks of the lower-cased text. Each distinct word of a
batch is scored once, for all languages together, and kept in a cache of bounded size.

Training takes at most `max_train` labelled rows of each language, and `max_total` in all, those
with the smallest hash of their id, and all words in them; the bounds are
parameters, and of rows with one id the smallest language and text count. Words are counted and their expected
uses added up by tasks; the driver gets one number a piece and language. Scoring covers every text whole.

The score says which language is the likeliest, not whether the text is one of any: of random letters, too, some language is
the likeliest by far. So `fit` compares the mean log-probability of a letter with what learning texts of the language have.

Defined results: `und` with score 0 if the text is null or has no letter (combining marks alone are
none), and if there is nothing to learn from; a letter run longer than 32 characters is cut every
32; on equal scores the first language in alphabetical order wins; equal texts give equal results;
a very long text is one chunk and needs memory in proportion; an empty table gives no rows; other
columns are kept, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import Scratch, bounded_sample, in_arrow, release

UNDETERMINED = "und"
RESULTS = ("lang_pred", "score", "fit")
LONGEST_WORD = 32
CACHE_WORDS = 100_000
LATTICE_WORDS = 4_000
#: Parts of one expected use, or of a log-probability, that are added up as whole numbers.
UNITS = 1 << 20
#: A text fits its language if the mean log-probability of its letters is not further below that of learning texts than so many standard deviations.
FIT_SPREAD, FIT_LEAST_SD, FIT_LETTERS = 8.0, 0.05, 20
NOT_LETTERS, LETTER = r"[^\p{L}\p{M}]+", r"\p{L}"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def load_pieces(path: str) -> list[str]:
    """Pieces of the vocabulary as text, lower-cased, without control and byte pieces, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p.lower() for p in found if p})


def _roll(h: np.ndarray, cp: np.ndarray) -> np.ndarray:
    return (h + cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (h >> np.uint64(31))


class Lattice:
    """All pieces that end at each place of many words of one length; place 0 stands for the mark of a word's beginning."""

    def __init__(self, words: np.ndarray, index: B.HashIndex, longest: int):
        self.n, self.size = words.shape
        self.arcs: list[tuple[int, int, np.ndarray]] = []  # (begin, end, piece of each word or -1)
        for begin in range(self.size):
            h = np.zeros(self.n, np.uint64)
            for end in range(begin + 1, min(begin + longest, self.size) + 1):
                h = _roll(h, words[:, end - 1])
                piece = index.get(B.mix(h))
                if end == begin + 1 or (piece >= 0).any():
                    self.arcs.append((begin, end, piece))


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    prob: np.ndarray  # pieces + 1 rows, one column for each language; the last row is zero
    unknown: float = 1e-7
    floor: np.ndarray | None = None  # of each language the least mean log-probability of a letter that its texts are expected to have
    _index: B.HashIndex | None = field(default=None, repr=False)
    _known: np.ndarray | None = field(default=None, repr=False)  # hashes of words scored before, in ascending order
    _scores: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "prob": self.prob, "unknown": self.unknown, "floor": self.floor}

    def __setstate__(self, state):
        self.__init__(**state)

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    def lattice(self, words: np.ndarray) -> Lattice:
        return Lattice(words, self.index, self.longest)

    @property
    def index(self) -> B.HashIndex:
        if self._index is None:
            n = len(self.pieces)
            size = np.fromiter(map(len, self.pieces), np.int64, n)
            wide = np.zeros((n, self.longest), np.uint32)
            for i, p in enumerate(self.pieces):
                wide[i, : len(p)] = [ord(c) for c in p]
            h = np.zeros(n, np.uint64)
            for k in range(self.longest):
                h = np.where(size > k, _roll(h, wide[:, k]), h)
            self._index = B.HashIndex(B.mix(h))
        return self._index

    def factor(self, piece: np.ndarray, single: bool) -> np.ndarray:
        p = self.prob[piece]
        if single:
            p = np.where((piece < 0)[:, None], self.unknown, p)
        return p

    def forward(self, lattice: Lattice) -> np.ndarray:
        """alpha[place, word, language]: the summed probability of all cuts up to the place."""
        alpha = np.zeros((lattice.size + 1, lattice.n, len(self.languages)))
        alpha[0] = 1
        for begin, end, piece in lattice.arcs:  # arcs come in the order of their beginnings
            alpha[end] += alpha[begin] * self.factor(piece, end == begin + 1)
        return alpha

    def expected(self, lattice: Lattice, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by language over all cuts of the words, which occur counts[word, language] times."""
        alpha = self.forward(lattice)
        beta = np.zeros_like(alpha)
        beta[-1] = counts / np.maximum(alpha[-1], 1e-300)
        out = np.zeros_like(self.prob)
        for begin, end, piece in reversed(lattice.arcs):
            p = self.factor(piece, end == begin + 1)
            through = p * beta[end]
            beta[begin] += through
            hit = piece >= 0
            uses = alpha[begin] * through
            used, place = np.unique(piece[hit], return_inverse=True)
            for k in range(len(self.languages)):
                out[used, k] += np.bincount(place, uses[hit, k], minlength=len(used))
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), len(self.languages)))
        out[:] = 0
        owner = np.repeat(np.arange(len(words)), [max(1, -(-len(w) // LONGEST_WORD)) for w in words])
        parts = split_long(words) if len(owner) > len(words) else words
        for at, wide in by_length(parts):
            np.add.at(out, owner[at], np.log(np.maximum(self.forward(self.lattice(wide))[-1], 1e-300)))
        return out

    def score_rows(self, column: pa.Array) -> np.ndarray:
        """Log-probability of each text by language; rows without letters are NaN."""
        out = np.concatenate([self._score(c) for c in B.chunks(words_only(column))] or [np.zeros((0, len(self.languages)))])
        out[~pc.fill_null(pc.match_substring_regex(column, LETTER), False).to_numpy(zero_copy_only=False)] = np.nan
        return out

    def _score(self, chunk: B.Chunk) -> np.ndarray:
        w = B.words(chunk, B.NON_SPACE)
        if len(w) == 0:
            return np.full((chunk.rows, len(self.languages)), np.nan)
        codes, uniques = pd.factorize(w.hash)
        each = np.zeros((len(uniques), len(self.languages)), np.float32)
        fresh = np.ones(len(uniques), bool)
        if self._known is not None:
            at = np.minimum(np.searchsorted(self._known, uniques), len(self._known) - 1)
            fresh = self._known[at] != uniques
            each[~fresh] = self._scores[at[~fresh]]
        fresh = np.flatnonzero(fresh)
        if len(fresh):
            first = np.empty(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            raw, at = chunk.buf.tobytes(), first[fresh]
            made = [raw[a:b].decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)]
            each[fresh] = self.word_scores(made)
            if self._known is None or len(self._known) > CACHE_WORDS:
                known, scores = uniques[fresh], each[fresh]
            else:
                known, scores = np.concatenate((self._known, uniques[fresh])), np.concatenate((self._scores, each[fresh]))
            order = np.argsort(known)
            self._known, self._scores = known[order], scores[order]
        each = each[codes]
        out = np.column_stack([np.bincount(w.row, each[:, k], minlength=chunk.rows) for k in range(len(self.languages))])
        out[np.diff(w.first) == 0] = np.nan
        return out


def by_length(words: list[str]):
    """Index of words and their code points behind a mark, for words of one length at a time; long ones in several parts."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        for lo in range(0, len(at), LATTICE_WORDS):
            part = at[lo : lo + LATTICE_WORDS]
            wide = np.frombuffer("".join(words[i] for i in part.tolist()).encode("utf-32-le"), np.uint32).reshape(len(part), n)
            yield part, np.column_stack((np.full(len(part), 0x2581, np.uint32), wide))


def split_long(words: list[str]) -> list[str]:
    return [w[i : i + LONGEST_WORD] for w in words for i in range(0, len(w), LONGEST_WORD)]


def letter_counts(column: pa.Array) -> np.ndarray:
    """Letters and marks of each text."""
    return pc.fill_null(pc.utf8_length(pc.replace_substring_regex(column, NOT_LETTERS, "")), 0).to_numpy(zero_copy_only=False)


def words_only(column: pa.Array) -> pa.Array:
    """Lower-cased letters and marks, and a space for each run of anything else."""
    return pc.replace_substring_regex(pc.utf8_lower(column), NOT_LETTERS, " ")


def fit(words: list[str], counts: np.ndarray, languages: list[str], pieces: list[str], *, rounds: int = 3, smooth: float = 0.02) -> Model:
    """Piece probabilities of each language by expectation maximisation over all segmentations of words of at most
    LONGEST_WORD characters, which occur counts[word, language] times."""
    model = Model(languages, pieces, start(pieces, languages))
    for _ in range(rounds):
        expected = np.zeros_like(model.prob)
        for at, wide in by_length(words):
            expected += model.expected(model.lattice(wide), counts[at])
        model.prob = improved(expected, smooth)
    return model


def start(pieces: list[str], languages: list[str]) -> np.ndarray:
    """Every piece as likely as any other; the last row stands for no piece."""
    out = np.full((len(pieces) + 1, len(languages)), 1 / max(1, len(pieces)))
    out[-1] = 0
    return out


def improved(expected: np.ndarray, smooth: float) -> np.ndarray:
    """Probabilities from expected uses."""
    out = expected + smooth
    out /= out[:-1].sum(0)
    out[-1] = 0
    return out


def word_table(rows: DataFrame) -> DataFrame:
    """(lang, word, n): how often each word stands in the texts of each language; long letter runs in parts. rows: lang, text."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        names = batch.column(0).to_pylist()
        tally: dict[tuple[str, str], int] = {}
        for language, text in zip(names, words_only(batch.column(1)).to_pylist(), strict=True):
            for word in split_long((text or "").split()):
                tally[language, word] = tally.get((language, word), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.string()), pa.array([k[1] for k in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["lang", "word", "n"])

    return in_arrow(rows.select("lang", "text"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_uses(words: DataFrame, model: Model) -> np.ndarray:
    """Model.expected over a table (lang, word, n), added up by tasks: what reaches the driver has the size of the model.

    Sums are of whole numbers (2^-20 of a use each), so that their order does not matter."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())  # what is freed can be given back
        m = shared.value
        place = {name: k for k, name in enumerate(m.languages)}
        total = np.zeros_like(m.prob)
        for batch in batches:
            for at in range(0, batch.num_rows, LATTICE_WORDS):
                part = batch.slice(at, LATTICE_WORDS)
                word, names = pd.factorize(part.column(1).to_numpy(zero_copy_only=False))
                counts = np.zeros((len(names), len(place)))
                counts[word, [place[x] for x in part.column(0).to_pylist()]] = part.column(2).to_numpy()
                for some, wide in by_length(names.tolist()):
                    total += m.expected(m.lattice(wide), counts[some])
        piece, lang = np.nonzero(total)
        uses = np.rint(total[piece, lang] * UNITS).astype(np.int64)
        del total
        release()
        for at in range(0, len(uses), 1 << 16):
            cut = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(piece[cut].astype(np.int32)), pa.array(lang[cut].astype(np.int32)), pa.array(uses[cut])], ["piece", "lang", "n"])

    got = words.select("lang", "word", "n").mapInArrow(run, "piece int, lang int, n long").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros_like(model.prob)
    out[got.column("piece").to_numpy(), got.column("lang").to_numpy()] = got.column("n").to_numpy() / UNITS
    return out


def least_fit(texts: DataFrame, model: Model) -> np.ndarray:
    """For each language how little a letter of its learning texts fits: FIT_SPREAD standard deviations below the mean, over texts of FIT_LETTERS letters or more."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        total, letters = m.score_rows(batch.column(1)), letter_counts(batch.column(1))
        own = np.array([m.languages.index(x) for x in batch.column(0).to_pylist()], np.int64)
        some = np.flatnonzero(~np.isnan(total[:, 0]) & (letters >= FIT_LETTERS))
        value = total[some, own[some]] / letters[some]
        return pa.RecordBatch.from_arrays([pa.array(own[some].astype(np.int32)), pa.array(np.rint(value * UNITS).astype(np.int64))], ["lang", "fit"])

    fits = in_arrow(texts.select("lang", "text"), run, "lang int, fit long")
    sums = fits.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("fit").alias("s"), F.sum(F.col("fit").cast("decimal(38,0)") * F.col("fit")).alias("q")).collect()
    shared.destroy()
    out = np.full(len(model.languages), -np.inf)
    for r in sums:
        mean = r["s"] / r["n"] / UNITS
        out[r["lang"]] = mean - FIT_SPREAD * max(FIT_LEAST_SD, np.sqrt(max(0.0, float(r["q"]) / r["n"] / UNITS**2 - mean**2)))
    return out


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, vocabulary: str | None = None, max_train: int = 1200, max_total: int = 24_000, max_languages: int = 1000, rounds: int = 3, smooth: float = 0.02
) -> Model | None:
    """Fit on at most max_train rows of each language and max_total in all, on all of their words; None without
    labelled rows with letters. More than max_languages languages are a ValueError, as the model grows with them."""
    id_name, lang, text = (F.col(f"`{c}`") for c in (id_col, lang_col, text_col))
    rows = docs.where(lang.isNotNull() & id_name.isNotNull() & text.isNotNull()).select(id_name.alias("id"), lang.cast("string").alias("lang"), text.cast("string").alias("text"))
    kinds = rows.select("lang").distinct().limit(max_languages + 1).count()
    if kinds > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    sample = bounded_sample(rows.groupBy("id").agg(F.min("lang").alias("lang")), "id", ["lang"], max(1, min(max_train, max_total // max(1, kinds))))
    scratch = Scratch(docs.sparkSession, "language")
    texts = scratch.keep(rows.select("id", "text").join(F.broadcast(sample), "id").groupBy("id").agg(F.min("lang").alias("lang"), F.min("text").alias("text")), "texts")
    words = scratch.keep(word_table(texts), "words")
    languages = sorted(r["lang"] for r in words.select("lang").distinct().collect())  # max_languages at most
    if not languages:
        return None
    pieces = load_pieces(vocabulary or default_vocabulary())
    model = Model(languages, pieces, start(pieces, languages))
    for _ in range(rounds):
        model = Model(languages, pieces, improved(expected_uses(words, model), smooth))
    model.floor = least_fit(texts, model)
    scratch.drop()
    release()
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All columns, with lang_pred, score, and fit: by how much the mean log-probability of a letter lies above the
    least that is expected of a text of this language (null for `und` and below FIT_LETTERS letters); columns of these names are replaced."""
    names = [c for c in docs.columns if c not in RESULTS]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + ", lang_pred string, score double, fit double"
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, n = shared.value, batch.num_rows
        if m is None:
            pred, score, fit, none = np.full(n, UNDETERMINED, object), np.zeros(n), np.zeros(n), np.ones(n, bool)
            few = none
        else:
            column = batch.column(names.index(text_col))
            total = m.score_rows(column)
            none = np.isnan(total[:, 0])
            total[none] = 0
            best = total.argmax(1)
            post = np.exp(total - total.max(1, keepdims=True))
            score = np.where(none, 0.0, 1 / post.sum(1))
            pred = np.where(none, UNDETERMINED, np.array(m.languages, object)[best])
            letters = letter_counts(column)
            few = letters < FIT_LETTERS
            fit = total[np.arange(n), best] / np.maximum(1, letters) - (0.0 if m.floor is None else m.floor[best])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(fit, mask=none | few)], [*names, *RESULTS])

    return in_arrow(docs.select(*[F.col(f"`{c}`") for c in names]), run, schema)
