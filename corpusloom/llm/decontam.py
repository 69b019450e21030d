"""Benchmark decontamination by latent semantic retrieval and verification (operator 10).

1. Document counts of the benchmark's words are taken over the whole corpus; they give the inverse
   document frequencies, but a word keeps at least the weight that its rarity among the passages
   gives it. A word outside the benchmark weighs as much as the benchmark's rarest tenth.
2. The TF-IDF matrix of the benchmark's passages is decomposed by a randomised SVD. Its rows stay
   where they lie: tasks hand on their shares of A' A Q, which are summed by slices of words, the sum is
   orthonormalised, and the l x l matrix Q' A' A Q is decomposed exactly. The rank starts at a quarter
   of the number of passages and is cut to, or doubled up to, the least at which every passage keeps
   half of its squared length in the latent space (`kept`); so the rank follows from the benchmark and
   is the number of passages only where they have nothing in common. Passages go in blocks of
   `block_items`. A passage longer than one and a half windows goes in sections of about a window
   each, as its cosine with a window would fall with its length; it is verified as a whole.
3. Every document is read in windows of `window` words, one each half window. A window is projected
   into the latent space (its length counts all its words), and passages with a cosine of at least
   `cosine` are candidates. Windows whose weight in benchmark words is too small for that cosine
   are skipped; this loses none.
4. A candidate is verified on the words around the window: the longest common subsequence must cover
   `copy` of the passage, or `paraphrase` of it if the answer is there too: all words of the answer
   column. Where there is none, at least half of the words must be there that stand in the fewest
   passages (half of the passage's words or more), or all distinctive words of its last quarter.

The benchmark and its latent spaces travel with the tasks, so the sizes of both are checked (MOST_BYTES
and MOST_MODEL_BYTES; more is a ValueError); the corpus is never shuffled.

Defined results: null or empty texts match nothing; a passage without words is never found; equal
rows give equal matches, and a passage that is there twice is found twice; of windows with equal share
and cosine the first counts; a very long text is one chunk and needs memory in proportion; empty
tables give no matches; other columns are ignored by `matches` and kept by `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import Scratch, in_arrow

MOST_BYTES = 64 << 20
MOST_MODEL_BYTES = 256 << 20


def hashed(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text, in order."""
    out = []
    for chunk in B.chunks(pc.utf8_lower(pa.array(texts, pa.string()))):
        w = B.words(chunk, B.WORDLIKE)
        out += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the bits of one integer as a column."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    v = mask
    for y in b.tolist():
        m = places.get(y)
        if m is not None:
            u = v & m
            v = (v + u | v - u) & mask
    return len(a) - v.bit_count()


@dataclass
class Item:
    key: object
    words: np.ndarray
    answer: np.ndarray  # hashes of the answer's words, empty for the passage's last quarter
    number: int


@dataclass
class Space:
    """A block of passages, or of their sections, in its latent space."""

    items: list[Item]  # the passage of each section
    words: np.ndarray  # hashes of the block's words
    idf: np.ndarray
    unseen: float  # weight of a word outside the benchmark
    basis: np.ndarray  # words x rank
    coordinates: np.ndarray  # sections x rank, of length 1
    distinctive: list[frozenset]
    half_of: list[frozenset]  # half of these do as well; empty where there is an answer


def document_counts(docs: DataFrame, words: np.ndarray, text_col: str) -> tuple[np.ndarray, int]:
    """For each word the number of documents that have it, and the number of documents."""
    index, size = B.HashIndex(words), len(words)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(size + 1, np.int64)
        total[size] = batch.num_rows
        for chunk in B.chunks(pc.utf8_lower(batch.column(0))):
            w = B.words(chunk, B.WORDLIKE)
            number = index.get(w.hash)
            has = number >= 0
            total[:size] += np.bincount(np.unique(w.row[has] * size + number[has]) % size, minlength=size) if size else 0
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    out = np.zeros(size + 1, np.int64)
    for r in in_arrow(docs.select(F.col(f"`{text_col}`").cast("string")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]  # one row for each benchmark word at most
    return out[:size], int(out[size])


def sections(words: np.ndarray, size: int) -> list[np.ndarray]:
    """A passage in parts of equal length, about `size` words each; a short one is one part."""
    return [words] if 2 * len(words) <= 3 * size else np.array_split(words, -(-len(words) // size))


def weighted_rows(parts: list[np.ndarray], words: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF rows of length 1 as (row, word, value), sorted by row; each part has words of `words` only."""
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    number = np.searchsorted(words, np.concatenate(parts)) if len(row) else np.zeros(0, np.int64)
    key, times = np.unique(row * max(1, len(words)) + number, return_counts=True)
    row, number = key // max(1, len(words)), key % max(1, len(words))
    value = np.sqrt(times) * idf[number]
    return row, number, value / np.sqrt(np.bincount(row, value**2, minlength=len(parts)))[row]


def projected(rows: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, left: np.ndarray) -> np.ndarray:
    """A @ left for sparse rows."""
    row, number, value = rows
    out = np.zeros((n, left.shape[1]))
    for at in range(0, len(row), 65_536):
        part = slice(at, at + 65_536)
        begin = np.flatnonzero(np.append(True, row[part][1:] != row[part][:-1]))
        out[row[part][begin]] += np.add.reduceat(left[number[part]] * value[part][:, None], begin, axis=0)
    return out


class Passages:
    """The sections of a block of passages as a distributed matrix of TF-IDF rows over the block's words."""

    def __init__(self, table: DataFrame, words: np.ndarray, idf: np.ndarray):
        """table: (number, words), the hashes of each section."""
        self.table, self.words, self.idf = table, words, idf
        self.context = table.sparkSession.sparkContext

    def _each(self, left: np.ndarray, make, schema: str) -> DataFrame:
        """What make(numbers, rows, A @ left) gives for each batch of sections."""
        shared = self.context.broadcast((self.words, self.idf, left))

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            words, idf, q = shared.value
            rows = weighted_rows([np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()], words, idf)
            yield from make(batch.column(0), rows, projected(rows, batch.num_rows, q))

        return in_arrow(self.table, run, schema)

    def _total(self, shares: DataFrame, shape: tuple[int, int], height: int) -> np.ndarray:
        """Sum of matrices that come in slices of `height` rows; one matrix reaches the driver."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    got = np.frombuffer(data)
                    sums[k] = sums[k] + got if k in sums else got
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["slice", "data"])

        out = np.zeros(shape)
        for r in shares.repartition(max(1, min(16, -(-shape[0] // height))), "slice").mapInArrow(add, "slice int, data binary").collect():
            out[r["slice"] * height : (r["slice"] + 1) * height] = np.frombuffer(r["data"]).reshape(-1, shape[1])
        return out

    def gram(self, left: np.ndarray, height: int = 4096) -> np.ndarray:
        """A' (A left), words x columns."""
        d = len(self.words)

        def make(_, rows, made):
            row, number, value = rows
            order = np.argsort(number, kind="stable")
            row, number, value = row[order], number[order], value[order]
            total = np.zeros((d, made.shape[1]))
            for at in range(0, len(row), 65_536):
                part = slice(at, at + 65_536)
                begin = np.flatnonzero(np.append(True, number[part][1:] != number[part][:-1]))
                total[number[part][begin]] += np.add.reduceat(made[row[part]] * value[part][:, None], begin, axis=0)
            some = [k for k in range(-(-d // height)) if total[k * height : (k + 1) * height].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([total[k * height : (k + 1) * height].tobytes() for k in some], pa.binary())], ["slice", "data"])

        return self._total(self._each(left, make, "slice int, data binary"), (d, left.shape[1]), height)

    def small(self, left: np.ndarray) -> np.ndarray:
        """left' A' A left."""

        def make(_, rows, made):
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([(made.T @ made).tobytes()], pa.binary())], ["slice", "data"])

        width = left.shape[1]
        return self._total(self._each(left, make, "slice int, data binary"), (width, width), width)

    def coordinates(self, left: np.ndarray, n: int) -> np.ndarray:
        """A left, a row for each section by its number."""

        def make(numbers, rows, made):
            yield pa.RecordBatch.from_arrays([numbers, pa.array([x.astype("<f4").tobytes() for x in made], pa.binary())], ["number", "data"])

        out = np.zeros((n, left.shape[1]), np.float32)
        for r in self._each(left, make, "number int, data binary").collect():
            out[r["number"]] = np.frombuffer(r["data"], "<f4")
        return out


def randomised_svd(passages: Passages, columns: int) -> np.ndarray:
    """The leading right singular vectors of the passages' matrix, words x columns, the largest first."""
    q = np.random.Generator(np.random.PCG64(7)).standard_normal((len(passages.words), columns))
    for _ in range(2):  # one power step
        q, _ = np.linalg.qr(passages.gram(q))
    value, vector = np.linalg.eigh(passages.small(q))
    return q @ vector[:, np.argsort(-value)]


def latent(passages: Passages, n: int, kept: float) -> tuple[np.ndarray, np.ndarray]:
    """Basis (words x rank) and coordinates (sections x rank) of the least rank found at which every section keeps a share `kept` of its squared length."""
    full, rank = min(n, len(passages.words)), max(1, -(-n // 4))
    while True:
        columns = min(full, rank + 8)
        if 4 * columns * (len(passages.words) + n) > MOST_MODEL_BYTES:
            raise ValueError(f"a latent space of {len(passages.words)} words and {columns} columns is sent to every task and may have {MOST_MODEL_BYTES} bytes; use smaller blocks")
        basis = randomised_svd(passages, columns)
        place = passages.coordinates(basis, n)
        enough = np.flatnonzero((np.cumsum(place.astype(float) ** 2, axis=1) >= kept).all(axis=0))
        if len(enough) or columns == full:
            rank = int(enough[0]) + 1 if len(enough) else columns
            return basis[:, :rank], place[:, :rank]
        rank *= 2


def spaces(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, answer_col: str | None, text_col: str, block_items: int, window: int, kept: float = 0.5) -> list[Space]:
    fields = [F.col(item_col).alias("k"), F.col(item_text).cast("string").alias("t"), (F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")).alias("a")]
    bench = benchmark.select(*fields)
    size = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"the benchmark has {size} bytes; it is sent to every task and may have {MOST_BYTES}")
    rows = sorted(bench.collect(), key=lambda r: (str(r["k"]), r["t"] or ""))
    items = [Item(r["k"], w, a, n) for n, (r, w, a) in enumerate(zip(rows, hashed([r["t"] for r in rows]), hashed([r["a"] for r in rows]), strict=True)) if len(w)]
    if not items:
        return []
    every = np.unique(np.concatenate([i.words for i in items]))
    counts, n = document_counts(docs, every, text_col)
    inner = np.bincount(np.searchsorted(every, np.concatenate([np.unique(i.words) for i in items])), minlength=len(every))
    # a passage that a large part of the corpus holds must not turn its own words into stop words
    idf = np.maximum(np.log((n + 1) / (counts + 1)), np.log((len(items) + 1) / (inner + 1))) + 0.01
    unseen = float(np.quantile(idf, 0.9))
    out, bytes_sent = [], 0
    scratch = Scratch(docs.sparkSession, "passages")
    every_part = [(i, part) for i in items for part in sections(i.words, window)]
    for at in range(0, len(every_part), block_items):
        block, parts = map(list, zip(*every_part[at : at + block_items], strict=True))
        words = np.unique(np.concatenate(parts))
        mine = idf[np.searchsorted(every, words)]
        table = docs.sparkSession.createDataFrame([(k, p.tobytes()) for k, p in enumerate(parts)], "number int, words binary")
        table = scratch.keep(table.repartition(max(1, min(8, len(parts) // 32))), f"block-{at}")
        basis, c = latent(Passages(table, words, mine), len(parts), kept)
        c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        bytes_sent += 4 * basis.shape[1] * (len(words) + len(parts))
        if bytes_sent > MOST_MODEL_BYTES:
            raise ValueError(f"the latent spaces have over {bytes_sent} bytes; they are sent to every task and may have {MOST_MODEL_BYTES}")
        typical = float(np.median(mine))
        wanted, half_of = [], []
        for i in block:
            answer = i.answer if len(i.answer) else i.words[-max(1, len(i.words) // 4) :]
            rare = [h for h in answer.tolist() if idf[np.searchsorted(every, h)] >= typical] if not len(i.answer) else answer.tolist()
            wanted.append(frozenset(rare or answer.tolist()))
            # rarity among the passages here: in the corpus, just those words are rare that its paraphrases leave out
            whole = np.unique(i.words) if not len(i.answer) else i.answer
            few = inner[np.searchsorted(every, whole)] if not len(i.answer) else np.zeros(0)
            half_of.append(frozenset(whole[few <= np.median(few)].tolist() if len(few) else ()))
        scratch.drop(f"block-{at}")
        out.append(Space(block, words, mine, unseen, basis.astype(np.float32), c.astype(np.float32), wanted, half_of))
    return out


def _windows(w: B.Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and end of the windows of a chunk, one each half window."""
    half, counts = max(1, size // 2), np.diff(w.first)
    n = np.where(counts > 0, np.maximum(1, -(-(counts - size) // half) + 1), 0)
    row = np.repeat(np.arange(len(counts)), n)
    start = w.first[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * half
    return row, start, np.minimum(start + size, w.first[row + 1])


def _search(space: Space, index: B.HashIndex, w: B.Words, size: int, cosine: float, copy: float, paraphrase: float, found: np.ndarray | None = None) -> Iterator[tuple[int, Item, int, float, float, bool]]:
    """Matches of a chunk. With `found`, one is enough: rows that are marked there are not looked at, and those with a match are marked."""
    number = index.get(w.hash)
    row, start, end = _windows(w, size)
    if len(row) == 0:
        return
    known = number >= 0
    energy = np.where(known, np.append(space.idf, 0.0)[number] ** 2, space.unseen**2)
    total = np.concatenate(([0.0], np.cumsum(energy)))
    inside = np.concatenate(([0.0], np.cumsum(np.where(known, energy, 0))))
    length2 = np.maximum(total[end] - total[start], 1e-12)  # words that occur twice weigh a little less in the vector: see below
    hopeful = np.flatnonzero(inside[end] - inside[start] >= cosine**2 * length2)
    done: dict[tuple[int, int], tuple] = {}
    whole: dict[int, Item] = {}
    for at in range(0, len(hopeful), 512):
        part = hopeful[at : at + 512]
        if found is not None:
            part = part[~found[row[part]]]
            if len(part) == 0:
                continue
        count = end[part] - start[part]
        flat = np.repeat(start[part] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        owner = np.repeat(np.arange(len(part)), count)
        hit = known[flat]
        key, times = np.unique(owner[hit] * len(space.words) + number[flat[hit]], return_counts=True)
        who, what = key // len(space.words), key % len(space.words)
        value = (np.sqrt(times) * space.idf[what]).astype(np.float32)
        latent = np.zeros((len(part), space.basis.shape[1]), np.float32)
        begin = np.flatnonzero(np.append(True, who[1:] != who[:-1])) if len(who) else np.zeros(0, np.int64)
        if len(begin):
            latent[who[begin]] = np.add.reduceat(space.basis[what] * value[:, None], begin, axis=0)
        near = latent @ space.coordinates.T / np.sqrt(length2[part])[:, None]
        for i, j in zip(*np.nonzero(near >= cosine), strict=True):
            win, item = part[i], space.items[j]
            r, n = int(row[win]), len(item.words)
            if found is not None and found[r]:
                continue
            a, b = max(int(w.first[r]), int(start[win]) - n), min(int(w.first[r + 1]), int(end[win]) + n)
            around = w.hash[a:b]
            share = common_subsequence(item.words, around) / n
            there, some = set(around.tolist()), space.half_of[j]
            answered = space.distinctive[j] <= there or (len(some) > 0 and 2 * len(some & there) >= len(some))
            if share >= copy or (share >= paraphrase and answered):
                if found is not None:
                    found[r] = True
                new = (share, float(near[i, j]), -int(start[win] - w.first[r]), answered)
                if new > done.get((r, item.number), (-1.0,)):
                    done[(r, item.number)] = new
                    whole[item.number] = item
    for (r, n), (share, near, start_word, answered) in done.items():
        yield r, whole[n], -start_word, near, share, answered


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, keep: list[str] | None = None,
    window: int = 64, cosine: float = 0.2, copy: float = 0.8, paraphrase: float = 0.6, block_items: int = 1024, kept: float = 0.5,
) -> DataFrame:
    """One row for each document and passage found in it: the best window's first word, its cosine, the covered share of the passage, and whether the answer is there."""
    found = spaces(docs, benchmark, item_col, item_text, answer_col, text_col, block_items, window, kept)
    shared = docs.sparkSession.sparkContext.broadcast(found)
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    from pyspark.sql.pandas.types import to_arrow_type

    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names) + f", `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, first_word long, cosine double, covered double, answered boolean"

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        indexes = [B.HashIndex(s.words) for s in shared.value]
        rows, made = [], []
        for chunk in B.chunks(pc.utf8_lower(batch.column(len(names)))):
            w = B.words(chunk, B.WORDLIKE)
            best: dict[tuple[int, int], tuple] = {}  # sections of a passage may lie in several blocks
            for space, index in zip(shared.value, indexes, strict=True):
                for r, item, first, near, share, answered in _search(space, index, w, window, cosine, copy, paraphrase):
                    new = (share, near, -first, answered, item.key)
                    if (r, item.number) not in best or new[:4] > best[(r, item.number)][:4]:
                        best[(r, item.number)] = new
            for (r, _), (share, near, first, answered, key) in best.items():
                rows.append(chunk.first + r)
                made.append((key, -first, near, share, answered))
        if rows:
            taken = [batch.column(i).take(pa.array(rows)) for i in range(len(names))]
            columns = list(zip(*made, strict=True))
            kinds = [item_type, pa.int64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(taken + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*names, item_col, "first_word", "cosine", "covered", "answered"])

    return in_arrow(docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("_text")), run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All columns of the rows in which no passage was found."""
    item_col, item_text, answer_col = options.pop("item_col", "item_id"), options.pop("item_text", "text"), options.pop("answer_col", None)
    window, cosine, copy, paraphrase = (options.pop(k, v) for k, v in (("window", 64), ("cosine", 0.2), ("copy", 0.8), ("paraphrase", 0.6)))
    found = spaces(docs, benchmark, item_col, item_text, answer_col, text_col, options.pop("block_items", 1024), window, options.pop("kept", 0.5))
    if options:
        raise TypeError(f"unknown options: {', '.join(options)}")
    shared = docs.sparkSession.sparkContext.broadcast(found)
    at = docs.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        indexes = [B.HashIndex(s.words) for s in shared.value]
        bad = np.zeros(batch.num_rows, bool)
        for chunk in B.chunks(pc.utf8_lower(batch.column(at))):
            w = B.words(chunk, B.WORDLIKE)
            for space, index in zip(shared.value, indexes, strict=True):
                for _ in _search(space, index, w, window, cosine, copy, paraphrase, bad[chunk.first : chunk.last]):
                    pass
        if not bad.all():
            yield batch.filter(pa.array(~bad))

    return in_arrow(docs, run, docs.schema)
