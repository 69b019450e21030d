"""Near-duplicate lines by an exact set-similarity join (operator 2).

A line is the set of its words (lower-cased; ASCII letters, digits and everything outside ASCII).
Lines of at least `least_words` distinct words take part; the query and the pipeline let all lines
that have words take part. A line is removed if an earlier line, in the order of document id and line
number, has a Jaccard similarity of at least `threshold` with it.

1. Words are ordered by rarity, from counts over all lines in a table of fixed size (equal counts,
   and words that share a bucket, are ordered by their hash: any total order keeps the join exact).
2. Equal sets form classes: a task hands on a set once (a line that it finds equal to an earlier one
   goes on as its place alone), and of what meets by the set's hash the first line goes on.
3. Each line hands on the words of its prefix; a line so short that one more word takes it below the
   threshold (up to 3 words at 0.8) can equal other sets only and hands on none. Lines that share one
   meet in that word's group, where the length filter (a range of the group sorted by length), the
   positional filter and a parity bitmap (each differing word changes one bit, so more changed bits
   than the similarity allows rule a pair out; longer lines have longer bitmaps) leave few pairs. All
   filters are lossless.
4. Candidates are verified on the whole sets, in rounds: of each line and group the 4 earliest are
   handed on, so a group of similar lines gives a few rows a line. Lines whose candidates all fail
   and that have more go to the next round with 64 times as many, until none is left. A round looks at
   the groups in which such open lines have more; at worst, at all groups once more.
Groups of more than `hot` lines are dealt to cells, a pair of blocks each, before they are gathered.
They are found by counts in a table of fixed size; only words of its full buckets are counted one by one.

Defined results: null texts have no lines; rows with one id and one text are one document and keep
the same lines; rows with one id and different texts are ordered by line number, then by a hash of the text; null ids
come first, and an id of -2^63 counts as null; ids of other types than whole numbers are a TypeError; a very long
text or line is one chunk and needs memory in proportion; an empty table gives no rows; other columns are kept, those with clashing names too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from . import _bytes as B
from .common import Scratch, in_arrow, partitions, release, unused
from .sketch import bucket_counts, marks

BITS = 22
#: Prefix rows that a task gathers, and pairs that it looks at in one go.
TASK_ROWS, PAIR_BLOCK = 400_000, 250_000
#: Candidates of a line and word that a round hands on; the next round takes ROUND times as many.
FIRST_ROUND, ROUND = 4, 64


def places(chunk: B.Chunk) -> tuple[B.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a chunk and the line each stands in; row and number of each line that has words, in order."""
    newline = np.flatnonzero(chunk.buf == 0x0A)
    w = B.words(chunk, B.WORDLIKE)
    ended = np.cumsum(np.bincount(np.searchsorted(w.start, newline), minlength=len(w) + 1)[: len(w)])  # newlines before each word
    number = ended - np.repeat(np.searchsorted(newline, chunk.offs[:-1]), np.diff(w.first))
    fresh = np.ones(len(w), bool)
    fresh[1:] = (w.row[1:] != w.row[:-1]) | (number[1:] != number[:-1])
    first = np.flatnonzero(fresh)
    return w, np.cumsum(fresh) - 1, w.row[first], number[first]


def ordered_words(line: np.ndarray, word: np.ndarray, scale: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each line, by line, then by rarity, then by hash."""
    key = (line.astype(np.uint64) << np.uint64(40)) | (word & np.uint64(0xFFFFFFFF))
    if scale is not None:
        key |= scale[(word >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)
    order = np.argsort(key)
    key, line, word = key[order], line[order], word[order]
    same = key[1:] == key[:-1]
    if (same & (word[1:] != word[:-1])).any():  # two words of a line share half of their hash
        order = np.lexsort((word, key))
        line, word, key = line[order], word[order], key[order]
        same = (key[1:] == key[:-1]) & (word[1:] == word[:-1])
    keep = np.append(True, ~same)[: len(line)]
    return line[keep], word[keep]


def bitmap_words(size: np.ndarray) -> np.ndarray:
    """Length of the parity bitmap of a line of so many words, in words of 64 bits: 1 up to 48, 2 up to 96, and so on up to 64."""
    return 1 << np.clip(np.ceil(np.log2(np.maximum(size, 1) / 48.0)).astype(np.int64), 0, 6)


def bitmaps(line: np.ndarray, word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity bitmaps of all lines in one array of 64-bit words, and where each begins. A longer one folds to a shorter one."""
    width = bitmap_words(size)
    at = np.concatenate(([0], np.cumsum(width)))
    h = B.mix(word + np.uint64(77))
    out = np.zeros(int(at[-1]), np.uint64)
    place = at[line] + ((h >> np.uint64(6)).astype(np.int64) & (width[line] - 1))  # folding in halves keeps the bit in its word
    np.bitwise_xor.at(out, place, np.uint64(1) << (h & np.uint64(63)))
    return out, at


def _lowered(batch: pa.RecordBatch, column: int) -> Iterator[B.Chunk]:
    return B.chunks(pc.utf8_lower(batch.column(column)))


def word_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How often the words of each bucket stand in the corpus, on a scale of 256 steps; and the number of words."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for chunk in _lowered(batch, 0):
            yield (B.words(chunk, B.WORDLIKE).hash >> np.uint64(64 - BITS)).astype(np.int64)

    total = bucket_counts(docs.select("_text"), buckets, BITS)
    return np.minimum(255, np.round(12 * np.log2(1.0 + total))).astype(np.uint8), int(total.sum())


def need(a, b, threshold: float):
    """Least overlap of sets of a and b words with a Jaccard similarity of the threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def line_table(docs: DataFrame, rarity: np.ndarray, threshold: float, least_words: int) -> DataFrame:
    """One row for each line that takes part: set hash, place, size, parity bitmap and prefix words. Of a line that a line
    before it in the order equals, as far as a task has seen, the place is all there is (size 0), under a spread set hash."""
    shared = docs.sparkSession.sparkContext.broadcast(rarity)

    def run(batch: pa.RecordBatch, seen: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        scale = shared.value
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for chunk in _lowered(batch, 2):
            w, line, row, number = places(chunk)
            n = len(row)
            if n == 0:
                continue
            line, word = ordered_words(line, w.hash, scale)
            start = np.searchsorted(line, np.arange(n))
            size = np.bincount(line, minlength=n)
            one = np.add.reduceat(B.mix(word + np.uint64(11)), start)
            two = np.add.reduceat(B.mix(word ^ np.uint64(0xA5A5A5A5A5A5A5A5)), start)
            doc, place = ids[chunk.first + row], number << 32 | texts[chunk.first + row]
            again = _again(seen, one.tolist(), list(zip(doc.tolist(), place.tolist(), strict=True)))
            own = (size >= least_words) & (again == 0)
            bits, at = bitmaps(line, word, size)
            prefix = np.minimum(size, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1)
            prefix[(size < threshold * (size + 1) - 1e-9) | ~own] = 0
            chosen = np.arange(len(line)) - start[line] < prefix[line]
            words = (word[chosen] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            take = np.flatnonzero((size >= least_words) & (again < 2))
            gone = again[take] == 1
            one[take[gone]] = B.mix(doc[take[gone]].view(np.uint64) + B.mix(place[take[gone]].view(np.uint64)))
            offsets = np.concatenate(([0], np.cumsum(prefix[take]))).astype(np.int32)
            width = np.where(gone, 0, np.diff(at)[take])
            ends = np.concatenate(([0], np.cumsum(width)))
            packed = bits[np.repeat(at[:-1][take] - ends[:-1], width) + np.arange(ends[-1])]
            maps = pa.Array.from_buffers(pa.binary(), len(take), [None, pa.py_buffer((ends * 8).astype(np.int32)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(one[take].view(np.int64)), pa.array(two[take].view(np.int64)), pa.array(doc[take]), pa.array(place[take]),
                    pa.array(np.where(gone, 0, size[take]).astype(np.int32)), maps, pa.ListArray.from_arrays(pa.array(offsets), pa.array(words)),
                ],
                LINE_COLUMNS,
            )

    return in_arrow(docs.select("_id", "_hash", "_text"), run, LINE_SCHEMA, state=dict)


LINE_COLUMNS = ["h1", "h2", "doc", "place", "size", "bitmap", "prefix"]
FIRST_COLUMNS, FIRST_SCHEMA = LINE_COLUMNS[2:], "doc long, place long, size int, bitmap binary, prefix array<int>"
LINE_SCHEMA = f"h1 long, h2 long, {FIRST_SCHEMA}"
SEEN_SETS = 200_000


def _again(seen: dict[int, tuple[int, int]], sets: list[int], order: list[tuple[int, int]]) -> np.ndarray:
    """For each line 0 if it is the first of its set so far, 1 if an earlier one was seen, 2 if it is the same line again. Forgets all when `seen` is full."""
    if len(seen) > SEEN_SETS:
        seen.clear()
    out = np.zeros(len(sets), np.int8)
    for i, (key, mine) in enumerate(zip(sets, order, strict=True)):
        first = seen.get(key)
        if first is None or mine < first:
            seen[key] = mine
        else:
            out[i] = 1 + (mine == first)
    return out


def first_lines(table: DataFrame, parts: int) -> DataFrame:
    """Of the lines with one set hash the first, as it is; of the others the place, with size 0. A line that is there twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        one, two, doc, place, size = (t.column(k).to_numpy() for k in range(5))
        order = np.lexsort((place, doc, two, one))
        one, two, doc, place = one[order], two[order], doc[order], place[order]
        same = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        fresh = np.append(True, ~same)
        head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        t = t.select(FIRST_COLUMNS)
        live = size[order] > 0
        self = (doc == doc[head]) & (place == place[head])
        first, other = order[fresh & live], order[~live | ~self]
        for at in range(0, len(first), 50_000):
            yield from t.take(pa.array(first[at : at + 50_000])).combine_chunks().to_batches()
        if len(other):
            gone = t.take(pa.array(other)).combine_chunks()
            n = gone.num_rows
            empty = [pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([gone.column(k).chunk(0) for k in range(2)] + empty, FIRST_COLUMNS)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return table.repartition(parts, "h1").mapInArrow(released, FIRST_SCHEMA)


class Bitmaps:
    """Parity bitmaps of rows in a given order, compared at the shorter length of two."""

    def __init__(self, column: pa.ChunkedArray, size: np.ndarray, order: np.ndarray):
        column = column.combine_chunks()
        _, offsets, data = column.buffers()
        begin = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column)].astype(np.int64)[order]
        data = np.frombuffer(data, np.uint8)
        self.level = np.log2(bitmap_words(size[order])).astype(np.int64)
        self.maps: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        above = None
        for level in range(int(self.level.max()), -1, -1):
            mine = np.flatnonzero(self.level == level)
            own = data[begin[mine][:, None] + np.arange(8 << level)].view(np.uint64) if len(mine) else np.zeros((0, 1 << level), np.uint64)
            rows = mine
            if above is not None:  # word k of the shorter map is the fold of the words k and k + its length of the longer
                folded = above[1][:, : 1 << level] ^ above[1][:, 1 << level :]
                rows, own = np.concatenate((mine, above[0])), np.concatenate((own, folded))
            above = (rows, own)
            index = np.full(len(order), -1, np.int64)
            index[rows] = np.arange(len(rows))
            self.maps.insert(0, own)
            self.index.insert(0, index)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        level = np.minimum(self.level[i], self.level[j])
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            for lo in range(0, len(at), max(1, 1_000_000 >> k)):
                part = at[lo : lo + max(1, 1_000_000 >> k)]
                out[part] = np.bitwise_count(self.maps[k][self.index[k][i[part]]] ^ self.maps[k][self.index[k][j[part]]]).sum(1)
        return out


def first_of_each(later: np.ndarray, earlier: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of each later line the `most` with the smallest earlier one."""
    order = np.lexsort((earlier, later))
    later, earlier = later[order], earlier[order]
    fresh = np.append(True, later[1:] != later[:-1])[: len(later)]
    keep = np.arange(len(later)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] < most
    return later[keep], earlier[keep]


def group_sizes(words: DataFrame, hot: int) -> tuple[int, np.ndarray]:
    """Number of all words, and the buckets that hold more than `hot` of them. words: one column, a word or an array of words a row."""

    def buckets(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        column = batch.column(0)
        yield bucket(column.flatten() if pa.types.is_list(column.type) else column)

    total = bucket_counts(words, buckets, BITS)
    return int(total.sum()), np.flatnonzero(total > hot)


def bucket(word: pa.Array) -> np.ndarray:
    return (word_hash(word.to_numpy(zero_copy_only=False)) >> np.uint64(64 - BITS)).astype(np.int64)


def frequent(rows: DataFrame, full: np.ndarray, hot: int) -> DataFrame:
    """(word, n) of the words that more than `hot` rows have; all of them stand in the full buckets."""
    shared = rows.sparkSession.sparkContext.broadcast(full)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(np.isin(bucket(batch.column(0)), shared.value)))

    return in_arrow(rows.select("word"), run, "word int").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)


def candidates(rows: DataFrame, words: DataFrame, threshold: float, most: int, hot: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (doc, place, doc2, place2) of a later and an earlier line that share a prefix word and pass the filters, of each line and word the
    `most` earliest; and the lines and words (doc, place, word) that have others.

    rows: word, span (place in the order << 32 | size), doc, place, bitmap, and probe, if only some are taken as the later one; words: as
    `group_sizes` takes them. Tasks get about TASK_ROWS rows each, whatever the number of shuffle partitions is set to."""
    n_rows, full = group_sizes(words, hot)
    hot_words = scratch.keep(frequent(rows, full, hot), f"{name}-hot") if len(full) else None
    keys = ["word"]
    if hot_words is not None and not hot_words.isEmpty():
        n = F.ceil(F.col("n") / F.lit(hot)).cast("int")
        large = rows.join(hot_words, "word").withColumn("n", n).withColumn("block", F.pmod(F.xxhash64("doc", "place"), F.col("n")).cast("int"))
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        cell = F.least("block", "other") * F.col("n") + F.greatest("block", "other") + 1
        rows = rows.join(hot_words, "word", "left_anti").withColumn("cell", F.lit(0)).unionByName(large.withColumn("cell", cell).drop("n", "block", "other"))
        keys, n_rows = ["word", "cell"], n_rows + (hot_words.agg(F.sum(F.col("n") * F.ceil(F.col("n") / F.lit(hot)))).first()[0] or 0)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        word, span, doc, place = (t.column(c).to_numpy() for c in ("word", "span", "doc", "place"))
        size, pos = span & 0xFFFFFFFF, span >> 32
        if "cell" in names:
            cell = t.column("cell").to_numpy()
            order = np.lexsort((size, cell, word))
        else:
            cell, order = None, np.argsort(word.astype(np.int64) << 32 | size)
        differing = Bitmaps(t.column("bitmap"), size, order)
        probe = t.column("probe").to_numpy()[order] if "probe" in names else None
        word, pos, doc, place, size = (x[order] for x in (word, pos, doc, place, size))
        fresh = word[1:] != word[:-1]
        if cell is not None:
            fresh |= cell[order][1:] != cell[order][:-1]
        del t, span
        n = len(word)
        by_rank = np.lexsort((place, doc))
        rank = np.empty(n, np.int64)
        rank[by_rank] = np.arange(n)
        group = np.cumsum(np.append(True, fresh)) - 1
        least = np.ceil(threshold * size - 1e-9).astype(np.int64)
        # the first row of the group that is long enough: rows are ordered by group, then by size
        width = int(size.max()) + 1
        low = np.searchsorted(group * width + size, group * width + least)
        count = np.arange(n) - low
        passed = np.zeros(n, np.int64)
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        ends = np.cumsum(count)
        at = 0
        while at < n:
            base = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + PAIR_BLOCK, "right")))
            c = count[at:to]
            i = np.repeat(np.arange(at, to), c)
            j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[at:to], c)
            at = to
            o = need(size[i], size[j], threshold)
            ok = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= o
            i, j, o = i[ok], j[ok], o[ok]
            ok = differing(i, j) <= size[i] + size[j] - 2 * o
            i, j = i[ok], j[ok]
            after = rank[i] > rank[j]
            later, earlier = np.where(after, i, j), np.where(after, j, i)
            keep = (doc[i] != doc[j]) | (place[i] != place[j])
            if probe is not None:
                keep &= probe[later]
            later, earlier = later[keep], rank[earlier[keep]]
            passed += np.bincount(later, minlength=n)
            held.append((later, earlier))
            if sum(len(x) for x, _ in held) > 4 * PAIR_BLOCK + len(held[0][0]):  # no group's pairs are ever held at once
                held = [first_of_each(*map(np.concatenate, zip(*held, strict=True)), most)]
        later, earlier = first_of_each(*map(np.concatenate, zip(*held, strict=True)), most)
        earlier = by_rank[earlier]
        for k in range(0, len(later), 100_000):
            a, b = later[k : k + 100_000], earlier[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(place[a]), pa.array(doc[b]), pa.array(place[b]), pa.nulls(len(a), pa.int32())], PAIR_COLUMNS)
        others = np.flatnonzero(passed > most)
        for k in range(0, len(others), 100_000):
            a = others[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(place[a]), *[pa.nulls(len(a), pa.int64())] * 2, pa.array(word[a])], PAIR_COLUMNS)

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    found = rows.repartition(max(1, -(-n_rows // TASK_ROWS)), *keys).mapInArrow(released, "doc long, place long, doc2 long, place2 long, word int")
    found = scratch.keep(found.distinct(), name)
    return found.where("word IS NULL").drop("word"), found.where("word IS NOT NULL").select("doc", "place", "word")


PAIR_COLUMNS = ["doc", "place", "doc2", "place2", "word"]


def line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Words of the wanted lines (doc, place). A bit table of them and their documents keeps other documents from being split and other lines out of the shuffle."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        doc, place = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        yield place_hash(doc, place)
        yield place_hash(doc, -1 - (place & 0xFFFFFFFF))  # no place of a line

    marked = docs.sparkSession.sparkContext.broadcast(marks(wanted, keys))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(marked.value.has(place_hash(batch.column(0).to_numpy(), -1 - batch.column(1).to_numpy()))))
        ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for chunk in _lowered(batch, 2):
            w, line, row, number = places(chunk)
            doc, place = ids[chunk.first + row], number << 32 | texts[chunk.first + row]
            hit = marked.value.has(place_hash(doc, place))
            if not hit.any():
                continue
            asked = hit[line]
            line, word = ordered_words(line[asked], w.hash[asked], None)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(line, minlength=len(row))[hit]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(doc[hit]), pa.array(place[hit]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(word.view(np.int64)))], ["doc", "place", "words"])

    got = in_arrow(docs.select("_id", "_hash", "_text"), run, "doc long, place long, words array<long>")
    return got.join(wanted, ["doc", "place"], "left_semi").dropDuplicates(["doc", "place"])


def place_hash(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return B.mix(B.mix(doc.view(np.uint64)) + place.view(np.uint64))


def place_marks(wanted: DataFrame):
    """A broadcast bit table of places (doc, place)."""

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    return wanted.sparkSession.sparkContext.broadcast(marks(wanted, keys))


def verified(docs: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""
    wanted = pairs.select("doc", "place").union(pairs.select(F.col("doc2"), F.col("place2"))).distinct()
    words = line_words(docs, wanted)
    other = words.select(F.col("doc").alias("doc2"), F.col("place").alias("place2"), F.col("words").alias("words2"))
    both = pairs.join(words, ["doc", "place"]).join(other, ["doc2", "place2"])
    shared = F.size(F.array_intersect("words", "words2"))
    return both.where(shared >= threshold * (F.size("words") + F.size("words2") - shared) - 1e-9).select("doc", "place", "doc2", "place2")


def prefix_rows(first: DataFrame) -> DataFrame:
    return first.select(F.posexplode("prefix").alias("pos", "word"), "doc", "place", "size", "bitmap").select(
        "word", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("size")).alias("span"), "doc", "place", "bitmap"
    )


def touched(first: DataFrame, open_words: DataFrame) -> DataFrame:
    """Prefix rows of the groups of the open lines' words (doc, place, word); two bit tables find them without a shuffle.

    Rows that share a bit with one of the words come along: more is compared, nothing is lost."""
    lines = place_marks(open_words.select("doc", "place").distinct())

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        yield word_hash(batch.column(0).to_numpy())

    wanted = first.sparkSession.sparkContext.broadcast(marks(open_words.select("word").distinct(), keys))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prefix = batch.column(4)
        size = np.diff(prefix.offsets.to_numpy())
        word = prefix.flatten().to_numpy()
        line = np.repeat(np.arange(batch.num_rows), size)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.flatnonzero(wanted.value.has(word_hash(word)))
        source = pa.array(line[hit])
        probe = lines.value.has(place_hash(batch.column(0).to_numpy(), batch.column(1).to_numpy()))[line[hit]]
        span = pos[hit] << 32 | batch.column(2).to_numpy()[line[hit]].astype(np.int64)
        columns = [pa.array(word[hit].astype(np.int32)), pa.array(span), *(batch.column(i).take(source) for i in (0, 1, 3)), pa.array(probe)]
        return pa.RecordBatch.from_arrays(columns, ["word", "span", "doc", "place", "bitmap", "probe"])

    return in_arrow(first.select("doc", "place", "size", "bitmap", "prefix"), run, "word int, span long, doc long, place long, bitmap binary, probe boolean")


def word_hash(word: np.ndarray) -> np.ndarray:
    return B.mix(word.astype(np.int64).view(np.uint64))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Key columns of a document: its id, and 32 bits of its text's hash to tell rows with one id apart."""
    kind = docs.schema[id_col].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        raise TypeError(f"{id_col} is {kind.simpleString()}; documents are ordered and keyed by whole numbers")
    return docs.select(document_key(id_col).alias("_id"), text_key(text_col).alias("_hash"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def document_key(id_col: str) -> Column:
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{text_col}`").cast("string")).bitwiseAND(F.lit(0xFFFFFFFF))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = 0.8, least_words: int = 1, hot: int = 20_000) -> DataFrame:
    """Lines to remove: (doc, hash, line) by document key, text key and line number from 0; a line may be there twice."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    source = keyed(docs, id_col, text_col)
    rarity, n_words = word_counts(source)
    parts = max(partitions(spark), -(-n_words // 8_000_000))
    # hashes all, so no dictionaries
    table = scratch.keep(first_lines(line_table(source, rarity, threshold, least_words), parts), "first", **{"parquet.enable.dictionary": "false"})
    first = table.where("size > 0").select("doc", "place", "size", "bitmap", "prefix")
    pairs, more = candidates(prefix_rows(first), first.select("prefix"), threshold, FIRST_ROUND, hot, scratch, "pairs")
    good = scratch.keep(verified(source, pairs, threshold), "good")
    later, most, k = good.select("doc", "place").distinct(), FIRST_ROUND, 0
    while True:  # lines whose earliest candidates all failed and that have more
        open_words = scratch.keep(more.join(later, ["doc", "place"], "left_anti"), f"open-{k}")
        if open_words.isEmpty():
            break
        most, k = most * ROUND, k + 1
        around = scratch.keep(touched(first, open_words), f"around-{k}")
        pairs, more = candidates(around, around.select("word"), threshold, most, hot, scratch, f"pairs-{k}")
        good = scratch.keep(verified(source, pairs, threshold), f"good-{k}")
        later = later.union(good.select("doc", "place").distinct())
    removed = table.where("size = 0").select("doc", "place").union(later)
    return removed.select("doc", F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).alias("hash"), F.shiftright("place", 32).cast("int").alias("line"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Removed lines of each document that loses any: (_id, _hash, removed)."""
    found = duplicate_lines(docs, id_col, text_col, **options)
    return found.groupBy(F.col("doc").alias("_id"), F.col("hash").alias("_hash")).agg(F.sort_array(F.collect_set("line")).alias("_removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """All columns, with the removed lines taken out of the text; a null text stays null."""
    id_name, hash_name, lost_name = unused(docs, "id", "hash", "removed")
    lost = removals(docs, id_col, text_col, **options).toDF(id_name, hash_name, lost_name)
    text, gone = F.col(f"`{text_col}`"), F.col(lost_name)
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone), lambda i: F.element_at(lines, i + 1))
    joined = docs.withColumns({id_name: document_key(id_col), hash_name: text_key(text_col)}).join(lost, [id_name, hash_name], "left")
    rest = F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, rest).select(*[F.col(f"`{c}`") for c in docs.columns])
