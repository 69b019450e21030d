"""Packing of tokenized documents into windows by multiway differencing (operator 8).

Every document becomes the ids of its text followed by a separator id. It is cut into pieces of
at most `window` ids: whole windows first, then one remainder, or two if it exceeds half a window. The remainders of a block of
documents are dealt to m windows by the Karmarkar-Karp multiway differencing method: partial
partitions are merged so that the largest sum of one meets the smallest sum of the other, which
leaves sums that are nearly equal. m starts at the least possible number and rises whenever a
window would hold more than its capacity.

Pieces go to blocks by a hash of their ids and of their place in a task, about as many to each as
`block_docs` documents have; a block is bounded whatever the input, and no key can gather rows, those
of equal rows neither. Ids come from a public byte-level BPE vocabulary. Pre-tokens
are found with numpy over the code points of a whole batch and each distinct pre-token is encoded
once per worker (a cache of bounded size).

Defined results: a null or empty text is the separator alone; a text with characters that the
vectorised splitter does not cover goes through the tokenizer itself; equal rows are packed once
each; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import json
import os
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _bytes as B
from .common import HELD, in_arrow

WINDOW = 1024
SEPARATOR = 0
CACHE_TOKENS = 100_000

_O, _L, _N, _S, _ODD = 0, 1, 2, 3, 4


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of many texts at once, equal to those of `tokenizers` for the same vocabulary file."""

    @classmethod
    def of(cls, path: str) -> Encoder:
        made = HELD.get("encoder")
        if made is None or made.path != path:
            made = HELD["encoder"] = cls(path)
        return made

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ranks = self._ranks(model["vocab"])
        every = "".join(map(chr, (c for c in range(0x3000) if not 0xD800 <= c < 0xE000)))
        kind = np.full(0x3000, _O, np.uint8)
        for value, pattern in ((_L, r"\p{L}"), (_N, r"\p{N}"), (_S, r"[ \t\n\r\v\f]")):
            kind[[ord(c) for c in regex.findall(pattern, every)]] = value
        kind[[ord(c) for c in regex.findall(r"[\p{C}\p{Z}\s]", every) if c not in " \t\n\r"]] = _ODD
        kind[0x2FFF] = _ODD
        self.kind = kind
        self.value = B.mix(np.arange(1, 0x3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self._clear()

    @cached_property
    def whole(self):
        """The tokenizer itself; loaded only where a text needs it."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.encode_special_tokens = True
        return made

    def _ranks(self, vocab: dict[str, int]):
        """A byte-pair encoder over the same vocabulary, in which ids are merge ranks."""
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in printable}
        char |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(char[c] for c in token): i for token, i in vocab.items() if all(c in char for c in token) and token != "<|endoftext|>"}
        return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def _clear(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, keys: list[int], tokens: list[str]) -> None:
        one = self.ranks._core_bpe.encode_ordinary
        made = [one(t) for t in tokens]
        size = np.fromiter(map(len, made), np.int64, len(made))
        flat = np.fromiter(itertools.chain.from_iterable(made), np.int32, int(size.sum()))
        self.at = np.concatenate((self.at, len(self.ids) + np.cumsum(size) - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, flat))
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys)), strict=True))

    def encode(self, chunk: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and each row's offset."""
        text = chunk.buf.tobytes().decode("utf-8")
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        chars = np.concatenate(([0], np.cumsum((chunk.buf & 0xC0) != 0x80)))[chunk.offs]
        kind = self.kind.take(cp, mode="clip")
        odd_rows = np.unique(np.searchsorted(chars, np.flatnonzero(kind == _ODD), "right") - 1)
        start = self._starts(cp, kind, chars)
        begin = np.flatnonzero(start)
        if len(begin) == 0:
            return np.zeros(0, np.int32), np.zeros(chunk.rows + 1, np.int64)
        size = np.diff(np.append(begin, len(cp)))
        inner = np.arange(len(cp), dtype=np.int32)
        inner -= np.repeat(begin.astype(np.int32), size)
        inner &= 0xFFFF
        value = self.value.take(cp, mode="clip")
        value *= B.powers().take(inner)
        key = B.mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        codes, uniques = pd.factorize(key)
        if len(self.index) > CACHE_TOKENS:
            self._clear()
        uniques = uniques.tolist()
        known = np.array(list(map(self.index.get, uniques, itertools.repeat(-1))), np.int64)
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            first = np.empty(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            lows = begin[first[fresh]]
            highs = lows + size[first[fresh]]
            known[fresh] = len(self.index) + np.arange(len(fresh))
            self._add([uniques[u] for u in fresh.tolist()], [text[b:e] for b, e in zip(lows.tolist(), highs.tolist(), strict=True)])
        which = known[codes]
        count = self.size[which]
        ends = np.cumsum(count)
        place = np.repeat(self.at[which] - ends + count, count)
        place += np.arange(len(place))
        flat = self.ids.take(place)
        tokens = np.searchsorted(begin, chars)
        offs = np.concatenate(([0], ends))[tokens]
        if len(odd_rows):
            parts, sizes, odd = [], np.diff(offs), set(odd_rows.tolist())
            for r in range(chunk.rows):
                part = flat[offs[r] : offs[r + 1]]
                if r in odd:
                    part = np.array(self.whole.encode(chunk.text(r), add_special_tokens=False).ids, np.int32)
                    sizes[r] = len(part)
                parts.append(part)
            flat, offs = np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes)))
        return flat, offs

    @staticmethod
    def _starts(cp: np.ndarray, kind: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """True where a pre-token begins. A single space belongs to what follows it, a run of white space but for its
        last character is one token, and an English contraction after a letter or digit is one."""
        n = len(cp)
        start = np.zeros(n, bool)
        if n == 0:
            return start
        row = np.zeros(n + 1, bool)
        row[chars] = True
        before, space = np.empty(n, np.uint8), np.zeros(n, bool)
        before[0], before[1:] = _ODD, kind[:-1]
        space[1:] = cp[:-1] == 0x20
        blank = kind == _S
        start = np.where(blank, before != _S, np.where(before == _S, ~space, kind != before))
        follows = np.zeros(n, bool)
        follows[:-1] = ~blank[1:] & ~row[1:n]
        start |= blank & (before == _S) & follows
        start |= row[:n]
        quote = np.flatnonzero((cp == 0x27) & start)
        if len(quote):
            limit = chars[np.searchsorted(chars, quote, "right")]
            padded = np.concatenate((cp, np.zeros(3, np.uint32)))
            one, two = padded[quote + 1], padded[quote + 2]
            size = np.zeros(len(quote), np.int64)
            for c in "stmd":
                size[(one == ord(c)) & (quote + 1 < limit)] = 2
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b)) & (quote + 2 < limit)] = 3
            quote, size, limit = quote[size > 0], size[size > 0], limit[size > 0]
            start[quote + 1] = False
            three = quote[size == 3]
            start[three + 2] = False
            rest = (quote + size)[quote + size < limit]
            start[rest[kind[rest] != _S]] = True
        return start


def pieces_schema(id_type: str, with_ids: bool) -> str:
    return f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, spread long" + (", ids array<int>" if with_ids else "")


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: whole windows, then the remainder in at most two pieces, as smaller items
    level the windows. With ids, or with their checksum only. `spread` deals pieces to blocks, pieces of equal rows too."""
    path, half = vocabulary or default_vocabulary(), max(1, window // 2)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch, seen: list[int]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for chunk in B.chunks(batch.column(1)):
            flat, offs = encoder.encode(chunk)
            rows, start, length, crc, total, made = [], [], [], [], [], []
            for r in range(chunk.rows):
                ids = np.append(flat[offs[r] : offs[r + 1]], SEPARATOR).astype("<u4")
                whole = len(ids) // window * window
                for at in [*range(0, whole, window), *range(whole, len(ids), half)]:
                    piece = ids[at : at + (window if at < whole else half)]
                    rows.append(chunk.first + r)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    total.append(len(ids))
                    if with_ids:
                        made.append(piece.astype(np.int32))
            columns = [batch.column(0).take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(total, pa.int64())]
            spread = B.mix(np.array(crc, np.uint64) << np.uint64(32) | np.array(start, np.uint64) & np.uint64(0xFFFFFFFF)) + np.arange(seen[0], seen[0] + len(rows), dtype=np.uint64)
            seen[0] += len(rows)  # a task that is tried again reads its rows in the same order
            columns.append(pa.array(B.mix(spread).view(np.int64)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "spread"]
            if with_ids:
                columns.append(pa.array(made, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string")), run, pieces_schema(id_type, with_ids), state=lambda: [0], holds="encoder")


def difference(sizes: list[int], m: int) -> list[list[int]]:
    """Karmarkar-Karp: the indexes of sizes dealt to m parts with nearly equal sums.

    A partial partition is its non-empty parts in ascending order. The two with the largest
    spread between their largest and smallest sums are merged so that large sums of one meet
    small sums of the other; parts beyond m empty ones stay as they are."""
    if not sizes:
        return []
    members: list[list[int]] = [[i] for i in range(len(sizes))]
    heap: list = [(-s if m > 1 else 0, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        over = max(0, len(a) + len(b) - m)
        met = []
        for (x, p), (y, q) in zip(a[:over], reversed(b[:over]), strict=True):
            members[p] += members[q]
            met.append((x + y, p))
        a, b = a[over:], b[over:] + met
        if 8 * len(b) < len(a):
            for part in b:
                bisect.insort(a, part)
        else:
            a = sorted(a + b)
        low = a[0][0] if len(a) == m else 0
        heapq.heappush(heap, (low - a[-1][0], tick, a))
        tick += 1
    return [members[p] for _, p in heap[0][2]]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The least number of windows, from the bound of the sum on, at which differencing keeps to the capacity."""
    total = sum(sizes)
    m = max(1, -(-total // capacity))
    while True:
        parts = difference(sizes, m)
        worst = max((sum(sizes[i] for i in p) for p in parts), default=0)
        if worst <= capacity or m >= len(sizes):
            return parts
        m = min(len(sizes), m + max(1, m // 100))


def pack(pieces: DataFrame, blocks: int, *, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to the pieces of cut()."""
    bits = 24
    names = [c for c in pieces.columns if c != "spread"]
    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        number = int(pdf["_block"].iloc[0])
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        length = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        full = int((length >= window).sum())
        sequence[:full] = np.arange(full)
        for k, part in enumerate(windows_of(length[full:].tolist(), window)):
            at = 0
            for i in part:
                sequence[full + i], offset[full + i] = full + k, at
                at += int(length[full + i])
        pdf["sequence_id"] = (number << bits) + sequence
        pdf["offset"] = offset
        return pdf[[*names, "sequence_id", "offset"]]

    key = F.pmod(F.col("spread"), F.lit(blocks))
    return pieces.withColumn("_block", key).groupBy("_block").applyInPandas(block, schema)


def tokenize_and_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str | None = None, window: int = WINDOW, block_docs: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place in a sequence of at most `window` ids."""
    rows = docs.select(id_col).count()  # from the footers where docs is a table
    return pack(cut(docs, id_col, text_col, vocabulary=vocabulary, window=window, with_ids=with_ids), max(1, -(-rows // block_docs)), window=window)
