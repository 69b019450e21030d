"""Vectorised word handling over Arrow string buffers.

A batch of texts is one UTF-8 byte buffer with row offsets, so words, hashes and lines
of a whole batch come from a few numpy passes, with no Python work per word.
Batches are walked in chunks of bounded size: memory does not depend on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_POWER_BITS = 16
_powers: np.ndarray | None = None

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LENGTH, _NEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers() -> np.ndarray:
    global _powers
    if _powers is None:
        p = np.full(1 << _POWER_BITS, _BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def byte_table(pattern_bytes: bytes | range | list[int]) -> np.ndarray:
    """Boolean table of 256 with the given bytes True."""
    t = np.zeros(256, dtype=bool)
    t[list(pattern_bytes)] = True
    return t


#: White space as in `[\x20\x09-\x0D]`; everything else belongs to a word.
NON_SPACE = ~byte_table([0x20, *range(0x09, 0x0E)])
#: Letters a-z, digits and everything outside ASCII belong to a word.
WORDLIKE = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: The same with capital letters.
WORDLIKE_ANY_CASE = WORDLIKE | byte_table(range(0x41, 0x5B))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Chunk:
    """Rows first..last of a batch: their bytes and the offset of each row in them."""

    first: int
    last: int
    buf: np.ndarray
    offs: np.ndarray

    def text(self, row: int) -> str:
        return self.buf[self.offs[row] : self.offs[row + 1]].tobytes().decode("utf-8", "replace")

    @property
    def rows(self) -> int:
        return self.last - self.first


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        if not pa.types.is_string(column.type):
            column = column.cast(pa.string())
        kind = np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of about size bytes; a longer text is a chunk of its own."""
    buf, offs = string_buffers(column)
    n, at = len(offs) - 1, 0
    while at < n:
        end = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
        end = min(max(end, at + 1), n)
        yield Chunk(at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at])
        at = end


@dataclass
class Words:
    """Words of a chunk in order: byte spans, 64-bit hashes, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray | None

    def __len__(self) -> int:
        return len(self.start)


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross a row's border."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turn = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    border = offs[1:-1]
    border = border[(border > 0) & (border < n)]
    border = np.unique(border[inside[border] & inside[border - 1]])  # a run ends here and another begins
    if len(border):
        turn = np.insert(turn, np.repeat(np.searchsorted(turn, border), 2), np.repeat(border, 2))
    if inside[0]:
        turn = np.concatenate(([0], turn))
    if inside[-1]:
        turn = np.append(turn, n)
    return turn[0::2], turn[1::2]


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the byte spans, eight bytes at a time."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = end - start
    value = eight[start] & _MASK[np.minimum(size, 8)]
    total = mix(value ^ (size.astype(np.uint64) * _LENGTH))
    long = np.flatnonzero(size > 8)
    done = 8
    while len(long):
        value = eight[start[long] + done] & _MASK[np.minimum(size[long] - done, 8)]
        total[long] = mix(total[long] * _NEXT + value)
        done += 8
        long = long[size[long] > done]
    return total


def words(chunk: Chunk, table: np.ndarray, *, lower: bool = False, hashed: bool = True) -> Words:
    buf = LOWER[chunk.buf] if lower else chunk.buf
    start, end = spans(table[buf], chunk.offs)
    first = np.searchsorted(start, chunk.offs)
    row = np.repeat(np.arange(chunk.rows), np.diff(first))
    return Words(start, end, row, first, hash_spans(buf, start, end) if hashed else None)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each run of `size` words of one row; a shorter row that has words gives one run of all its words."""
    n = len(w)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    counts = np.diff(w.first)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate((w.hash, np.zeros(size, np.uint64)))
    left = np.repeat(w.first[1:], counts) - np.arange(n)
    for k in range(size):
        part = mix(padded[k : k + n] + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
        if k:
            part[left <= k] = 0
        total += part
    keep = (left >= size) | ((np.repeat(counts, counts) < size) & (left == np.repeat(counts, counts)))
    return mix(total[keep]), w.row[keep]


class HashIndex:
    """64-bit keys to small numbers; -1 for other keys. Vectorised, open addressing by sorting."""

    def __init__(self, keys: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], order.astype(np.int32)
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 16))))
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def get(self, wanted: np.ndarray) -> np.ndarray:
        out = np.full(len(wanted), -1, np.int32)
        if len(self.keys) == 0 or len(wanted) == 0:
            return out
        maybe = np.flatnonzero(self.seen[(wanted >> self.shift).astype(np.int64)])
        asked = wanted[maybe]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        hit = self.keys[at] == asked
        out[maybe[hit]] = self.values[at[hit]]
        return out
