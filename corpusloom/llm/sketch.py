"""Counts over a fixed number of hash buckets, gathered from all rows in bounded memory.

Each task counts into one array and hands on its non-zero slices, compressed; slices meet by their
number and are added up as they stream in. What reaches the driver is one array of fixed size."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release

SLICE_BITS = 16
#: Slices that a task adds up; 512 KB each.
TASK_SLICES = 4


def bucket_counts(df: DataFrame, buckets: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Sum over all rows of how often each bucket number occurs; `buckets` gives the bucket numbers of a batch."""
    width = 1 << min(bits, SLICE_BITS)
    slices = (1 << bits) // width

    def pack(index: int, values: np.ndarray) -> tuple[int, bytes]:
        return index, zlib.compress(values.astype(np.min_scalar_type(values.max())).tobytes(), 1)  # sums may pass 32 bits, most counts fit 8 or 16

    def unpack(data: bytes) -> np.ndarray:
        raw = zlib.decompress(data)
        return np.frombuffer(raw, f"u{len(raw) // width}").astype(np.int64)

    def out(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["slice", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int32)
        held: list[np.ndarray] = []

        def flush() -> None:
            if held:
                np.add(total, np.bincount(np.concatenate(held), minlength=1 << bits), out=total, casting="unsafe")
                held.clear()

        for batch in batches:
            for numbers in buckets(batch):
                held.append(numbers)
                if sum(map(len, held)) > 1 << 20:
                    flush()
            release()
        flush()
        parts = [pack(i, total[i * width : (i + 1) * width]) for i in range(slices) if total[i * width : (i + 1) * width].any()]
        del total
        release()
        if parts:
            yield out(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i in sums:
                    sums[i] += unpack(data)
                else:
                    sums[i] = unpack(data)
        if sums:
            yield out([pack(i, v) for i, v in sums.items()])

    schema = "slice int, data binary"
    total = np.zeros(1 << bits, np.int64)
    for row in df.mapInArrow(count, schema).repartition(-(-slices // TASK_SLICES), "slice").mapInArrow(add, schema).collect():  # one row a slice
        total[row["slice"] * width : (row["slice"] + 1) * width] = unpack(row["data"])
    return total


class Marks:
    """A set of 64-bit hashes as one bit each; other hashes may share a bit."""

    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.bits = data, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def marks(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], most_bits: int = 27) -> Marks:
    """The hashes of all rows as a table of at least 2 MB and 16 bits a row, up to 2^most_bits bits (16 MB); beyond that it lets more through and loses none."""
    bits = int(min(most_bits, max(24, np.ceil(np.log2(16.0 * max(1, df.count()))))))
    size = 1 << (bits - 3)
    width = min(size, 1 << SLICE_BITS)

    def out(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["slice", "data"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint8)
        for batch in batches:
            for hashes in keys(batch):
                at = hashes >> np.uint64(64 - bits)
                np.bitwise_or.at(total, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        parts = {i: total[i * width : (i + 1) * width] for i in range(size // width) if total[i * width : (i + 1) * width].any()}
        if parts:
            yield out(parts)
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(data), np.uint8)
                parts[i] = parts[i] | got if i in parts else got
        if parts:
            yield out(parts)

    schema = "slice int, data binary"
    total = np.zeros(size, np.uint8)
    for row in df.mapInArrow(mark, schema).repartition(max(1, size // width), "slice").mapInArrow(merge, schema).collect():  # one row a slice
        total[row["slice"] * width : (row["slice"] + 1) * width] = np.frombuffer(zlib.decompress(row["data"]), np.uint8)
    return Marks(total, bits)
