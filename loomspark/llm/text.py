"""Vectorised text helpers shared by the operators: byte blocks, words, window fingerprints.

Everything works on a *block*: the UTF-8 bytes of several whole documents laid end to end, with
the end offset of each.  A block is a few MB, so the numpy temporaries of a Python worker stay small
whatever the table holds; a single longer document makes a longer block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

BLOCK_BYTES = 4 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_S = np.uint64(32)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """An order-sensitive 64-bit hash of two 64-bit values, element by element."""
    x = a * _C1
    x ^= x >> _S
    x += b
    x *= _C2
    x ^= x >> _S
    x *= _C3
    return x


def bounded(df: DataFrame) -> DataFrame:
    """The same rows, sent to Python in batches whose bytes are bounded too: ten thousand long texts would be a batch of gigabytes."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) or 10_000, BATCH_ROWS)))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that hands its freed memory back when it ends; Python workers idle between tasks and would keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end and each value's length; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, np.diff(ends)


def slices(batch: pa.RecordBatch, text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `most` bytes of text each; every row stays whole."""
    _, lens = text_bytes(batch.column(text))
    start, total = 0, 0
    for i, n in enumerate(lens.tolist()):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 16
    if start < batch.num_rows:
        yield batch.slice(start)


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a block of documents."""

    def __init__(self, data: np.ndarray, lens: np.ndarray):
        self.data, self.n_docs = data, len(lens)
        self.doc_end = np.cumsum(lens)
        firsts = (self.doc_end - lens)[lens > 0]
        self.solid = ~SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = self.solid[:-1]
        before[firsts] = False
        self.start = np.flatnonzero(self.solid & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = self.solid[1:]
        after[firsts[firsts > 0] - 1] = False
        self.end = np.flatnonzero(self.solid & ~after) + 1
        self.doc = np.searchsorted(self.doc_end, self.start, "right")
        self.count = np.bincount(self.doc, minlength=self.n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def array(self) -> pa.Array:
        """All words as one binary array."""
        offsets = np.concatenate([[0], np.cumsum(self.end - self.start)])
        wide = offsets[-1] >= 2**31
        return pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(self.start), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(self.data[self.solid])])

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """Each word's place in the list of distinct words, and that list."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        codes, distinct = self.codes()
        each = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
        return each[codes] if len(codes) else np.zeros(0, np.uint64)

    def tabulated(self, family: int) -> np.ndarray:
        """A 64-bit hash of every word, of one of two independent families: the sum of a random number for each byte at its place.

        Longer words than TABULATED bytes are hashed one by one.
        """
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        first = np.cumsum(size) - size  # of each word among the bytes of words
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        long = np.flatnonzero(size > TABULATED)
        if len(long):
            place = np.minimum(place, TABULATED - 1)
        place <<= 8
        place += self.data[self.solid]
        out = np.add.reduceat(_PLACES[family][place], first)
        if len(long):
            raw = self.data.tobytes()
            for i in long.tolist():
                out[i] = xxhash.xxh3_64_intdigest(raw[self.start[i] : self.end[i]], family)
        return out


def span_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of `length` items, built by doubling; entry i covers items i to i+length-1."""
    if len(h) < length:
        return np.zeros(0, np.uint64)
    step = 1
    while step * 2 <= length:
        h = mix(h[:-step], h[step:])
        step *= 2
    return mix(h[: len(h) - (length - step)], h[length - step :]) if step < length else h


#: Bytes of a word that have numbers of their own, and of both families a number for each place and byte.
TABULATED = 64
_PLACES = [mix(mix(np.arange(TABULATED << 8, dtype=np.uint64), np.uint64(family + 11)), _C3) for family in (0, 1)]
#: Of each family of hashes, the hash of every byte.
_BYTES = [np.fromiter((xxhash.xxh3_64_intdigest(bytes([i]), family) for i in range(256)), np.uint64, 256) for family in (0, 1)]


def byte_span_hashes(data: np.ndarray, length: int, wanted: np.ndarray, chunk: int = 1 << 15, family: int = 0) -> np.ndarray:
    """Hashes of the `length`-byte strings that start at the `wanted` (ascending) offsets; those of two families are independent.

    Works through pieces that fit in the processor's cache; pieces without a wanted offset are skipped.
    """
    out = np.empty(len(wanted), np.uint64)
    last = max(0, len(data) - length + 1)
    cuts = np.searchsorted(wanted, np.arange(0, last + chunk, chunk))
    for k in range(len(cuts) - 1):
        a, b = cuts[k], cuts[k + 1]
        if a < b:
            s = k * chunk
            h = span_hashes(_BYTES[family][data[s : s + chunk + length - 1]], length)
            out[a:b] = h[wanted[a:b] - s]
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Which of `size` places lie within `length` places from one of the starts."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, size), -1)
    return np.cumsum(step[:-1]) > 0
