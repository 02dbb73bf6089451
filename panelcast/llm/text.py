"""Numpy kernels over the UTF-8 bytes of Arrow string columns: slices of bounded size, words, prefix hashes.

A prefix hash is a polynomial over the bytes modulo 2**64 with an odd base, so the hash of any stretch is a
difference of two running sums, whatever its length. Hashes are 64 bits; results that rest on them can be wrong
only if two different strings collide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(71).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SLICE_BYTES = 2 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit hash over all others."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@lru_cache(2)
def _powers(length: int, base: int) -> np.ndarray:
    out = np.full(length, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses, for at least `length` places."""
    room = 1 << max(16, int(length).bit_length())
    return _powers(room, int(BASE)), _powers(room, int(INVERSE))


def tidy(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel, giving back the memory of its slices when its task ends.

    Spark keeps a Python worker for later tasks, so what the allocators hold on to would add up over the stages of a job.
    """

    @wraps(kernel)
    def run(batches):
        try:
            yield from kernel(batches)
        finally:
            _powers.cache_clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim is not None:
                trim(0)
    return run


class Prefix:
    """Running hash of `values`, one 64-bit value per byte."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches [start, end)."""
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about `limit` bytes of text; one row may be longer."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = byte_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def own_text(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches of struct `row` with the field `text` of it as a column `text`, so that no second copy is sent."""
    for batch in batches:
        row = batch.column("row")
        others = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in others), row.field(text)], names=[*others, "text"])


def alphabet(word_bytes: np.ndarray) -> np.ndarray:
    """Hash value of each byte, A-Z as a-z, 0 for bytes that are not in words."""
    fold = np.arange(256)
    fold[65:91] += 32
    return np.where(word_bytes[fold] | word_bytes, BYTE_VALUES[fold], np.uint64(0))


def _outside(*ranges: tuple[int, int]) -> np.ndarray:
    word = np.ones(256, bool)
    for low, high in ranges:
        word[low : high + 1] = False
    return word


#: Words between ASCII white space, and words of letters and digits (bytes from 0x80 count as letters).
SPACED = alphabet(_outside((0x09, 0x0D), (0x20, 0x20)))
ALNUM = alphabet(_outside((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)))


def words(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, in order, and the first word's index of each row (and the total)."""
    got = values[data]
    inside = got != 0
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    start[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return Prefix(got).spans(starts, ends), np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` consecutive words from each word on; rows are not regarded."""
    room = max(0, len(hashes) - size + 1)
    out = np.zeros(room, np.uint64)
    for k in range(size):
        out = out * BASE + hashes[k : k + room]
    return mix(out)
