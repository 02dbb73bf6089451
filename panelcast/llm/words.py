"""Words of Arrow text columns as numbers: one pass over the bytes, strings compared exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership table of bytes, by inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First bytes and ends of the runs of `inside`, cut at row `offsets`, and the first word of each row (and the total)."""
    size = len(inside)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    start[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def encode(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The words' places in a list of the different words, and that list."""
    cuts = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cuts[1:])
    column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data[inside])))
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def hash_words(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
