"""Periodic runs of words, found by block convolution at dyadic scales.

Words are numbers. At scale B every aligned block of B words is searched in the window that follows: the sums of squared
differences at all distances come from one correlation, computed exactly by a number-theoretic transform modulo a prime,
and a sum of zero is an occurrence without mismatch. A run of period q and at least 3 q words holds an aligned block and its
copy q words on, for the scale with B <= q < 2 B (periods under 16 are found with blocks of 8 words, for runs have 24 words or
more). Neighbouring blocks that occur again at one distance form a seed, which is extended to both sides by less than a block.

A sum that is a multiple of the prime by chance is refuted when the seed is compared. Comparisons use prefix hashes modulo
two primes, and every run found is compared word by word in the end, so the result is exact. Work grows with n log n, also
in texts of one word. Transforms are matrix products of exact integers in doubles: 512 products of numbers up to half
the prime stay under 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import text as tx
from panelcast.llm import words as wd
from panelcast.llm.tables import text_or_empty

LEAST_WORDS = 24
LEAST_PERIODS = 3
FIRST_BLOCK = 8
#: Prime 7 * 2**20 + 1 with the primitive root 3: transforms of up to 2**20 places.
PRIME = 7 * 2**20 + 1
ROOT = 3
DIRECT = 64
#: Longer blocks are searched by their first words only; what is found is extended all the same.
LONGEST_PATTERN = 1 << 17
CELLS = 1 << 18
SLICE_BYTES = 2 << 20
SPACED = wd.byte_set((0x09, 0x0D), (0x20, 0x20))
HASHES = ((2**31 - 1, 1_342_177_283), (2**31 - 19, 947_483_647))  # primes and bases
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def reduced(x: np.ndarray) -> np.ndarray:
    """Residues nearest to zero, in place."""
    x -= np.rint(x * (1 / PRIME)) * PRIME
    return x


@lru_cache(64)
def _roots(size: int, sign: int) -> np.ndarray:
    root = pow(ROOT, sign * (PRIME - 1) // size, PRIME)
    out = np.ones(size, np.int64)
    have = 1
    while have < size:
        out[have : 2 * have] = out[:have] * pow(root, have, PRIME) % PRIME
        have *= 2
    return out


@lru_cache(64)
def _matrix(rows: int, columns: int, size: int, sign: int) -> np.ndarray:
    """root(size) ** (sign * row * column), nearest to zero."""
    exponent = np.outer(np.arange(rows), np.arange(columns)) % size
    return reduced(_roots(size, sign)[exponent].astype(np.float64))


def _split(size: int) -> tuple[int, int]:
    a = 1 << (size.bit_length() // 2)
    return a, size // a


def transform(x: np.ndarray, sign: int) -> np.ndarray:
    """Each row's transform, in an order of its own that `back` undoes."""
    rows, size = x.shape
    if size <= DIRECT:
        return reduced(x @ _matrix(size, size, size, sign))
    a, b = _split(size)
    x = reduced(np.matmul(_matrix(a, a, a, sign), x.reshape(rows, a, b)))
    x *= _matrix(a, b, size, sign)
    return reduced(reduced(x).reshape(rows * a, b) @ _matrix(b, b, b, sign)).reshape(rows, size)


def back(x: np.ndarray) -> np.ndarray:
    rows, size = x.shape
    scale = float(pow(size, -1, PRIME))
    if size <= DIRECT:
        return reduced(reduced(x @ _matrix(size, size, size, -1)) * scale)
    a, b = _split(size)
    x = reduced(x.reshape(rows * a, b) @ _matrix(b, b, b, -1)).reshape(rows, a, b)
    x *= _matrix(a, b, size, -1)
    return reduced(reduced(np.matmul(_matrix(a, a, a, -1), reduced(x))) * scale).reshape(rows, size)


def zero_mismatches(values: np.ndarray, squares: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int, shifts: int):
    """(block, shift) where `length` values from a block's start may equal those from its window's start + shift.

    `values` are residues nearest to zero, `squares` the running sums of their squares' residues; `shifts` is at most the
    room that a transform leaves after a pattern.
    """
    size = 1 << (length + shifts - 2).bit_length()
    place = np.arange(size)
    for low in range(0, len(starts), max(1, CELLS // size)):
        block, window = (x[low : low + max(1, CELLS // size), None] for x in (starts, windows))
        pattern = np.zeros((len(block), size))
        pattern[:, :length] = values[block + place[:length]]
        product = transform(pattern, -1)
        product *= transform(values[window + place], 1)
        cross = back(reduced(product))[:, :shifts]
        at = window + place[:shifts]
        sums = (squares[block + length] - squares[block]) + (squares[at + length] - squares[at]) - 2 * cross
        block_of, shift = np.nonzero(reduced(sums) == 0)
        yield low + block_of, shift


class Equal:
    """Comparison of stretches of a sequence, by prefix hashes."""

    def __init__(self, sequence: np.ndarray):
        mixed = tx.mix(sequence.astype(np.uint64) + np.uint64(1))
        self.parts = []
        for prime, base in HASHES:
            power = _powers(1 << int(len(sequence)).bit_length(), prime, base)
            sums = np.zeros(len(sequence) + 1, np.int64)
            np.cumsum((mixed % np.uint64(prime)).astype(np.int64) * power[: len(sequence)] % prime, out=sums[1:])
            self.parts.append((prime, power, sums))

    def __call__(self, at: np.ndarray, distance: np.ndarray, length: np.ndarray) -> np.ndarray:
        same = np.ones(len(at), bool)
        for prime, power, sums in self.parts:
            here = (sums[at + length] - sums[at]) % prime
            there = (sums[at + distance + length] - sums[at + distance]) % prime
            same &= here * power[distance] % prime == there
        return same


@lru_cache(4)
def _powers(size: int, prime: int, base: int) -> np.ndarray:
    out = np.ones(size, np.int64)
    have = 1
    while have < size:
        out[have : 2 * have] = out[:have] * pow(base, have, prime) % prime
        have *= 2
    return out


def _reach(equal: Equal, at: np.ndarray, distance: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many words from `at` on (step 1) or before it (-1) equal those `distance` further, up to `room`."""
    low, high = np.zeros(len(at), np.int64), np.maximum(room, 0)
    for _ in range(int(high.max(initial=0)).bit_length()):
        middle = (low + high + 1) // 2
        same = equal(at if step > 0 else at - middle, distance, middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def _stretch(sequence: np.ndarray, begin: int, end: int, distance: int, seed: int) -> tuple[int, int]:
    """The stretch around `seed` whose words equal those `distance` further, word by word; empty if `seed` differs."""
    differs = np.flatnonzero(sequence[begin : end - distance] != sequence[begin + distance : end]) + begin
    k = np.searchsorted(differs, seed)
    if k < len(differs) and differs[k] == seed:
        return seed, seed
    return (int(differs[k - 1]) + 1 if k else begin), (int(differs[k]) if k < len(differs) else end - distance)


def runs_of(sequence: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs in the stretches [begin, end) of `sequence`, by start, then period.

    A stretch is followed by a number found nowhere else, so that no run passes its end.
    """
    sizes = ends - begins
    longest = int(sizes.max(initial=0))
    if longest < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    top = 1 << (longest // LEAST_PERIODS).bit_length()
    values = np.zeros(len(sequence) + 4 * max(top, FIRST_BLOCK), np.float64)
    values[: len(sequence)] = sequence % PRIME
    squares = np.zeros(len(values) + 1, np.int64)
    np.cumsum((values.astype(np.int64) ** 2) % PRIME, out=squares[1:])
    reduced(values)
    equal = None
    found = []
    block = FIRST_BLOCK
    while LEAST_PERIODS * block <= longest:
        least, shifts = (1, 2 * block - 1) if block == FIRST_BLOCK else (block, block)
        starts = np.arange(0, len(sequence) - block + 1, block)
        row = np.searchsorted(begins, starts, "right") - 1
        ok = (row >= 0) & (starts + block + least <= ends[row]) & (sizes[row] >= max(LEAST_WORDS, LEAST_PERIODS * block))
        starts, row = starts[ok], row[ok]
        length = min(block, LONGEST_PATTERN)
        part = shifts if block <= LONGEST_PATTERN else length
        seeds = [(starts[at], least + offset + shift, row[at]) for offset in range(0, shifts, part)
                 for at, shift in zero_mismatches(values, squares, starts, starts + least + offset, length, part)]
        at, distance, row = (np.concatenate(x) for x in zip(*seeds)) if seeds else (np.zeros(0, np.int64),) * 3
        fits = at + block + distance <= ends[row]
        at, distance, row = at[fits], distance[fits], row[fits]
        if len(at):
            equal = equal or Equal(sequence)
            same = equal(at, distance, np.full(len(at), block))
            at, distance, row = at[same], distance[same], row[same]
        if len(at):
            order = np.lexsort((at, distance))
            at, distance, row = at[order], distance[order], row[order]
            new = np.append(True, (np.diff(distance) != 0) | (np.diff(at) != block) | (np.diff(row) != 0))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            low, high, distance, row = at[first], at[last] + block, distance[first], row[first]
            low = low - _reach(equal, low, distance, np.minimum(block, low - begins[row]), -1)
            high = high + _reach(equal, high, distance, np.minimum(block, ends[row] - distance - high), 1)
            total = high - low + distance
            long = total >= np.maximum(LEAST_WORDS, LEAST_PERIODS * distance)
            found.append(np.stack([low, total, distance, row, at[first]], 1)[long])
        block *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 5), np.int64)
    once = _once(runs)
    if not all(_exact(sequence, begins[r[3]], ends[r[3]], r) for r in once):  # two stretches with one hash
        for r in runs:
            if not _exact(sequence, begins[r[3]], ends[r[3]], r):
                low, high = _stretch(sequence, begins[r[3]], ends[r[3]], r[2], r[4])
                r[:2] = low, high - low + r[2]
        once = _once(runs[runs[:, 1] >= np.maximum(LEAST_WORDS, LEAST_PERIODS * runs[:, 2])])
    return once[np.lexsort((once[:, 2], once[:, 0]))][:, :3]


def _once(runs: np.ndarray) -> np.ndarray:
    """A stretch found with several periods has the smallest; the others are its multiples."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.append(True, (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0))[: len(runs)]]


def _exact(sequence: np.ndarray, begin: int, end: int, run: np.ndarray) -> bool:
    """Whether the run's words repeat and its neighbours do not, word by word."""
    low, high, period = run[0], run[0] + run[1], run[2]
    return (np.array_equal(sequence[low : high - period], sequence[low + period : high])
            and (low == begin or sequence[low - 1] != sequence[low - 1 + period])
            and (high == end or sequence[high] != sequence[high - period]))


def _joined(data: np.ndarray, inside: np.ndarray, sizes: np.ndarray, row: np.ndarray, keep: np.ndarray, rows: int) -> pa.Array:
    """The kept words of each row, one space between them."""
    content = data[inside][np.repeat(keep, sizes)]
    sizes, row = sizes[keep], row[keep]
    gap = np.append(False, row[1:] == row[:-1])[: len(row)]
    out = np.full(len(content) + int(gap.sum()), 0x20, np.uint8)
    out[np.arange(len(content)) + np.repeat(np.cumsum(gap), sizes)] = content
    ends = np.zeros(rows + 1, np.int64)
    ends[1:] = np.cumsum(np.bincount(row, sizes + gap, rows)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(rows, pa.py_buffer(ends), pa.py_buffer(out)).cast(pa.string())


@tx.tidy
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches, "text", SLICE_BYTES):
        data, offsets = tx.byte_buffer(batch.column("text"))
        rows = batch.num_rows
        inside = ~SPACED[data]
        starts, ends, first = wd.word_spans(inside, offsets)
        counts = np.diff(first)
        row = np.repeat(np.arange(rows), counts)
        words, different = wd.encode(data, inside, starts, ends) if len(starts) else (np.zeros(0, np.int64), [])
        sequence = np.empty(len(words) + rows, np.int64)
        begins = first[:-1] + np.arange(rows)
        sequence[np.arange(len(words)) + row] = words
        sequence[begins + counts] = len(different) + np.arange(rows)
        runs = runs_of(sequence, begins, begins + counts)
        of = np.searchsorted(begins, runs[:, 0], "right") - 1
        runs = runs - np.stack([of, of * 0, of * 0], 1)  # starts count words of the slice now
        drops = np.zeros(len(words) + 1, np.int64)
        np.add.at(drops, runs[:, 0] + runs[:, 2], 1)
        np.add.at(drops, runs[:, 0] + runs[:, 1], -1)
        keep = np.cumsum(drops)[:-1] == 0
        lists = pa.StructArray.from_arrays([pa.array(x) for x in (runs[:, 0] - first[of], runs[:, 1], runs[:, 2])], fields=list(RUN))
        cuts = pa.array(np.searchsorted(of, np.arange(rows + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(cuts, lists),
             _joined(data, inside, ends - starts, row, keep, rows)], names=["row", "n_words", "runs", "kept_text"])


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds the runs of repeated words of each text; returns `row` (the columns `keep`, all if None) and three columns.

    A run is a stretch of 24 words or more, and of three periods or more, whose words repeat with a smallest period and that
    cannot be made longer. `runs` lists (start, length, period) in words, by start, then period; `n_words` counts words between
    white space; `kept_text` has the words that are in no run after its first period, joined by one space.

    A null or empty text has no words, no runs and an empty `kept_text`. Texts of any length are read whole; one that is longer
    than a slice is a slice of its own. Rows are handled one by one, so repeated rows give repeated results. Columns may have
    any names, as they are kept in the struct. An empty table gives an empty one.
    """
    names = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), text_or_empty(text).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_find, f"row {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, "
                                  "kept_text string")
