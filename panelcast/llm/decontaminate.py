"""Benchmark decontamination with suffix arrays of the training text.

Each slice of documents is a shard. Its suffix array holds the suffixes whose first words occur as such in some
benchmark window (all others cannot match one), sorted by their words. Every benchmark suffix is searched in it by
bisection, which gives the documents and places where its window occurs verbatim; matches on one diagonal are joined
to the longest match. Documents are never shuffled.

The benchmark is read in blocks of bounded size, and each block is matched against all documents.

Defined results: null or wordless texts have no words and no hits; a benchmark item without words has no window;
an item of fewer than `width` words is one window; items with one id count once; a null item id is written `null`;
input columns named like a result column are replaced. Repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm import text as tx

WIDTH = 10
BLOCK_BYTES = 8 << 20
FILTER_SLOTS = 1 << 20
MATCH = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int64()), ("word", pa.int64()), ("length", pa.int64())]))
MATCH_DDL = "array<struct<item: string, item_word: bigint, word: bigint, length: bigint>>"


class TestSuffixes:
    """The windows of a block of benchmark items, by length, as sorted keys of word ranks."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        column = pa.array([t for _, t in items], pa.large_string())
        hashes, first = tx.words(*tx.byte_buffer(column), tx.ALNUM)
        self.vocabulary = np.unique(hashes)
        ranks = np.searchsorted(self.vocabulary, hashes)
        owners: dict[int, dict[bytes, set[tuple[str, int]]]] = defaultdict(lambda: defaultdict(set))
        for k, (item, _) in enumerate(items):
            own = ranks[first[k] : first[k + 1]]
            size = min(width, len(own))
            for at in range(len(own) - size + 1 if size else 0):
                owners[size][self.pack(own[None, at : at + size])[0]].add((item, at))
        self.windows = {}
        for size, by_key in owners.items():
            keys = np.array(sorted(by_key), f"S{4 * size}")
            lead = min(3, size)
            heads = np.array([np.frombuffer(k, ">u4")[:lead] for k in sorted(by_key)], np.int64) - 1
            known = np.zeros(FILTER_SLOTS, bool)
            known[self.slot(self.vocabulary[heads].T, lead)] = True
            self.windows[size] = keys, [sorted(by_key[k]) for k in sorted(by_key)], lead, known

    @staticmethod
    def pack(ranks: np.ndarray) -> list[bytes]:
        """Rows of word ranks as byte strings that sort alike; ranks count from 1, so no key ends in a zero word."""
        rows = np.ascontiguousarray(ranks + 1, ">u4")
        return [row.tobytes() for row in rows]

    @staticmethod
    def slot(columns, lead: int) -> np.ndarray:
        out = columns[0]
        for k in range(1, lead):
            out = out * tx.BASE + columns[k]
        return (tx.mix(out) >> np.uint64(44)).astype(np.int64)

    def search(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, list]]:
        """For each window length: places of matching suffixes, the test suffix each one matches, and the items."""
        out = []
        row_end = np.repeat(first[1:], np.diff(first))
        for size, (keys, items, lead, known) in self.windows.items():
            room = len(hashes) - size + 1
            if room <= 0:
                continue
            heads = self.slot([hashes[k : k + room] for k in range(lead)], lead)
            places = np.flatnonzero(known[heads] & (np.arange(room) + size <= row_end[:room]))
            if not len(places):
                continue
            window = hashes[places[:, None] + np.arange(size)]
            ranks = np.minimum(np.searchsorted(self.vocabulary, window), len(self.vocabulary) - 1)
            whole = (self.vocabulary[ranks] == window).all(axis=1)
            places, ranks = places[whole], ranks[whole]
            if not len(places):
                continue
            suffixes = np.ascontiguousarray(ranks + 1, ">u4").view(f"S{4 * size}").ravel()
            order = np.argsort(suffixes, kind="stable")  # the shard's suffix array
            suffixes, places = suffixes[order], places[order]
            low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            found = np.flatnonzero(high > low)
            if len(found):
                counts = (high - low)[found]
                at = np.repeat(low[found] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                out.append((size, places[at], np.repeat(found, counts), items))
        return out


def _longest(found: dict[tuple[str, int], set[tuple[int, int]]]) -> list[dict]:
    """Maximal verbatim matches from the windows on each diagonal (item, document word - item word)."""
    out = []
    for (item, shift), spans in sorted(found.items()):
        run: list[int] = []
        for low, high in sorted(spans):
            if run and low <= run[1]:
                run[1] = max(run[1], high)
                continue
            if run:
                out.append((item, shift, *run))
            run = [low, high]
        out.append((item, shift, *run))
    return [{"item": i, "item_word": low - s, "word": low, "length": high - low} for i, s, low, high in out]


def _hit_words(matches: list[dict]) -> int:
    total, reached = 0, 0
    for m in sorted(matches, key=lambda m: m["word"]):
        end = m["word"] + m["length"]
        total += max(0, end - max(reached, m["word"]))
        reached = max(reached, end)
    return total


def _scan(tests: TestSuffixes, first_block: bool, keep: list[str], text: str):
    """Adds the matches of one block of items to each row."""

    @tx.tidy
    def run(batches):
        for part in tx.slices(batches, text):
            hashes, first = tx.words(*tx.byte_buffer(part.column(text)), tx.ALNUM)
            found: dict[int, dict] = defaultdict(lambda: defaultdict(set))
            for size, places, which, owners in tests.search(hashes, first):
                row = np.searchsorted(first, places, "right") - 1
                for r, p, k in zip(row.tolist(), (places - first[row]).tolist(), which.tolist()):
                    for item, at in owners[k]:
                        found[r][item, p - at].add((p, p + size))
            matches = [[] for _ in range(part.num_rows)] if first_block else part.column("matches").to_pylist()
            for r, spans in found.items():
                matches[r] = matches[r] + _longest(spans)
            columns = {name: part.column(name) for name in keep}
            columns["n_words"] = pa.array(np.diff(first), pa.int64())
            columns["n_hit"] = pa.array([_hit_words(m) for m in matches], pa.int64())
            columns["items"] = pa.array([sorted({x["item"] for x in m}) for m in matches], pa.list_(pa.string()))
            columns["matches"] = pa.array(matches, MATCH)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return run


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                 item_text: str = "text", width: int = WIDTH, keep: list[str] | None = None,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns `keep` (all) of every document with its words, hit words, matched items and the longest
    verbatim matches (item, place in the item, place in the document, words)."""
    added = {"n_words", "n_hit", "n_items", "items", "matches", "contaminated"}
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    tests = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"),
                             F.coalesce(F.col(item_text), F.lit("")).alias("words"))
    total = tests.agg(F.sum(F.octet_length("words") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = docs
    carried = list(dict.fromkeys([*keep, text]))
    plain = {f.name: f for f in docs.schema.fields}
    for k in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == k).collect()
        index = TestSuffixes([(r["item"], r["words"]) for r in rows], width)
        wanted = keep if k == blocks - 1 else carried
        schema = T.StructType([*(plain[c] for c in wanted), *T._parse_datatype_string(
            f"n_words bigint, n_hit bigint, items array<string>, matches {MATCH_DDL}").fields])
        state = [] if k == 0 else ["matches"]
        out = out.select(*carried, *state).mapInArrow(_scan(index, k == 0, wanted, text), schema)
    return out.select(*keep, "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "matches",
                      (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit word, with their own columns."""
    plain = [f"c{k}" for k in range(len(docs.columns))]  # clashes with no result column
    names = dict(zip(docs.columns, plain))
    marked = find_matches(docs.toDF(*plain), benchmark, names[options.pop("text", "text")], keep=plain, **options)
    return marked.where(~F.col("contaminated")).select(*(F.col(c).alias(name) for name, c in names.items()))
