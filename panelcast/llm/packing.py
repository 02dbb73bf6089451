"""Best-fit packing of tokenized documents into sequences of a fixed length.

Texts are tokenized where they are read; only one small row per piece goes on. Pieces are dealt evenly over as many
partitions as their number needs. Each partition packs its items by best fit, largest first, and gives out the bins
that are nearly full. Underfull bins go on as items to fewer partitions, in rounds, until one partition holds all or a
round no longer gains anything. A partition holds a bounded number of items, whatever the input.

Where white space ends every token, a text's ids are those of its words between white space: each different word of a
slice is encoded once, and a bounded cache keeps it for the next slices. Such properties are tried on the tokenizer; texts go
to one that lacks them as a whole.
"""

from __future__ import annotations

import os
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import text as tx
from panelcast.llm import words as wd
from panelcast.llm.tables import stored

CAPACITY = 2048
SLACK = 16
ITEMS = 40_000
CACHED_WORDS = 800_000
SLICE_BYTES = 3 << 20
MARKS = ".,;:!?"
TOGETHER = 1000
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@dataclass(frozen=True)
class Traits:
    """What a tokenizer's words may be taken apart by; each is tried on the tokenizer itself."""

    spaced: bool  # white space ends every token and has none of its own
    lower: bool  # ASCII letters have the ids of their lower case
    apart: frozenset  # punctuation marks that are encoded apart from the letters before them
    last: np.ndarray | None  # by id: whether the token ends a word


@lru_cache(1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def ids(text):
        return tokenizer.encode(text, add_special_tokens=False).ids

    probes = ["word", "Other", "of", "xyzzy", "é"]
    spaced = all(ids(f" {a}\n\t{b} ") == ids(a) + ids(b) for a in probes for b in probes)
    lower = all(ids(a) == ids(b) for a, b in (("WORD", "word"), ("OF", "of"), ("XYZZY", "xyzzy"), ("éTUDE", "étude"), ("A\u0301B", "a\u0301b")))
    apart = frozenset(m for m in MARKS if all(ids(w + m) == ids(w) + ids(m) for w in probes))
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    last = None
    if suffix and spaced:
        vocabulary = tokenizer.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
    return tokenizer, {}, Traits(spaced, lower, apart, last)


def _parts(word: str, traits: Traits) -> tuple[str, ...]:
    """Pieces that the tokenizer always encodes apart: letters, and a punctuation mark after them."""
    return (word[:-1], word[-1]) if word[-1:] in traits.apart and word[:-1].isalpha() else (word,)


def _encode(words: list[str], tokenizer, last: np.ndarray | None) -> list[bytes]:
    """The ids of each word. Words of letters go together where tokens show the ends of words: a call has its price."""
    together = [w for w in words if w.isalpha()] if last is not None else []
    found: dict[str, bytes] = {}
    for at in range(0, len(together), TOGETHER):
        part = together[at : at + TOGETHER]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) == len(part):  # each word has one end; a word with an end inside is encoded alone
            raw, bounds = ids.tobytes(), (4 * np.append(0, ends)).tolist()
            found.update(zip(part, [raw[low:high] for low, high in zip(bounds[:-1], bounds[1:])]))
    alone = [w for w in words if w not in found]
    for word, encoded in zip(alone, tokenizer.encode_batch_fast(alone, add_special_tokens=False)):
        found[word] = array("I", encoded.ids).tobytes()
    return [found[w] for w in words]


def word_ids(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and how many each has."""
    tokenizer, cache, traits = _tokenizer(path)
    new = list({part for w in words if w not in cache for part in _parts(w, traits)} - cache.keys())
    if len(cache) + len(new) > CACHED_WORDS:
        cache.clear()
        new = list({part for w in words for part in _parts(w, traits)})
    for at in range(0, len(new), 20_000):
        part = new[at : at + 20_000]
        cache.update(zip(part, _encode(part, tokenizer, traits.last)))
    raw = [cache[w] if w in cache else b"".join([cache[p] for p in _parts(w, traits)]) for w in words]
    return np.frombuffer(b"".join(raw), np.uint32), np.fromiter(map(len, raw), np.int64, len(raw)) // 4


def token_ids(column: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows one after the other, each row's followed by `end_id`, and the bounds of the rows."""
    tokenizer, _, traits = _tokenizer(path)
    if not traits.spaced:  # whole texts, where words cannot be encoded for themselves
        rows = [np.array(e.ids + [end_id], np.uint32)
                for e in tokenizer.encode_batch_fast(column.fill_null("").to_pylist(), add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *rows]), np.cumsum([0, *map(len, rows)])
    data, offsets = tx.byte_buffer(column)
    if traits.lower:  # one form of each word; not where that would make a special token
        special = np.repeat(pc.match_substring(column.fill_null(""), "<|").to_numpy(zero_copy_only=False), np.diff(offsets))
        data = np.where(special, data, wd.LOWER[data]) if special.any() else wd.LOWER[data]
    split = pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(data)))
    coded = split.flatten().dictionary_encode()
    flat, sizes = word_ids(coded.dictionary.to_pylist(), path)
    flat, sizes = np.append(flat, np.uint32(end_id)), np.append(sizes, 1)
    starts = np.cumsum(sizes) - sizes
    bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
    words = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds[1:], len(sizes) - 1)
    bounds = bounds + np.arange(len(bounds))
    lengths = sizes[words]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    places = np.repeat(starts[words] - (ends - lengths), lengths) + np.arange(total)
    return flat[places], np.concatenate([[0], ends])[bounds]


def _pieces(path: str, capacity: int, end_id: int):
    @tx.tidy
    def run(batches):
        for part in tx.slices(batches, "text", SLICE_BYTES):
            ids, bounds = token_ids(part.column("text"), path, end_id)
            raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            row, piece, start, length, crc = [], [], [], [], []
            for k, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                for number, at in enumerate(range(low, high, capacity)):
                    to = min(at + capacity, high)
                    row.append(k)
                    piece.append(number)
                    start.append(at - low)
                    length.append(to - at)
                    crc.append(zlib.crc32(raw[4 * at : 4 * to]))
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["row", "piece", "start", "length", "ids_crc32"])
    return run


def token_pieces(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None,
                 capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """The pieces of every document: (row: struct of `keep`, piece, start, length, ids_crc32)."""
    rows = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(_pieces(path or tokenizer_path(), capacity, end_id),
                           f"row {rows.schema['row'].dataType.simpleString()}, {PIECE}")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and room left of each item, largest first; every item goes to the fullest bin that can take it."""
    bins, room_left = np.zeros(len(sizes), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if some bin has room r
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, len(room_left)
            room_left.append(room)
        bins[item] = chosen
        room_left[chosen] = room = room - size
        by_room[room].append(chosen)
        rooms |= 1 << room
    return bins, np.array(room_left, np.int64)


def _pack(capacity: int, slack: int, round_number: int):
    """Packs the items (size, members) of a partition into bins of the same form."""

    @tx.tidy
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        whole = pa.Table.from_batches(parts).combine_chunks()
        sizes = whole.column("size").to_numpy()
        members = whole.column("members").chunk(0)
        bins, room = best_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        bounds = members.offsets.to_numpy().astype(np.int64)
        counts = np.diff(bounds)[order]
        ends = np.cumsum(counts)
        places = np.repeat(bounds[:-1][order] - (ends - counts), counts) + np.arange(int(ends[-1]))
        per_bin = np.bincount(bins, weights=np.diff(bounds)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(per_bin)])
        out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members.values.take(pa.array(places)))
        base = (round_number << 48) + (TaskContext.get().partitionId() << 28)
        numbers = pa.array(base + np.arange(len(room)), pa.int64())
        yield pa.RecordBatch.from_arrays([numbers, pa.array(capacity - room, pa.int64()), out, pa.array(room <= slack)],
                                         names=["bin", "size", "members", "full"])
    return run


def pack(items: DataFrame, size: str = "length", capacity: int = CAPACITY, slack: int = SLACK,
         items_per_task: int = ITEMS) -> DataFrame:
    """Every item with `sequence_id` and `offset`: its place in a sequence of at most `capacity`.

    Items are rows with a `size` from 1 to `capacity`; input columns of these two names are replaced.
    """
    columns = [c for c in items.columns if c not in ("sequence_id", "offset")]
    member = F.struct(*columns)
    bins = stored(items.select(F.col(size).cast("bigint").alias("size"), F.array(member).alias("members")))
    schema = f"bin bigint, size bigint, members {bins.schema['members'].dataType.simpleString()}, full boolean"
    waiting, done, number = bins.count(), None, 0
    while waiting:
        parts = -(-waiting // items_per_task)
        # items of each partition are a random share, so all have about the same mix of sizes
        dealt = bins.repartition(parts, F.xxhash64("members", F.lit(number))) if parts > 1 else bins.coalesce(1)
        bins = stored(dealt.mapInArrow(_pack(capacity, slack, number), schema))
        made, left = bins.agg(F.count("*"), F.count_if(~F.col("full"))).first()
        last = parts == 1 or made == waiting  # a round that saves no bin is the last
        out = bins if last else bins.where("full")
        done = out if done is None else done.union(out)
        bins, waiting, number = bins.where("NOT full").select("size", "members"), 0 if last else left, number + 1
    if done is None:
        return items.select(*columns, F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    sized = done.withColumn("at", F.expr(
        f"slice(aggregate(members, array(0L), (ends, m) -> concat(ends, array(element_at(ends, -1) + m.`{size}`))),"
        " 1, size(members))"))
    flat = sized.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("members", "at")).alias("m"))
    return flat.select("m.members.*", "sequence_id", F.col("m.at").alias("offset"))


def pack_documents(docs: DataFrame, keep: list[str], text: str = "text", path: str | None = None,
                   capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK, items_per_task: int = ITEMS) -> DataFrame:
    """The pieces of every document with their place in a packed sequence, next to the columns `keep`.

    Defined results: a null text is empty; every text ends with `end_id`, so an empty one is a piece of one token;
    a longer text than `capacity` is cut into whole sequences and a last piece; repeated rows are packed each for
    itself; an empty table gives no rows; kept columns named like a result column are replaced by it.
    """
    results = {"piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    keep = [c for c in keep if c not in results]
    pieces = token_pieces(docs, keep, text, path, capacity, end_id)
    packed = pack(pieces, "length", capacity, slack, items_per_task)
    return packed.select(*(F.col("row").getField(c).alias(c) for c in keep), "piece", "start", "length", "ids_crc32",
                         "sequence_id", "offset")
