"""Phrase collocations by set-oriented mining: occurrence relations are extended one word at a time.

The relation R_k has a row (position, phrase) for each occurrence of a phrase of k words whose parts are frequent. It is
stored as Parquet in blocks of whole pieces of text, sorted by piece and position, so a merge join of neighbouring
positions never leaves a block and shuffles nothing. Two words of different pieces are never neighbours, as each new
piece skips a position. R_1 comes from the texts, read once to count words and once to store the frequent ones. Each
further length is done in four steps:

1. rows whose phrase is not frequent are left out (semi-join),
2. neighbouring rows of R_k, at p and p + 1, make the candidates of k + 1 words (merge join),
3. candidates are counted, first in the task, then by a shuffle of one entry per phrase and task (group count),
4. the candidates found often enough are written as R_{k+1}.

The semi-joins use bitmaps of a size between 8 KB and 16 MB, whatever the data; a phrase let through by chance costs
space, never a wrong row, because the groups themselves are counted by their two parts and kept by their exact count.
Words are compared as strings, phrases by the 64-bit hashes of their parts: counts are exact unless two frequent phrases
share a hash. The counts of step 3 are upper bounds, as they are taken by the first bits of a hash (at least 32, more for a
larger corpus, so that few phrases share them). They travel in packets: the sorted bits of a bucket as compressed differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import text as tx
from panelcast.llm import words as wd
from panelcast.llm.tables import WIDE_ROWS, as_long, deleted, shared_folder, shuffles_removed, text_or_empty, written

UNKNOWN = "und"
BREAKS = wd.byte_set((0x0A, 0x0D), *((ord(c),) * 2 for c in ".,;:!?"))
SPACES = wd.byte_set((0x09, 0x09), (0x20, 0x20))
BLOCK_BYTES = 1 << 20
HELD = 1 << 20
BITS = (16, 27)
BUCKETS = 64
RESULT = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
PACKET = "bucket bigint, packet binary"
PACKETS = pa.schema([("bucket", pa.int64()), ("packet", pa.binary())])
KEYS_PER_BUCKET = 1 << 20
SLOT_BITS = 32
WORDS = pa.schema([("step", pa.binary()), ("place", pa.binary()), ("groups", pa.list_(pa.struct(
    [("lang", pa.string()), ("word", pa.string()), ("key", pa.int64()), ("times", pa.int64())]))),
    ("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))])
WORD_ROWS = ("step binary, place binary, groups array<struct<lang: string, word: string, key: bigint, times: bigint>>, "
             "totals array<struct<lang: string, n: bigint>>")
PHRASES = pa.schema([("step", pa.binary()), ("place", pa.binary()), ("groups", pa.list_(pa.struct(
    [("key", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("times", pa.int64())])))])
PHRASE_ROWS = "step binary, place binary, groups array<struct<key: bigint, left: bigint, right: bigint, times: bigint>>"
COUNTS = pa.schema([("key", pa.int64()), ("times", pa.int64())])


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2**31, compressed: all lowest bytes first, as the others are zero for most."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _row(schema: pa.Schema, pos: np.ndarray, place: np.ndarray, *lists: list) -> pa.RecordBatch:
    """One block of a relation as a row: steps between positions, the place of each one's phrase among the block's groups, and
    lists of structs. Groups found often come first, so that their places take one byte."""
    def whole(values):
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    columns = [pa.array([_packed(x)], pa.binary()) for x in (np.diff(pos, prepend=0), place)]
    for field, parts in zip(list(schema)[2:], lists):
        fields = list(field.type.value_type)
        columns.append(whole(pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(parts, fields)], fields=fields)))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


class _Block:
    """The words of a slice of texts: positions, and for each word its place among the different (language, word)."""

    def __init__(self, batch: pa.RecordBatch):
        data, offsets = tx.byte_buffer(batch.column("text"))
        data = wd.LOWER[data]
        breaks = BREAKS[data]
        inside = ~(breaks | SPACES[data])
        starts, ends, first = wd.word_spans(inside, offsets)
        row = np.repeat(np.arange(batch.num_rows), np.diff(first))
        piece = np.cumsum(breaks, dtype=np.int32)[starts] + row  # grows with every break and row
        self.pos = np.arange(len(starts)) + piece
        words, self.words = wd.encode(data, inside, starts, ends)
        languages = batch.column("lang").dictionary_encode()
        self.languages = languages.dictionary
        of_row = languages.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.bincount(of_row, np.diff(first), len(self.languages)).astype(np.int64)
        pair = of_row[row] * max(1, len(self.words)) + words
        groups, self.place, self.times = np.unique(pair, return_inverse=True, return_counts=True)
        self.language, self.word = groups // max(1, len(self.words)), groups % max(1, len(self.words))
        self.keys = tx.mix(wd.hash_words(self.words)[self.word] * tx.BASE + wd.hash_words(self.languages)[self.language])


def _summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
    """Different slots, in order, and their counts."""
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys)
    keys, times = keys[order], np.concatenate([p[1] for p in parts])[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def slots(keys: np.ndarray, width: int) -> np.ndarray:
    """The first `width` bits of hashes."""
    return keys.view(np.uint64) >> np.uint64(64 - width)


def _packets(keys: np.ndarray, times: np.ndarray, bits: int, width: int = 64) -> pa.RecordBatch:
    """Sorted slots with counts, a packet for each bucket of equal first bits."""
    shift, planes = np.uint64(width - bits), -(-(width - bits) // 8)
    bucket = keys >> shift
    steps = np.diff(keys, prepend=np.uint64(0))
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    steps[first] = keys[first] - (bucket[first] << shift)
    small, raw = np.minimum(times, 255).astype(np.uint8), steps.view(np.uint8).reshape(-1, 8)
    packer, out = zstandard.ZstdCompressor(level=1, write_content_size=True), []
    for low, high in zip(first.tolist(), np.append(first[1:], len(keys)).tolist()):
        large = times[low:high][small[low:high] == 255]
        out.append(packer.compress(b"".join(((high - low).to_bytes(8, "little"), np.ascontiguousarray(raw[low:high, :planes].T).tobytes(), small[low:high].tobytes(), large.tobytes()))))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array(out, pa.binary())], schema=PACKETS)


def _unpacked(bucket: int, packet: bytes, bits: int, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    data, planes = zstandard.decompress(packet), -(-(width - bits) // 8)
    size = int.from_bytes(data[:8], "little")
    raw = np.zeros((size, 8), np.uint8)
    raw[:, :planes] = np.frombuffer(data, np.uint8, planes * size, 8).reshape(planes, size).T
    small = np.frombuffer(data, np.uint8, size, 8 + planes * size)
    times = small.astype(np.int64)
    times[small == 255] = np.frombuffer(data[8 + (planes + 1) * size :], np.int64)
    return np.cumsum(raw.view(np.uint64).ravel(), dtype=np.uint64) + (np.uint64(bucket) << np.uint64(width - bits)), times


def _counted(parts: Iterator[tuple[np.ndarray, np.ndarray]], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    """Packets of the slots of (hashes, counts), summed over a task as long as they fit `HELD` slots."""
    held, size = [], 0
    for keys, times in parts:
        part = slots(keys, width), times
        held.append(part)
        size += len(part[0])
        if size > HELD:
            held = [_summed(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield _packets(*held[0], bits, width)
                held, size = [], 0
    if size:
        yield _packets(*_summed(held), bits, width)


def _frequent(bits: int, width: int, least: int):
    """Sums the packets of each bucket; packets come in order of buckets."""
    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out():
            keys, times = _summed(parts)
            keep = times >= least
            return pa.RecordBatch.from_arrays([pa.array(as_long(keys[keep])), pa.array(times[keep])], schema=COUNTS)

        now, parts = None, []
        for batch in batches:
            for bucket, packet in zip(batch.column("bucket").to_pylist(), batch.column("packet").to_pylist()):
                if bucket != now and parts:
                    yield out()
                    parts = []
                now = bucket
                parts.append(_unpacked(bucket, packet, bits, width))
                if sum(len(p[0]) for p in parts) > 4 * KEYS_PER_BUCKET:
                    parts = [_summed(parts)]
        if parts:
            yield out()
    return run


def group_counts(packets: DataFrame, bits: int, width: int, least: int) -> DataFrame:
    """(key, times) of the slots counted `least` times or more."""
    dealt = packets.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_frequent(bits, width, least), "key bigint, times bigint")


def _count_words(bits: int, width: int):
    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (_Block(batch) for batch in tx.slices(batches, "text", BLOCK_BYTES))
        yield from _counted(((b.keys, b.times) for b in blocks), bits, width)
    return run


def _occurrences(counted: Members, width: int):
    """R_1 of each block: the words that may be frequent, how often each (language, word) occurs, and all words by language."""
    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches, "text", BLOCK_BYTES):
            b = _Block(batch)
            chosen = np.flatnonzero(counted.has(slots(b.keys, width)))
            chosen = chosen[np.argsort(-b.times[chosen], kind="stable")]
            new = np.full(len(b.keys), -1)
            new[chosen] = np.arange(len(chosen))
            place = new[b.place]
            keep = place >= 0
            yield _row(WORDS, b.pos[keep], place[keep], [
                b.languages.take(pa.array(b.language[chosen])), b.words.take(pa.array(b.word[chosen])).cast(pa.string()),
                as_long(b.keys[chosen]), b.times[chosen]], [b.languages, b.counts])
    return run


class Members:
    """A set of hashes as a bitmap; it may hold more than was put in."""

    def __init__(self, keys: DataFrame):
        size = keys.count()
        self.bits = min(max((32 * size).bit_length(), BITS[0]), BITS[1])
        slot = F.col("key").bitwiseAND(F.lit((1 << self.bits) - 1))
        cells = keys.select(F.shiftright(slot, 6).alias("cell"), F.expr("shiftleft(1L, int(key & 63))").alias("bit")).groupBy(
            "cell").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.cells = np.zeros(1 << (self.bits - 6), np.uint64)
        self.cells[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.view(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.cells[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            step, place = (_numbers(batch.column(c)[k].as_py()) for c in ("step", "place"))
            keys = batch.column("keys").slice(k, 1).flatten().to_numpy(zero_copy_only=False)
            yield np.cumsum(step), keys[place]


def _joined(pos: np.ndarray, key: np.ndarray, frequent: Members):
    """Candidates of one word more: (position, hash, left part, right part)."""
    of_frequent = frequent.has(key)
    pos, key = pos[of_frequent], key[of_frequent]
    at = np.flatnonzero(pos[1:] == pos[:-1] + 1)
    left, right = key[at], key[at + 1]
    return pos[at], as_long(tx.mix(left.view(np.uint64) * tx.BASE + right.view(np.uint64))), left, right


def _count(frequent: Members, bits: int, width: int):
    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (_joined(pos, key, frequent)[1].view(np.uint64) for pos, key in _blocks(batches))
        yield from _counted((np.unique(x, return_counts=True) for x in found if len(x)), bits, width)
    return run


def _extend(frequent: Members, counted: Members, width: int):
    """R_{k+1}: the candidates that may be frequent, and how often each occurs by its two parts."""
    @tx.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pos, key, left, right = _joined(*block, frequent)
            keep = counted.has(slots(key, width))
            if not keep.any():
                continue
            pos, key, left, right = pos[keep], key[keep], left[keep], right[keep]
            parts = np.lexsort((right, left, key))
            first = np.flatnonzero(np.append(True, (np.diff(key[parts]) != 0) | (np.diff(left[parts]) != 0)
                                             | (np.diff(right[parts]) != 0)))
            times = np.diff(np.append(first, len(parts)))
            often = np.argsort(-times, kind="stable")
            rank = np.empty(len(first), np.int64)
            rank[often] = np.arange(len(first))
            place = np.empty(len(parts), np.int64)
            place[parts] = np.repeat(rank, times)
            yield _row(PHRASES, pos, place, [x[parts[first[often]]] for x in (key, left, right)] + [times[often]])
    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100
                  ) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and the number of words of each language.

    Element k - 1 of the list has the phrases of k words found `least` times or more within pieces: `key`, `left` and
    `right` (hashes of the phrase and of it without its last and first word), `lang`, `words`, `a` (how often), `heads`
    and `tails` (how often its first and last 1, 2, ... k words occur). The list ends where no phrase is left. A null text is
    empty, a null language `und`.
    """
    top = shared_folder(docs.sparkSession, "phrases")
    rows = docs.select(text_or_empty(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    # so many buckets that each has a bounded number of hashes, as no word takes less than two bytes of text
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(10, min(40, (size // 2 // KEYS_PER_BUCKET).bit_length()))
    width = max(SLOT_BITS, size.bit_length() - 3)
    found = written(group_counts(rows.mapInArrow(_count_words(bits, width), PACKET), bits, width, least), f"{top}/counts1")
    relation = written(rows.mapInArrow(_occurrences(Members(found), width), WORD_ROWS), f"{top}/r1", WIDE_ROWS)
    deleted(docs.sparkSession, f"{top}/counts1")
    totals = written(relation.select(F.inline("totals")).groupBy("lang").agg(F.sum("n").alias("n")), f"{top}/totals")
    words = relation.select(F.inline("groups")).groupBy("lang", "word", "key").agg(F.sum("times").alias("a"))
    none = F.lit(None).cast("bigint")
    level = words.where(F.col("a") >= least).select(
        "key", none.alias("left"), none.alias("right"), "lang", F.array("word").alias("words"), "a", F.array("a").alias("heads"),
        F.array("a").alias("tails"))
    levels, k = [written(level, f"{top}/l1")], 0
    for k in range(1, longest):
        frequent = Members(levels[-1])
        occurrences = relation.select("step", "place", F.col("groups.key").alias("keys"))
        counts = group_counts(occurrences.mapInArrow(_count(frequent, bits, width), PACKET), bits, width, least)
        counted = Members(written(counts, f"{top}/counts{k + 1}"))
        relation = written(occurrences.mapInArrow(_extend(frequent, counted, width), PHRASE_ROWS), f"{top}/r{k + 1}", WIDE_ROWS)
        for name in (f"counts{k + 1}", f"r{k}"):  # what follows reads the new relation and the levels only
            deleted(docs.sparkSession, f"{top}/{name}")
        groups = relation.select(F.inline("groups")).groupBy("key", "left", "right").agg(F.sum("times").alias("a")).where(F.col("a") >= least)
        head = levels[-1].select(F.col("key").alias("left"), "lang", F.col("words").alias("front"), "heads")
        tail = levels[-1].select(F.col("key").alias("right"), F.element_at("words", -1).alias("last"), "tails")
        level = groups.join(head, "left").join(tail, "right").select(
            "key", "left", "right", "lang", F.concat("front", F.array("last")).alias("words"), "a",
            F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"))
        level = written(level, f"{top}/l{k + 1}")
        if level.isEmpty():
            break
        levels.append(level)
    deleted(docs.sparkSession, f"{top}/r{k + 1}")
    return levels, totals


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100,
                 top: int | None = 2000, covered: int = 100) -> DataFrame:
    """Phrases of 2 to `longest` words that occur together more often than their parts would by chance.

    `a` is how often a phrase occurs in its language, `n` the words of the language. Each cut into a first part found `l` and
    a rest found `r` times scores floor(1000 * a * n / (l * r)), in decimals of 38 digits; the lowest cut counts, of equal
    ones the first. A phrase inside a longer candidate with 100 * f(longer) >= `covered` * a is left out. Of each language
    the first `top` by score, `a` and phrase in byte order come back (all if None), ranked from 1.

    Null and empty texts have no words; texts of any length are read whole, in blocks of their own if longer than
    `BLOCK_BYTES`; repeated rows count as often as they occur; other columns are not looked at. An empty table gives no rows.
    """
    with shuffles_removed(docs.sparkSession):
        levels, totals = phrase_counts(docs, text, lang, longest, least)
    parts = []
    for k, level in enumerate(levels[1:], 2):
        if k < len(levels):
            longer = levels[k].select(F.explode(F.array("left", "right")).alias("key"), F.col("a").alias("most")).groupBy("key").agg(
                F.max("most").alias("most"))
            level = level.join(longer, "key", "left").where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("a")))
        parts.append(level.select("key", "lang", "words", "a", "heads", "tails"))
    if not parts:
        return docs.sparkSession.createDataFrame([], RESULT)
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    cuts = F.expr("""transform(sequence(1, size(words) - 1), c -> named_struct(
        'score', (cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0)))
                 div (cast(heads[c - 1] as decimal(19, 0)) * cast(tails[size(words) - c - 1] as decimal(19, 0))),
        'cut', c, 'l', heads[c - 1], 'r', tails[size(words) - c - 1]))""")
    scored = rows.join(totals, "lang").select("key", "lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.array_min(cuts).alias("best"))
    order = [F.desc("best.score"), F.desc("a"), F.asc("phrase")]
    if top is not None:  # first within buckets, so that no task ranks all phrases of a language
        bucket = Window.partitionBy("lang", F.pmod("key", F.lit(BUCKETS))).orderBy(*order)
        scored = scored.withColumn("rank", F.row_number().over(bucket)).where(F.col("rank") <= top)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
