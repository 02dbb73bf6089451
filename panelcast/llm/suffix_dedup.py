"""Removal of long repeated strings, found with two-stage suffix sorting.

Candidates. Each window of `length` bytes chooses the smallest hash among its k-byte strings (the leftmost of equals).
Equal windows choose alike, so runs of windows that chose one place, the chunks, can be grouped by the chosen hash,
the anchor: equal windows always lie in chunks of one anchor. Chunks whose anchor occurs once hold no repeat and are
dropped; equal chunks are one chunk with a count.

Suffix arrays. The different chunks of an anchor are read together with those of other anchors, some hundred
kilobytes at a time. Only suffixes smaller than their successors are sorted directly; all others are induced by
scanning the buckets of first bytes in order. Common prefixes of neighbours then show which windows occur twice.
An anchor with very many different chunks is divided first: its windows go by their distance from the anchor and the
bytes that all windows of such a division share, in finer steps until the groups are small.

The windows found are united per text, and the bytes they cover are removed. Texts are keyed by a 64-bit hash, and
equal texts are handled once. Only documents that lose bytes are shuffled with their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm import text as tx
from panelcast.llm.tables import as_long, maybe_in, stored, text_or_empty

LENGTH = 400
ANCHOR = 96
SLICE_BYTES = 512 << 10  # of text that a task takes apart at a time, with some 100 bytes of memory for each byte
PIECE = 1 << 20
BUFFER = 1 << 18
CROWDED = 4096
STEPS = (64, 8, 1)
CUT = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("text_key", pa.int64()), ("low", pa.int64()),
                 ("bytes", pa.binary())])
SPAN = pa.schema([("text_key", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])
CHUNK = "anchor bigint, content bigint, text_key bigint, low bigint, high bigint, place bigint, known boolean"
CHUNKS = ["anchor", "content", "text_key", "low", "high", "place", "known"]
MET = 1 << 19


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values, from running minima within blocks."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], ahead[width - 1 : width - 1 + count])


def chunks(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """Chunks of all texts in `data`: (anchor, content, row, low, high, place); windows start in [low, high)."""
    if len(data) < length:
        return None
    prefix = tx.Prefix(tx.BYTE_VALUES[data])
    at = np.arange(len(data) - anchor + 1)
    hashes = prefix.spans(at, at + anchor)
    low24 = np.uint64((1 << 24) - 1)
    chosen = sliding_min((hashes & ~low24) | at.astype(np.uint64), length - anchor + 1) & low24
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    valid = np.arange(len(chosen)) + length <= offsets[1:][row]
    cut = np.ones(len(chosen) + 1, bool)
    cut[1:-1] = (chosen[1:] != chosen[:-1]) | (valid[1:] != valid[:-1]) | (row[1:] != row[:-1])
    bounds = np.flatnonzero(cut)
    low, high = bounds[:-1], bounds[1:]
    low, high = low[valid[low]], high[valid[low]]
    if not len(low):
        return None
    place = chosen[low].astype(np.int64)
    content = prefix.spans(low, high + length - 1) + (high - low).astype(np.uint64)
    return hashes[place], content, row[low], low, high, place


def _candidates(length: int, anchor: int):
    """The chunks of every text, once per text and task; long texts in overlapping pieces.

    What a task has met twice is known to repeat: further copies of a chunk are marked so and go under keys of their
    own, so that a common passage does not send all its rows to one task.
    """

    @tx.tidy
    def run(batches):
        seen: set[int] = set()
        met: dict[int, int] = {}
        for part in tx.slices(batches, "text", SLICE_BYTES):
            keys = part.column("text_key").to_numpy(zero_copy_only=False)
            data, offsets = tx.byte_buffer(part.column("text"))
            fresh = np.zeros(len(keys), bool)
            for k, key in enumerate(keys.tolist()):
                if offsets[k + 1] - offsets[k] >= length and key not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(key)
                    fresh[k] = True
            if len(data) <= PIECE:
                pieces = [(0, len(data), offsets)]
            else:  # one long text, or it would have been sliced
                pieces = [(a, min(a + PIECE + length - 1, len(data)), None) for a in range(0, len(data) - length + 1, PIECE)]
            for start, end, rows in pieces:
                if rows is None:
                    row_of = int(np.searchsorted(offsets, start, "right")) - 1
                    inner = np.clip(offsets, start, end) - start
                else:
                    row_of, inner = 0, rows
                got = chunks(data[start:end], inner, length, anchor)
                if got is None:
                    continue
                hashes, content, row, low, high, place = got
                base = offsets[row] - start
                use = fresh[row]
                known = np.zeros(int(use.sum()), bool)
                for k, c in enumerate(content[use].tolist()):
                    times = met.get(c, 0)
                    known[k] = times > 1
                    if times or len(met) < MET:
                        met[c] = times + 1
                text_key, low = keys[row[use]], (low - base)[use]
                own = tx.mix(text_key.view(np.uint64) + low.astype(np.uint64) * tx.BASE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(as_long(np.where(known, own, hashes[use]))), pa.array(as_long(content[use])), pa.array(text_key),
                     pa.array(low), pa.array((high - base)[use]), pa.array((place - base)[use]), pa.array(known)], names=CHUNKS)
    return run


def two_stage_sort(text: bytes, depth: int) -> np.ndarray:
    """Suffix array of `text`, by the first `depth` bytes of the suffixes.

    Suffixes smaller than their successor are sorted directly. A suffix that is larger than its successor comes before
    the sorted ones of its bucket (its first byte), in the order of the successors: scanning the buckets from the
    smallest byte up and looking one place to the left puts all of these in order.
    """
    data = np.frombuffer(text, np.uint8)
    size = len(data)
    if not size:
        return np.zeros(0, np.int64)
    step = np.zeros(size, np.int8)  # 1: smaller than its successor; the last suffix is larger than the empty one
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    known = np.where(step != 0, np.arange(size), size)
    step = step[np.minimum.accumulate(known[::-1])[::-1]]
    small = np.flatnonzero(step > 0)
    direct = np.array(sorted(small.tolist(), key=lambda p: text[p : p + depth]), np.int64)
    heads = np.searchsorted(data[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
    queued: list[list[np.ndarray]] = [[] for _ in range(256)]  # larger suffixes of each bucket, in order
    queued[int(data[-1])].append(np.array([size - 1]))
    out = []
    for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
        wave = np.concatenate(queued[byte]) if queued[byte] else np.zeros(0, np.int64)
        larger = []
        while len(wave):  # runs of this byte lead to the next wave of the same bucket
            larger.append(wave)
            left = wave[wave > 0] - 1
            wave = left[data[left] == byte]
        bucket = np.concatenate([*larger, direct[heads[byte] : heads[byte + 1]]])
        out.append(bucket)
        left = bucket[bucket > 0] - 1
        left = left[data[left] > byte]
        first = data[left]
        order = np.argsort(first, kind="stable")
        left, first = left[order], first[order]
        starts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(left) else []
        for a, b in zip(starts, [*starts[1:], len(left)]):
            queued[int(first[a])].append(left[a:b])
    return np.concatenate(out)


def common_prefixes(prefix: tx.Prefix, order: np.ndarray, size: int, limit: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it, up to `limit`, by bisection on hashes."""
    a, b = order[:-1], order[1:]
    low = np.zeros(len(a), np.int64)
    high = np.minimum(limit, size - np.maximum(a, b))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return np.concatenate([[0], low]) if len(order) else low
        middle = (low[open_] + high[open_] + 1) // 2
        p, q = a[open_], b[open_]
        same = prefix.spans(p, p + middle) == prefix.spans(q, q + middle)
        low[open_] = np.where(same, middle, low[open_])
        high[open_] = np.where(same, high[open_], middle - 1)


def repeated_starts(pieces: list[bytes], windows: list[int], length: int) -> np.ndarray:
    """Marks the window starts, piece after piece, whose window of `length` bytes is also at another start."""
    text = b"\xff".join(pieces) + b"\xff"  # no byte of UTF-8
    starts = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
    valid = np.zeros(len(text), bool)
    for at, count in zip(starts.tolist(), windows):
        valid[at : at + count] = True
    order = two_stage_sort(text, length)
    order = order[valid[order]]
    prefix = tx.Prefix(tx.BYTE_VALUES[np.frombuffer(text, np.uint8)])
    same = common_prefixes(prefix, order, len(text), length) >= length
    twice = np.zeros(len(text), bool)
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    return twice[valid]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _sorted_groups(length: int):
    """Repeated windows of each chunk, from rows sorted by anchor; whole anchors are sorted together."""

    def solve(rows):
        flags = repeated_starts([r[4] for r in rows], [len(r[4]) - length + 1 for r in rows], length)
        at, out = 0, []
        for _, _, key, low, piece in rows:
            count = len(piece) - length + 1
            out += [(key, low + a, low + b) for a, b in _runs(flags[at : at + count])]
            at += count
        return _batch(out, SPAN)

    @tx.tidy
    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "content", "text_key", "low", "bytes"))):
                if size > BUFFER and row[0] != last:
                    yield solve(held)
                    held, size = [], 0
                if held and held[-1][:2] == row[:2]:
                    continue
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield solve(held)
    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


@tx.tidy
def _cut_bytes(batches):
    """The bytes of the chunks listed for each text."""
    for batch in batches:
        for text, key, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "text_key", "wanted"))):
            data = text.encode()
            yield _batch([(w["anchor"], w["content"], key, w["low"], data[w["low"] : w["end"]]) for w in wanted], CUT)


def _divide(step: int, length: int):
    """Windows of crowded anchors in divisions by distance from the anchor.

    All windows of a division hold the bytes from the division's last start to its first end; the key is their hash.
    """

    @tx.tidy
    def run(batches):
        for batch in batches:
            for text, key, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "text_key", "wanted"))):
                prefix = tx.Prefix(tx.BYTE_VALUES[np.frombuffer(text.encode(), np.uint8)])
                for w in wanted:
                    starts = np.arange(w["low"], w["end"] - length + 1)
                    part = (w["place"] - starts) // step
                    cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
                    low, high, part = starts[cut], np.append(starts[cut[1:]], w["end"] - length + 1), part[cut]
                    first, last = w["place"] - step * (part + 1) + 1, w["place"] - step * part
                    shared = prefix.spans(last, first + length)
                    anchor = tx.mix(shared + part.astype(np.uint64) * tx.BASE)
                    content = prefix.spans(low, high + length - 1) + (high - low).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(as_long(anchor)), pa.array(as_long(content)), pa.array(np.full(len(low), key)),
                         pa.array(low), pa.array(high), pa.array(np.full(len(low), w["place"])), pa.array(np.zeros(len(low), bool))], names=CHUNKS)
    return run


def _texts_with(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, text_key, wanted): each text once, with the chunks wanted of it."""
    wanted = wanted.groupBy("text_key").agg(
        F.collect_set(F.struct("anchor", "content", "low", "end", "place")).alias("wanted"))
    near = maybe_in(docs, "text_key", wanted, "_maybe").where("_maybe").select("text_key", "text")
    return near.dropDuplicates(["text_key"]).join(wanted, "text_key")


def _grouped(rows: DataFrame) -> DataFrame:
    """Chunks whose anchor occurs again, with the copies of each and the number of different chunks of the anchor."""
    same, group = Window.partitionBy("anchor", "content"), Window.partitionBy("anchor")
    rows = rows.repartition("anchor").withColumn("copies", F.count("*").over(same))
    rows = rows.withColumn("first", F.struct("text_key", "low") == F.min(F.struct("text_key", "low")).over(same))
    rows = rows.withColumn("times", F.count("*").over(group)).withColumn(
        "variants", F.sum(F.col("first").cast("bigint")).over(group))
    return stored(rows.where("times > 1 OR known").drop("times"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, crowded: int = CROWDED) -> DataFrame:
    """(text_key, low, high): starts [low, high) of windows that occur at another place too. docs: text, text_key."""
    whole = docs.groupBy("text_key").agg(F.count("*").alias("rows"), F.first(F.octet_length("text")).alias("n"))
    found = [whole.where(f"rows > 1 AND n >= {length}").select(
        "text_key", F.lit(0).cast("bigint").alias("low"), (F.col("n") - length + 1).cast("bigint").alias("high"))]
    rows = docs.select("text", "text_key").mapInArrow(_candidates(length, anchor), CHUNK)
    for step in (*(min(s, length // 2) for s in STEPS), None):  # a division's windows share half a window or more
        rows = _grouped(rows)
        found.append(rows.where("copies > 1 OR known").select("text_key", "low", "high"))
        several = rows.where("first AND variants > 1").withColumn("end", F.col("high") + length - 1)
        pieces = _texts_with(docs, several.where(f"variants <= {crowded}")).mapInArrow(
            _cut_bytes, "anchor bigint, content bigint, text_key bigint, low bigint, bytes binary")
        found.append(pieces.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(
            _sorted_groups(length), "text_key bigint, low bigint, high bigint"))
        many = several.where(f"variants > {crowded}")
        if step is None or many.isEmpty():
            break
        rows = _texts_with(docs, many).mapInArrow(_divide(step, length), CHUNK)
    out = found[0]
    for part in found[1:]:
        out = out.union(part)
    return out


def _cut(length: int, own: str):
    """Bytes left of each text, as text without characters that lost bytes, and what was removed."""

    @tx.tidy
    def run(batches):
        for batch in tx.own_text(batches, own):
            kept, removed, spans = [], [], []
            for text, windows in zip(batch.column("text").to_pylist(), batch.column("windows").to_pylist()):
                data, at, parts, stretches, end = (text or "").encode(), 0, [], 0, -1
                for w in sorted(windows or [], key=lambda w: w["low"]):
                    low, high = w["low"], w["high"] + length - 1
                    if low > end:
                        parts.append(data[at:low])
                        stretches += 1
                    end = at = max(end, high)
                parts.append(data[at:])
                kept.append(b"".join(parts))
                removed.append(len(data) - len(kept[-1]))
                spans.append(stretches)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept]),
                 pa.array(removed, pa.int64()), pa.array(spans, pa.int64())],
                names=["row", "kept", "kept_text", "n_removed", "n_spans"])
    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   crowded: int = CROWDED) -> DataFrame:
    """Every document as struct `row`, with `kept` (the bytes left), `kept_text` (without
    characters that lost some of their bytes), `n_bytes`, `n_removed` and `n_spans`.

    A byte goes if it lies in a string of `length` bytes that starts at any other place, in the same text or another
    row, judged on the input. Defined results: null texts are empty and lose nothing; a repeated row is another place,
    so rows with equal texts of `length` bytes or more lose all; no match crosses documents; an empty table gives no
    rows. All columns stay inside `row`, so their names cannot clash.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.struct(*docs.columns).alias("row"), value.alias("text"), F.xxhash64(value).alias("text_key"))
    windows = stored(repeated_windows(docs.select("text", "text_key"), length, anchor, crowded).groupBy("text_key").agg(
        F.collect_set(F.struct("low", "high")).alias("windows")))
    marked = maybe_in(docs, "text_key", windows, "_maybe")
    zero = F.lit(0).cast("bigint")
    whole = marked.where("NOT _maybe").select("row", F.encode("text", "UTF-8").alias("kept"),
                                              F.col("text").alias("kept_text"), zero.alias("n_removed"), zero.alias("n_spans"))
    row_type = docs.schema["row"].dataType.simpleString()
    cut = marked.where("_maybe").select("row", "text_key").join(windows, "text_key", "left").select(
        "row", "windows").mapInArrow(_cut(length, text), f"row {row_type}, kept binary, kept_text string, n_removed bigint, n_spans bigint")
    out = whole.union(cut)
    return out.select("row", "kept", "kept_text", (F.octet_length("kept") + F.col("n_removed")).cast("bigint").alias("n_bytes"),
                      "n_removed", "n_spans")
