"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds (multiplies) the vectors of its letters, permuted
(rotated) by their place; a text's profile bundles (adds) the vectors of its trigrams. A language's prototype bundles
the profiles of its training texts, each of unit length. A text gets the language whose prototype has the largest
cosine with its profile.

Prototypes are fitted on about `rows_per_language` different training texts of each language at most, chosen by a hash; every
row is then compared with them. Prototypes are the only thing sent to the driver: one vector of 8 KB per language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm import text as tx

SIZE = 1024
ROWS_PER_LANGUAGE = 10_000
SLICE_ROWS = 256
SLICE_BYTES = 1 << 20
UNKNOWN = "und"


@lru_cache(1 << 16)
def _letter(code: int) -> bytes:
    return (np.random.default_rng([29, code]).integers(0, 2, SIZE, dtype=np.int8) * 2 - 1).tobytes()


@lru_cache(1 << 17)
def _is_letter(code: int) -> bool:
    return chr(code).isalpha()


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, trigram) pairs, how often each occurs, and the letters' codes; words are set in single spaces.

    A trigram is three places in the list of letters; the list's first entry is the space between words.
    """
    folded = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join(f" {t} " for t in folded).encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.unique(codes)
    letters = np.array([c for c in present.tolist() if _is_letter(c)], np.int64)
    alphabet = np.concatenate([[32], letters])
    lookup = np.zeros(len(present), np.int64)
    lookup[np.searchsorted(present, letters)] = np.arange(1, len(alphabet))
    small = lookup[np.searchsorted(present, codes)]
    row = np.repeat(np.arange(len(folded)), [len(t) + 2 for t in folded])
    keep = np.ones(len(small), bool)  # one space between words, and between rows
    keep[1:] = (small[1:] != 0) | (small[:-1] != 0) | (row[1:] != row[:-1])
    small, row = small[keep], row[keep]
    base = len(alphabet)
    triple = (small[:-2] * base + small[1:-1]) * base + small[2:]
    use = (row[:-2] == row[2:]) & (small[1:-1] != 0)
    key, counts = np.unique(row[:-2][use] * base**3 + triple[use], return_counts=True)
    return key // base**3, key % base**3, counts, alphabet


def profiles(texts: list[str | None]) -> np.ndarray:
    """Profiles of unit length; zero for a text without letters."""
    row, triple, counts, alphabet = _trigrams(texts)
    out = np.zeros((len(texts), SIZE), np.float32)
    if not len(row):
        return out
    base = len(alphabet)
    vectors = np.array([np.frombuffer(_letter(c), np.int8) for c in alphabet.tolist()])
    once, twice = np.roll(vectors, 1, axis=1), np.roll(vectors, 2, axis=1)
    distinct, place = np.unique(triple, return_inverse=True)
    for at in range(0, len(distinct), 4096):  # blocks bound the memory however many trigrams there are
        part = distinct[at : at + 4096]
        bound = (twice[part // base**2] * once[part // base % base] * vectors[part % base]).astype(np.float32)
        use = (place >= at) & (place < at + 4096)
        table = np.zeros((len(texts), len(part)), np.float32)
        table[row[use], place[use] - at] = counts[use]
        out += table @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def _row_slices(batches, column: str):
    for part in tx.slices(batches, column, SLICE_BYTES):
        for at in range(0, part.num_rows, SLICE_ROWS):
            yield part.slice(at, SLICE_ROWS)


@tx.tidy
def _bundle(batches):
    sums: dict[str, np.ndarray] = {}
    for part in _row_slices(batches, "text"):
        vectors = profiles(part.column("text").to_pylist())
        langs = np.array(part.column("lang").to_pylist(), object)
        for lang in set(langs.tolist()):
            sums[lang] = sums.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums)), pa.array([np.round(v * 2**20).astype(np.int64).tolist() for v in sums.values()],
                                            pa.list_(pa.int64()))], names=["lang", "profile"])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE
        ) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their prototypes.

    Defined results: rows without a language are not used; copies of a text in one language count once; of a language
    with more different texts a share is chosen by the hash of the text; every label is learned, unless its texts are null,
    empty or without letters; an empty table gives no languages. Other columns are not read.
    """
    rows = rows.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    rows = rows.withColumn("hash", F.xxhash64(F.lit(17), "text"))
    counts = rows.select("lang", "hash").distinct().groupBy("lang").count()
    share = counts.select("lang", (F.lit(float(rows_per_language)) / F.col("count")).alias("share"))
    spread = F.pmod(F.col("hash"), F.lit(1 << 20)) / float(1 << 20)
    few = rows.join(F.broadcast(share), "lang").where(spread < F.col("share"))
    chosen = few.groupBy("lang", "hash").agg(F.any_value("text").alias("text"))
    bundled = chosen.select("text", "lang").mapInArrow(_bundle, "lang string, profile array<bigint>")
    sums = bundled.select("lang", F.posexplode("profile").alias("place", "value")).groupBy("lang", "place").agg(
        F.sum("value").alias("value"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("cells")).select(
        "lang", F.col("cells.value").alias("profile")).collect()
    langs = sorted(r["lang"] for r in whole)
    by_lang = {r["lang"]: np.array(r["profile"], np.float64) for r in whole}
    prototypes = np.array([by_lang[x] for x in langs]) if langs else np.zeros((0, SIZE))
    norm = np.linalg.norm(prototypes, axis=1, keepdims=True)
    kept = [k for k in range(len(langs)) if norm[k, 0] > 0]
    return [langs[k] for k in kept], (prototypes[kept] / norm[kept]).astype(np.float32)


def _predict(langs: list[str], prototypes: np.ndarray, own: str | None):
    @tx.tidy
    def run(batches):
        for part in _row_slices(batches if own is None else tx.own_text(batches, own), "text"):
            vectors = profiles(part.column("text").to_pylist())
            cosine = vectors @ prototypes.T if langs else np.zeros((part.num_rows, 1))
            best = cosine.argmax(axis=1)
            known = vectors.any(axis=1) & bool(langs)
            score = np.where(known, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0.0)
            lang = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["row", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (all) of every row in struct `row`, with `lang_pred` and its cosine `score` (0 to 1).

    Defined results: null texts and texts without letters, or any text when nothing was learned, are `und` with score
    0; of equal cosines the first language by name wins; whole texts are read, of any length.
    """
    keep = keep or docs.columns
    own = text if text in keep else None
    rows = docs.select(F.struct(*keep).alias("row"), *([] if own else [F.col(text).alias("text")]))
    return rows.mapInArrow(_predict(*model, own),
                           f"row {rows.schema['row'].dataType.simpleString()}, lang_pred string, score double")
