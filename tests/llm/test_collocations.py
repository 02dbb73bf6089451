"""Phrase collocations against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import collocations as co

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, longest=5, least=100, top=2000, covered=100):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            counts = f.setdefault(lang, Counter())
            counts.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        chosen = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        inside = Counter()
        for p, c in chosen.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], c)
        found = []
        for p, a in chosen.items():
            if 100 * inside[p] >= covered * a and inside[p]:
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def made(seed, count=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "éa", "x y", "a\x00b", "city", "in"] + [f"w{k}" for k in range(30)]
    fixed = ["new york city in the", "of the new", "w1 w2 w3 w4 w5 w6", "no no no no"]
    rows = []
    for _ in range(count):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary))
            parts.append(rng.choice([" ", " ", " ", "\t", "\n", ". ", ", ", "!", "  "]))
        rows.append(("".join(parts), rng.choice(["en", "en", "en", "fr", None])))
    return rows


@pytest.mark.parametrize("seed,least,top,covered", [(1, 5, 2000, 100), (2, 3, 7, 100), (3, 4, 2000, 70)])
def test_equals_brute_force(spark, seed, least, top, covered):
    rows = [*made(seed), (None, "en"), ("", None), ("...", "de"), ("only words", "und")]
    docs = spark.createDataFrame([(t, x, 1, 2) for t, x in rows], "text string, lang string, key int, word int").repartition(3)
    got = co.collocations(docs, least=least, top=top, covered=covered).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute(rows, least=least, top=top, covered=covered)


def test_blocks_and_flushes_do_not_show(spark, monkeypatch):
    monkeypatch.setattr(co, "BLOCK_BYTES", 64)
    monkeypatch.setattr(co, "HELD", 20)
    monkeypatch.setattr(co, "KEYS_PER_BUCKET", 4)
    rows = made(9, 60)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    rows_in = docs.select("text", "lang").collect()
    got = co.collocations(docs, least=3).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == brute([tuple(r) for r in rows_in], least=3)


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert co.collocations(empty).collect() == [] and co.collocations(empty).columns == COLUMNS
    assert co.collocations(empty, longest=1).collect() == []
    assert co.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []


def test_long_text_and_large_numbers(spark):
    docs = spark.createDataFrame([("new york " * 60_000, "en")], "text string, lang string")
    got = [tuple(r) for r in co.collocations(docs, longest=3, least=100).collect()]
    assert sorted(got) == brute([("new york " * 60_000, "en")], longest=3)


@pytest.mark.parametrize("bits", [10, 12, 30])
def test_packets_round_trip(bits):
    rng = np.random.default_rng(bits)
    keys = np.unique(rng.integers(0, 1 << 64, 3000, dtype=np.uint64))
    times = rng.choice([1, 2, 254, 255, 256, 10**15], len(keys))
    batch = co._packets(keys, times, bits)
    got = [co._unpacked(b, p, bits) for b, p in zip(batch.column("bucket").to_pylist(), batch.column("packet").to_pylist())]
    assert np.array_equal(np.concatenate([g[0] for g in got]), keys) and np.array_equal(np.concatenate([g[1] for g in got]), times)


@pytest.mark.parametrize("bits,width", [(10, 32), (16, 40), (10, 34)])
def test_packets_of_slots_round_trip(bits, width):
    rng = np.random.default_rng(width)
    keys = np.unique(co.slots(rng.integers(0, 1 << 64, 3000, dtype=np.uint64), width))
    times = rng.choice([1, 254, 255, 10**15], len(keys))
    batch = co._packets(keys, times, bits, width)
    got = [co._unpacked(b, p, bits, width) for b, p in zip(batch.column("bucket").to_pylist(), batch.column("packet").to_pylist())]
    assert np.array_equal(np.concatenate([g[0] for g in got]), keys) and np.array_equal(np.concatenate([g[1] for g in got]), times)


def test_phrases_that_share_a_slot_keep_their_own_counts(spark, monkeypatch):
    monkeypatch.setattr(co, "SLOT_BITS", 12)  # four thousand slots for more phrases than that
    rows = made(9, 400)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in co.collocations(docs, least=4).collect()) == brute(rows, least=4)
