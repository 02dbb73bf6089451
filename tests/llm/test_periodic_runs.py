"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelcast.llm import periodic_runs as pr
from panelcast.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, smallest periods first."""
    n, best = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                best.setdefault((i, j - i + q), q)
            i = j
    return sorted((i, length, q) for (i, length), q in best.items())


def kept(words: list[str], runs) -> str:
    drop = set()
    for start, length, period in runs:
        drop.update(range(start + period, start + length))
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def planted(rng: random.Random, n: int) -> list[str]:
    out: list[str] = []
    while len(out) < n:
        kind = rng.random()
        if kind < 0.5:
            unit = [rng.choice("abcd") for _ in range(rng.randint(1, 60))]
            size = int(len(unit) * rng.uniform(1, 6))
            out += (unit * 7)[:size]
        else:
            out += [rng.choice("abcdefgh") for _ in range(rng.randint(1, 40))]
    return out[:n]


def ids(texts: list[list[str]]):
    code, sequence, begins, ends = {}, [], [], []
    for k, words in enumerate(texts):
        begins.append(len(sequence))
        sequence += [code.setdefault(w, len(code)) for w in words]
        ends.append(len(sequence))
        sequence.append(10_000 + k)
    return np.array(sequence, np.int64), np.array(begins, np.int64), np.array(ends, np.int64)


def split(runs, begins):
    out = [[] for _ in begins]
    for start, length, period in runs.tolist():
        k = int(np.searchsorted(begins, start, "right")) - 1
        out[k].append((start - int(begins[k]), length, period))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    texts = [planted(rng, rng.choice([0, 1, 23, 24, 40, 100, 300, 700])) for _ in range(12)]
    sequence, begins, ends = ids(texts)
    assert split(pr.runs_of(sequence, begins, ends), begins) == [brute(t) for t in texts]


@pytest.mark.parametrize("unit", ["a", "ab", "aab", "abcabd", "a" * 15 + "b", "a" * 16 + "b", "a" * 31 + "b", "ab" * 20 + "c"])
def test_whole_text_repeats(unit):
    for n in (23, 24, 25, 3 * len(unit) - 1, 3 * len(unit), 500):
        words = list(unit * (n // len(unit) + 1))[:n]
        sequence, begins, ends = ids([words])
        assert split(pr.runs_of(sequence, begins, ends), begins) == [brute(words)]


def test_squares_of_two_words_and_structured_texts():
    fib = ["a", "ab"]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 1024:
        thue += thue.translate(str.maketrans("ab", "ba"))
    texts = [list(fib[-1]), list(thue), list(thue * 3)]
    sequence, begins, ends = ids(texts)
    assert split(pr.runs_of(sequence, begins, ends), begins) == [brute(t) for t in texts]


def test_long_texts_stay_near_linear():
    words = np.zeros(400_001, np.int64)
    words[-1] = 7
    runs = pr.runs_of(words, np.array([0]), np.array([400_000]))
    assert runs.tolist() == [[0, 400_000, 1]]
    again = np.tile(np.arange(130_000), 4)[:400_001]
    again[-1] = 1_000_000
    assert pr.runs_of(again, np.array([0]), np.array([400_000])).tolist() == [[0, 400_000, 130_000]]
    rough = np.tile(np.append(np.zeros(50_000, np.int64), 1), 4)
    runs = pr.runs_of(np.append(rough, 9), np.array([0]), np.array([len(rough)])).tolist()
    assert [0, len(rough), 50_001] in runs and [0, 50_000, 1] in runs and len(runs) == 5


def test_transforms_correlate_exactly():
    rng = np.random.default_rng(5)
    for size in (32, 64, 256, 4096):
        x, y = rng.integers(0, pr.PRIME, (2, 3, size))
        product = pr.transform(pr.reduced(x.astype(float)), -1) * pr.transform(pr.reduced(y.astype(float)), 1)
        got = pr.back(pr.reduced(product)).astype(np.int64) % pr.PRIME
        for a, b, c in zip(x.tolist(), y.tolist(), got.tolist()):
            for t in rng.integers(0, size, 5):
                assert c[t] == sum(a[i] * b[(i + int(t)) % size] for i in range(size)) % pr.PRIME


def test_operator_on_hard_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (3, " \n\t ", "y"), (4, "Ab ab " * 20, "z"), (4, "Ab ab " * 20, "z"), (None, "q " * 30, "n"),
            (5, "é ü " * 15 + "ende\x00 x\x1f y", None), (6, "one two three", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs string")
    got = sorted((tuple(map(str, r["row"])), r["n_words"], [tuple(x) for x in r["runs"]], r["kept_text"]) for r in pr.find_runs(docs).collect())
    want = []
    for row in rows:
        words = WORD.findall(row[1] or "")
        runs = brute(words)
        want.append((tuple(map(str, row)), len(words), runs, kept(words, runs)))
    assert got == sorted(want)
    assert pr.find_runs(docs.where("false")).collect() == []


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc, text in docs:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        row = got[doc]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(kept(words, runs).encode()).hexdigest()


def test_equal_hashes_do_not_matter(monkeypatch):
    monkeypatch.setattr(pr.Equal, "__call__", lambda self, at, distance, length: np.ones(len(at), bool))
    rng = random.Random(77)
    texts = [planted(rng, 200) for _ in range(6)]
    sequence, begins, ends = ids(texts)
    got = split(pr.runs_of(sequence, begins, ends), begins)
    assert all(run in brute(t) for t, found in zip(texts, got) for run in found)
