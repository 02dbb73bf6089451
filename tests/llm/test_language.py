"""Language profiles against a direct computation, and which texts the prototypes are fitted on."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import language

SCHEMA = "doc_id long, text string, lang string"


def brute_profile(text):
    """Sum of bound letter vectors over the trigrams of the text's words, each in single spaces."""
    spaced = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    letter = {c: np.frombuffer(language._letter(ord(c)), np.int8).astype(np.int64) for c in set(spaced)}
    total = np.zeros(language.SIZE, np.int64)
    for a, b, c in zip(spaced, spaced[1:], spaced[2:]):
        if b != " ":
            total += np.roll(letter[a], 2) * np.roll(letter[b], 1) * letter[c]
    norm = np.linalg.norm(total)
    return total / norm if norm else total.astype(float)


TEXTS = ["Hello, world!", "a", "été À la  carte 42", "", None, "12 %", "ab" * 500, "mixed 한글 text", "x\ty\nz"]


def test_profiles_equal_direct_sums():
    got = language.profiles(TEXTS)
    want = np.array([brute_profile(t) for t in TEXTS])
    assert np.allclose(got, want, atol=1e-5)
    assert [bool(v.any()) for v in got] == [bool(v.any()) for v in want]


def test_scores_equal_direct_cosines(spark):
    draw = random.Random(6)
    words = {"a": ["the", "and", "of"], "b": ["que", "aux", "oi"]}
    rows = [(k, " ".join(draw.choice(words[x]) for _ in range(12)), x) for k, x in enumerate("ab" * 15)]
    rows += [rows[0], (90, rows[0][1], "a"), (91, None, "a"), (92, "...", "c"), (93, "lost text", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    langs, prototypes = language.fit(docs)
    assert langs == ["a", "b"]  # no letters in the only text of c
    for k, lang in enumerate(langs):
        total = sum(brute_profile(t) for t in {t for _, t, x in rows if x == lang and t})
        assert np.allclose(prototypes[k], total / np.linalg.norm(total), atol=1e-4)
    for r in language.predict(docs, (langs, prototypes)).select("row.text", "lang_pred", "score").collect():
        cosines = prototypes @ brute_profile(r.text)
        if (r.text or "...") == "...":
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == langs[int(cosines.argmax())] and r.score == pytest.approx(cosines.max(), abs=1e-4)


def test_copies_neither_crowd_out_nor_outweigh_other_texts(spark):
    rare = [(k, f"rare words number {chr(97 + k) * 4}", "r") for k in range(8)]
    rows = rare + [(100 + k, "one and the same line", "r") for k in range(3000)]
    few = language.fit(spark.createDataFrame(rows, SCHEMA), rows_per_language=9)
    once = language.fit(spark.createDataFrame(rare + rows[8:9], SCHEMA), rows_per_language=9)
    assert few[0] == once[0] == ["r"] and np.allclose(few[1], once[1], atol=1e-4)


def test_every_label_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, letters[k % 26] * 3 + letters[k // 26] * 3, f"label{k:03d}") for k in range(300)]
    assert len(language.fit(spark.createDataFrame(rows, SCHEMA))[0]) == 300


def test_empty_tables_repeated_rows_and_clashing_names(spark):
    model = language.fit(spark.createDataFrame([(1, "the and of", "a")], SCHEMA))
    none = spark.createDataFrame([], SCHEMA)
    assert language.predict(none, model).count() == 0 and language.fit(none)[0] == []
    clash = spark.createDataFrame([("the", "x", 1, 0.5, 7), ("the", "x", 1, 0.5, 7)],
                                  "text string, lang_pred string, row int, score double, hash int")
    got = language.predict(clash, model).collect()
    assert Counter((r["row"]["lang_pred"], r["row"]["row"], r["row"]["score"], r["row"]["hash"], r["lang_pred"]) for r in got) == {
        ("x", 1, 0.5, 7, "a"): 2}
