"""Each operator against a brute-force version, on texts with nulls, empty and long ones, ties and repeated rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import chat, decontaminate, html_content, language, license_scan, ngram_join, packing, quality, sharding
from panelcast.llm import suffix_dedup as dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_words string, row string, gram string, node string"


def frame(spark, texts, lang="en", source="s"):
    """Documents with extra columns whose names are also used inside the operators."""
    rows = [(k, t, lang, source, "x", "y", "z", "w") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sample_texts(seed=3, count=60):
    draw = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[draw.choice(vocabulary) for _ in range(draw.randint(20, 120))] for _ in range(8)]
    texts = []
    for _ in range(count):
        words = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 8])):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        texts.append(draw.choice([" ", "\n", "\t "]).join(words))
    long = " ".join(draw.choice(vocabulary) for _ in range(20_000))
    return [*texts, None, "", " \n ", "one", "One two", "one two", texts[0], texts[0], long, long + " end"]


# ---- op1


def test_tokens_equal_whole_text_encoding():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["Hello, World! it's 42 x", None, "", "  ", "café CAFÉ, <|endoftext|> <|ENDOFTEXT|>a", "ΣΣ. don't;x y,,", "a\x1cb"]
    path = packing.tokenizer_path()
    ids, bounds = packing.token_ids(pa.array(texts), path, 0)
    whole = Tokenizer.from_file(path)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*whole.encode(text or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("per_task", [5, 100_000])
def test_packing_is_gapless_and_tight(spark, per_task):
    out = packing.pack_documents(frame(spark, sample_texts()), ["doc_id", "row"], capacity=128, items_per_task=per_task).toPandas()
    assert set(out.doc_id) == set(range(len(sample_texts())))
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist() and own.length.sum() <= 128
    for _, own in out.sort_values("piece").groupby("doc_id"):
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist() and (own.length[:-1] == 128).all()
    bound = -(-out.length.sum() // 128)
    assert out.sequence_id.nunique() <= bound * (1.02 if per_task > 5 else 1.2) + 1


def test_packing_of_nothing(spark):
    assert packing.pack_documents(frame(spark, []), ["doc_id"]).count() == 0


def test_best_fit_takes_the_fullest_bin():
    bins, room = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and room.tolist() == [0, 0]


# ---- op2


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_groups(texts):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    return {k: (len(sets[k]), find(k)) for k in range(len(texts))}


def near_copies(seed, count):
    """Chains and stars of copies with ever more edits, around the bound of similarity."""
    draw = random.Random(seed)
    texts = []
    for _ in range(4):
        base = [f"v{draw.randrange(10**6)}" for _ in range(90)]
        for _ in range(count):
            words = list(base)
            for _ in range(draw.randint(0, 5)):
                words[draw.randrange(len(words))] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(words[draw.randint(0, 4) :]))
            if draw.random() < 0.3:
                base = words
    return texts


@pytest.mark.parametrize("texts", [sample_texts(), near_copies(1, 25), near_copies(2, 25)], ids=["mixed", "near1", "near2"])
@pytest.mark.parametrize("budget", [1, 1 << 18])
def test_similar_groups(spark, monkeypatch, texts, budget):
    monkeypatch.setattr(ngram_join, "PAIRS_PER_GRAM", budget)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(frame(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_one_of_each_group(spark):
    texts = sample_texts()
    groups = brute_groups(texts)
    kept = ngram_join.one_of_each_group(frame(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    ids = sorted(r.doc_id for r in kept.collect())
    assert ids == sorted({c if n else k for k, (n, c) in groups.items()})
    assert ngram_join.one_of_each_group(frame(spark, [])).count() == 0


# ---- op3


def test_license_scan(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    mit = "Released under the MIT license."
    texts = [None, "", "license", apache, f"a b c {mit.upper()} d", " ".join(["x"] * 5000) + f"\n{apache}", f"{apache} {mit}",
             "this work is licensed under the gnu general public license version 4", mit, mit]
    got = {(r.doc_id, r.license_id): (r.n_found, r.n_shingles) for r in license_scan.scan(frame(spark, texts)).collect()}
    gpl = (7, 8)  # one word in twelve differs, at the end
    assert got == {(3, "Apache-2.0"): (3, 3), (4, "MIT"): (1, 1), (5, "Apache-2.0"): (3, 3), (6, "Apache-2.0"): (3, 3),
                   (6, "MIT"): (1, 1), (7, "GPL-3.0"): gpl, (8, "MIT"): (1, 1), (9, "MIT"): (1, 1)}
    assert license_scan.scan(frame(spark, [])).count() == 0
    assert license_scan.scan(frame(spark, texts), {}).count() == 0


# ---- op4

PAGE = ("<html><head><title>t</title><style>p{}</style></head><body><nav><a href='/'>Home</a></nav><div class='cookie-notice'>Cookies"
        "</div><article><h1>Head <em>on</em>e</h1><p>First&nbsp;par &amp; x.<p>Second<br>line<div class=ad>Buy</div><script>var a='</p>'"
        "</script><form>Mail<input></form><ul><li>a<li>b</ul></article><section id=comments>Nice</section><footer>f</footer></body></html>")


def test_html_extraction(spark):
    pages = [PAGE, None, "", "<", "a < b", PAGE.replace("article>", "div>"), PAGE[: PAGE.index("Second") + 10], PAGE, "<p>" * 3000 + "deep"]
    rows = spark.createDataFrame([(k, "u", p, "t") for k, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_content.extract(rows, ["page_id", "url", "text"]).collect()}
    text = "Head one First par & x. Second line a b"
    assert got[0] == got[5] == got[7] == text
    assert got[1] == got[2] == "" and got[4] == "a < b" and got[6] == "Head one First par & x. Second" and got[8] == "deep"
    assert html_content.extract(rows.where("false"), ["page_id"]).count() == 0


# ---- op5


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {p for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_and_verdicts(spark):
    texts = [*sample_texts(), "a b c a b c a b c", "#\n#\n\n \n#", "éè 中文 a", " ".join(f"###w{k}" for k in range(300))]
    rows = frame(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 9 > 0, "en"))
    got = {r.doc_id: r for r in quality.judge(rows, ["doc_id", "n_words"]).collect()}
    for k, text in enumerate(texts):
        r = got[k]
        want = brute_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert not got[len(texts) - 1].kept and not any(got[k].kept for k, t in enumerate(texts) if not t)
    assert sum(r.kept for r in got.values()) > 40
    assert quality.judge(frame(spark, []), ["doc_id"]).count() == 0


# ---- op6


def test_language_id(spark):
    draw = random.Random(4)
    parts = {"a": ["the", "and", "ing", "tion"], "b": ["ée", "aux", "que", "oi"], "c": ["ß", "sch", "ung", "ei"]}
    rows = [(k, "".join(draw.choice(parts[x]) + draw.choice(["", " "]) for _ in range(60)), x) for k, x in enumerate("abc" * 40)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in language.predict(train.where("doc_id % 5 = 0"), model).select("row.doc_id", "row.lang", "lang_pred", "score").collect()}
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got.values())
    odd = frame(spark, [None, "", "12 %%", "한글", "the " * 50_000])
    marked = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(odd, model).select("row.doc_id", "lang_pred", "score").collect()}
    assert [marked[k] for k in range(3)] == [("und", 0.0)] * 3 and marked[4][0] == "a"
    nothing = language.predict(odd, language.fit(odd.where("false"))).select("lang_pred").distinct().collect()
    assert [r.lang_pred for r in nothing] == ["und"]


# ---- op7


def brute_removed(texts, length):
    data = [(t or "").encode() for t in texts]
    counts = Counter(t[k : k + length] for t in data for k in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if counts[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((int(gone.sum()), spans, bytes(b for b, x in zip(t, gone) if not x)))
    return out


def test_two_stage_sort():
    draw = random.Random(1)
    for trial in range(200):
        text = bytes(draw.choice(b"ab" if trial % 2 else b"abcd") for _ in range(draw.randint(0, 50)))
        assert dedup.two_stage_sort(text, len(text) + 1).tolist() == sorted(range(len(text)), key=lambda p: text[p:])


@pytest.mark.parametrize("crowded", [4096, 3])
def test_remove_repeats(spark, crowded):
    draw = random.Random(5)
    base = ["".join(draw.choice("abcdé ") for _ in range(150)) for _ in range(6)]
    texts = [None, "", base[0], base[0], "a" * 60, "ab" * 3000]
    for _ in range(100):
        letters = list(draw.choice(base))
        for _ in range(draw.randint(0, 8)):
            letters[draw.randrange(150)] = draw.choice("xyz")
        at = draw.randrange(100)
        texts.append("".join(letters[at : at + draw.randint(0, 150)]) + draw.choice(["", "ab" * 15]))
    out = dedup.remove_repeats(frame(spark, texts), length=20, anchor=6, crowded=crowded)
    got = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in out.select("row.doc_id", "n_removed", "n_spans", "kept").collect()}
    assert [got[k] for k in range(len(texts))] == brute_removed(texts, 20)
    assert dedup.remove_repeats(frame(spark, [])).count() == 0


def test_long_text_in_pieces(spark, monkeypatch):
    draw = random.Random(6)
    text = "".join(draw.choice("abcdefgh") for _ in range(3000))
    texts = [text + "x" + text[500:1200], "y" + text[2000:2300]]
    import pyarrow as pa

    monkeypatch.setattr(dedup, "PIECE", 256)
    batch = pa.RecordBatch.from_pydict({"text": texts, "text_key": [1, 2]})
    found = pa.Table.from_batches(dedup._candidates(100, 20)(iter([batch]))).to_pydict()
    starts = {k: set() for k in (1, 2)}
    for key, low, high in zip(found["text_key"], found["low"], found["high"]):
        assert not starts[key] & set(range(low, high))
        starts[key] |= set(range(low, high))
    assert [starts[k] for k in (1, 2)] == [set(range(len(t) - 99)) for t in texts]


# ---- op8


def brute_hits(texts, items, width=10):
    def words(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())

    windows = {}
    for item, text in items:
        own = words(text)
        size = min(width, len(own))
        for k in range(len(own) - size + 1 if size else 0):
            windows.setdefault(tuple(own[k : k + size]), set()).add(str(item))
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(own) - size + 1):
                names = windows.get(tuple(own[k : k + size]))
                if names:
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((len(own), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_find_matches(spark, block_bytes):
    texts = sample_texts(count=30)
    draw = random.Random(9)
    items = [(k, " ".join(draw.choice([t for t in texts if t]).split()[a : a + draw.randint(3, 30)])) for k, a in enumerate(range(0, 80, 5))]
    items += [(90, None), (91, "?!"), (92, "one two"), (93, "One."), (0, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_matches(frame(spark, texts), bench, keep=["doc_id", "n_words"], block_bytes=block_bytes).collect()
    got = {r.doc_id: r for r in out}
    want = brute_hits(texts, items)
    assert [(got[k].n_words, got[k].n_hit, sorted(set(got[k]["items"]))) for k in range(len(texts))] == want
    for k, (_, hit, _) in enumerate(want):
        assert got[k].contaminated == (hit > 0)
        own = (texts[k] or "").lower().split()
        by_id = {str(i): (t or "").lower().split() for i, t in items[:16]}
        for m in got[k].matches:
            if m["item"] in by_id and m["item"] != "0":
                assert own[m["word"] : m["word"] + m["length"]] == by_id[m["item"]][m["item_word"] : m["item_word"] + m["length"]]
    kept = decontaminate.decontaminate(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, w in enumerate(want) if not w[1]]
    assert decontaminate.decontaminate(frame(spark, texts), bench.where("false")).count() == len(texts)
    assert decontaminate.find_matches(frame(spark, []), bench).count() == 0


# ---- op9


def test_chat_formatting(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    talk = [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"a{k}") for k in range(11)]
    rows = [(1, k, *t) for k, t in enumerate(talk[:3])] + [(2, k, *t) for k, t in enumerate(talk)] + [(3, k, *t) for k, t in enumerate(talk)]
    rows += [(4, k, *t) for k, t in enumerate(talk[:9])] + [(5, 0, *talk[0]), (5, 1, "assistant", "other"), (6, None, None, None), (None, 0, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.part): (r.n_turns, r.text) for r in chat.render(turns, part=8).collect()}
    line = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert got == {(2, 0): (11, "".join(line(*t) for t in talk[:8])), (2, 1): (11, "".join(line(*t) for t in talk[8:])),
                   (5, 0): (2, line(*talk[0]) + line("assistant", "other")), (6, 0): (1, line("", "")), (None, 0): (1, line("user", ""))}
    assert chat.render(turns.where("false")).count() == 0


# ---- op10


def test_contiguous_shards(spark):
    texts = sample_texts() * 3
    sizes = sharding.document_sizes(frame(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") > 5, F.col("doc_id") % 40)), ["doc_id", "node"])
    out = sharding.contiguous_shards(sizes, "size", ["doc_id"], 7).toPandas()
    assert len(out) == len(texts) and out["size"].sum() == sum(len((t or "").encode()) + 8 for t in texts)
    by_shard = out.groupby("shard")["size"].sum()
    share = out["size"].sum() / 7
    assert (abs(by_shard - share) <= out["size"].max()).all()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    ordered = out.sort_values(["shard", "slot"]).doc_id.fillna(-1).tolist()
    assert ordered == sorted(ordered)
    first = sizes.join(frame(spark, texts).selectExpr("doc_id AS d", "text").where("d = 0"), F.col("text_crc32") == F.crc32("text")).first()
    assert first.text_crc32 == zlib.crc32(texts[0].encode())
    assert sharding.contiguous_shards(sizes.where("false"), "size", ["doc_id"]).count() == 0


def test_signature_never_understates_the_common_shingles(spark):
    """The bitmap bound that stands before the exact overlap must let every pair through that the overlap would."""
    rng = np.random.default_rng(5)
    pool = rng.integers(-(1 << 62), 1 << 62, 900)
    sets = {k: set(rng.choice(pool, size, replace=False).tolist()) for k, size in enumerate((1, 3, 40, 200, 700, 900))}
    rows = spark.createDataFrame([(k, g) for k, s in sets.items() for g in s], "node int, gram bigint")
    signed = rows.groupBy("node").agg(F.count("*").alias("open"), *ngram_join._sign())
    side = F.struct("node", "open", *ngram_join.SIGN)
    met = signed.select(side.alias("h")).crossJoin(signed.select(side.alias("x")))
    got = met.selectExpr("h.node AS a", "x.node AS b", f"{ngram_join._common('h', 'x')} AS most").collect()
    assert len(got) == len(sets) ** 2
    assert all(r["most"] >= len(sets[r["a"]] & sets[r["b"]]) for r in got)
    assert all(r["most"] == len(sets[r["a"]]) for r in got if r["a"] == r["b"])


def test_license_scan_finds_texts_headers_and_wordings(spark):
    read = {p.stem: p.read_text(encoding="utf-8") for p in license_scan.TEXTS.glob("*.txt")}
    wanted = {"MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "Apache-2.0"}
    assert wanted <= set(read)
    cases = [(f"Copyright (c) Some One\n\n{read[k]}\nend", k) for k in sorted(wanted)]
    cases += [("# " + read["MIT"].replace("\n", "\n# ").replace("NONINFRINGEMENT", "NON-INFRINGEMENT"), "MIT"),
              ("// SPDX-License-Identifier: MPL-2.0\n#include <x>", "MPL-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
              ("This is distributed under the MIT license, see there.", "MIT"), ("Shared under CC BY-SA 4.0 by us", "CC-BY-SA-4.0"),
              ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
               "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "GPL-3.0"),
              ("one two three under the terms of a treaty on software and the public", None)]
    found = {}
    for r in license_scan.scan(frame(spark, [t for t, _ in cases])).collect():
        found.setdefault(r.doc_id, set()).add(r.license_id)
    for k, (_, license_id) in enumerate(cases):
        also = {"BSD-2-Clause"} if license_id == "BSD-3-Clause" else set()
        assert found.get(k, set()) == ({license_id} if license_id else set()) | (also & found.get(k, set())), (k, license_id, found.get(k))


def test_license_in_a_very_long_text(spark):
    mit = (license_scan.Path(license_scan.__file__).parent / "license_texts" / "MIT.txt").read_text() if hasattr(license_scan, "Path") else None
    notice = next(iter(license_scan.NOTICES.values()))
    filler = " some license word here the software is granted "
    text = filler * 10_000 + notice + filler * 10_000 + (mit or "")
    got = {r.license_id: r.first_word for r in license_scan.scan(frame(spark, [text, "short"])).collect()}
    assert next(iter(license_scan.NOTICES)) in got and got[next(iter(license_scan.NOTICES))] > 60_000
