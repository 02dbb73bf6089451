"""License scan: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

Templates are the short notices below and the full texts, headers, wordings and identifiers of `license_templates`.
They are grouped by length in words. For each length, texts are cut into windows of one and a half lengths, each
starting half a length after the one before, so that every occurrence lies whole in some window. Each of `bands`
MinHash values of a window's shingles is a band of its own: a window that holds the needed percentage of a template's
shingles has a Jaccard similarity s of about 0.3 or more with it, and all bands miss it with probability
(1 - s) ** bands, about 1e-5 at worst for 32. What the bands find is verified by exact containment.

Key words of a template are such that without all of them too few of its shingles are left. Every template has up to
three sets of key words, no word in two. Texts, and then windows, without a word of each set cannot hold the template
and are left out before anything is hashed.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.license_templates import TEXTS, templates as standard_templates
from panelcast.llm.tables import stored

WORDS = 5
PERCENT = 80
BANDS = 32
KEY_SETS = 3
LEAST_LIKENESS = 0.3
#: Words of templates that ordinary texts have too; they are key words only where no other is left.
ORDINARY = set("""a all an and any are as at available be by can copy covered do file for found free from has if in is it its may
modify of offered on one or other people provided public published released rights shall shared terms that the this to under
used version want was what with work you your""".split())
BROADCAST_TEMPLATES = 10_000
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

#: Short license notices.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def _shingle_sets(words: list[str], size: int) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def _key_set(shingles: set[tuple[str, ...]], percent: int, taken: set[str]) -> set[str] | None:
    """Words, none of them `taken`, without which less than `percent` of the shingles are left, chosen greedily."""
    left, chosen = set(shingles), set()
    while 100 * len(left) >= percent * len(shingles):
        counts = Counter(w for s in left for w in set(s) if w not in taken)
        if not counts:
            return None
        best = max(counts, key=lambda w: (w not in ORDINARY, counts[w] * len(w) ** 2, w))
        chosen.add(best)
        left = {s for s in left if best not in s}
    return chosen


def key_words(needs: list[tuple[set[tuple[str, ...]], int]]) -> list[str]:
    """Strings of which every text has one that holds enough shingles of any template; a word counts if one is in it."""
    chosen: list[str] = []
    left = [(set(s), len(s), percent) for s, percent in needs]
    while left:
        counts: dict[str, float] = {}
        for shingles, total, _ in left:
            for word, n in Counter(w for s in shingles for w in set(s)).items():
                counts[word] = counts.get(word, 0) + n / total
        best = max(counts, key=lambda w: (w not in ORDINARY, counts[w] * min(len(w), 7), w))
        chosen.append(best)
        left = [({s for s in shingles if not any(best in w for w in s)}, total, percent) for shingles, total, percent in left]
        left = [(shingles, total, percent) for shingles, total, percent in left if 100 * len(shingles) >= percent * total]
    return sorted(chosen)


def _shingles(words: str, size: str) -> str:
    return (f"transform(sequence(0, size({words}) - {size}), i -> array_join(slice({words}, i + 1, {size}), ' '))")


def _bands(shingles: str, bands: int) -> str:
    values = [f"array_min(transform({shingles}, s -> xxhash64({k}, s)))" for k in range(bands)]
    return f"array({', '.join(values)})"


def _classes(lengths: list[tuple[int, int, int, bool]]) -> list[int]:
    """Window class of each template (words, shingles, percent, whether of its own length only): a length in words.

    A shorter template shares the windows of a longer one while it is at least LEAST_LIKENESS like a window.
    """
    own = sorted({n for n, _, _, exact in lengths if exact})
    out, current = [0] * len(lengths), 0
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k][0]):
        n, total, percent, exact = lengths[k]
        found = -(-percent * total // 100)
        fits = current and n >= WORDS and found >= LEAST_LIKENESS * (current + (current + 1) // 2 - WORDS + total - found)
        if n in own:
            out[k] = n
        else:
            current = out[k] = current if fits else n
    return out


def _literal(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def scan(docs: DataFrame, notices: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text",
         percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """(doc_id, license_id, n_windows, n_shingles, n_found, first_word): the licenses found in each text.

    n_found is the most template shingles found in one window, first_word the first such window's first word. Of
    several templates of a license the one with the most shingles found is given. `notices` given are the only
    templates. Defined results: null and wordless texts hold nothing and give no row; a template of fewer than five
    words is one shingle; repeated rows (equal id and text) give one result; an empty table gives no rows; other
    columns are not read. Licenses of one wording are all found. A text of any length is cut into windows within its row, in
    time that grows with its length.
    """
    spark: SparkSession = docs.sparkSession
    listed = [(k, tuple(template_words(v)), percent, True) for k, v in (NOTICES if notices is None else notices).items()]
    if notices is None:
        known = {(k, w) for k, w, _, _ in listed}
        more = dict.fromkeys((k, tuple(template_words(v)), p, False) for k, v, p in standard_templates())
        listed += [t for t in more if t[:2] not in known]
    listed = [t for t in listed if t[1]]
    schema = "doc_id bigint, license_id string, n_windows bigint, n_shingles bigint, n_found bigint, first_word bigint"
    if not listed:
        return spark.createDataFrame([], schema)
    needs = [(_shingle_sets(list(w), min(WORDS, len(w))), p) for _, w, p, _ in listed]
    classes = _classes([(len(w), len(s), p, exact) for (_, w, _, exact), (s, p) in zip(listed, needs)])
    # a word's letters must be in the text, so a text without them is safely left out
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), lower.alias("_text")).where(
        reduce(or_, (F.col("_text").contains(k) for k in key_words(needs))))
    rows = stored(rows.select("doc_id", F.xxhash64("_text").alias("text_key"),
                              F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("words")))
    groups = []
    for length in sorted(set(classes)):
        sets: list[set[str]] = [set() for _ in range(KEY_SETS)]
        few = KEY_SETS
        for (shingles, p), own in zip(needs, classes):
            if own == length:
                taken: set[str] = set()
                for k in range(few):
                    chosen = _key_set(shingles, p, taken)
                    if chosen is None:
                        few = k
                        break
                    sets[k] |= chosen
                    taken |= chosen
        groups.append(f"named_struct('length', {length}, 'size', {min(WORDS, length)}, 'stride', {(length + 1) // 2}, "
                      f"'keys', array({', '.join(map(_literal, sets[:few]))}))")

    def may_hold(words: str) -> str:
        return f"size({words}) >= c.size AND forall(c.keys, k -> arrays_overlap({words}, k))"

    classed = rows.select("*", F.explode(F.expr(f"array({', '.join(groups)})")).alias("c")).where(may_hold("words"))
    # windows are cut before they become rows: no row but the text's own ever holds all its words
    cut = F.explode(F.expr("transform(sequence(0, greatest(size(words) - c.size, 0), c.stride), "
                           "at -> named_struct('at', at, 'w', slice(words, at + 1, c.length + c.stride - 1)))"))
    windows = classed.select("doc_id", "text_key", "c", cut.alias("x")).select(
        "doc_id", "text_key", "c", "x.at", "x.w").where(may_hold("w"))
    windows = windows.select("doc_id", "text_key", F.col("c.length").alias("length"), "at", F.expr(_shingles("w", "c.size")).alias("shingles"))
    signed = windows.select("*", F.posexplode(F.expr(_bands("shingles", bands))).alias("band", "value"))
    own = [(k, name, length, p, sorted(map(" ".join, s)))
           for k, ((name, _, _, _), (s, p), length) in enumerate(zip(listed, needs, classes))]
    templates = stored(spark.createDataFrame(own, "number int, license_id string, length int, percent int, template array<string>"))
    template_bands = templates.select("number", "length", F.posexplode(F.expr(_bands("template", bands))).alias("band", "value"))
    templates = templates.select("number", "license_id", "percent", "template", F.size("template").cast("bigint").alias("n_shingles"))
    if len(own) <= BROADCAST_TEMPLATES:  # a checked size; beyond it the join is left to Spark
        template_bands, templates = F.broadcast(template_bands), F.broadcast(templates)
    hits = signed.join(template_bands, ["length", "band", "value"]).dropDuplicates(["doc_id", "text_key", "length", "at", "number"])
    matches = hits.join(templates, "number").withColumn("n_found", F.size(F.array_intersect("template", "shingles")).cast("bigint"))
    verified = matches.where("100 * n_found >= percent * n_shingles")
    by_template = verified.groupBy("doc_id", "text_key", "license_id", "number").agg(
        F.count("*").alias("n_windows"), F.first("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"),
        F.min("at").cast("bigint").alias("first_word"))
    best = F.max(F.struct("n_found", (-F.col("number")).alias("order"), "n_windows", "n_shingles", "first_word")).alias("best")
    return by_template.groupBy("doc_id", "text_key", "license_id").agg(best).select(
        "doc_id", "license_id", "best.n_windows", "best.n_shingles", "best.n_found", "best.first_word")
