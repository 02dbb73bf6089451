"""Quality rules with thresholds that adapt to language and source.

Counts per document are built-in expressions on its words and lines. For every (language, source), every language and
the whole table, mergeable quantile sketches give deciles of four ratios; a document is held against those of its
own group, or of the next larger one where its group is small. A bound lies beyond the outer decile by six times that decile's
distance from the median, so it follows the spread of its group as long as less than a tenth of it is junk; a ratio that does
not spread at all may still differ from the median by a small fixed distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.tables import stored

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
ACCURACY = 10_000
MIN_GROUP = 100
FENCE = 6
TAIL = 0.1
#: Ratio, whether only high values fail, and the distance from the median that is always allowed.
RULES = {
    "word_length": ("word_chars / n_words", 0, 1.0),
    "symbols": ("n_symbols / n_words", 1, 0.2),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1, 0.5),
    "repeats": ("n_repeat_words / n_words", 1, 0.1),
}


def _repeat_words() -> Column:
    """Words in three-word windows found twice or more.

    Each window becomes (64-bit hash, place); sorted, equal windows are neighbours. The places of windows with an equal
    neighbour are united.
    """
    equal = F.expr("""
        filter(zip_with(slice(_codes, 1, size(_codes) - 1), slice(_codes, 2, size(_codes) - 1),
                        (a, b) -> CASE WHEN a.h = b.h THEN named_struct('p', a.i, 'q', b.i) END),
               x -> x IS NOT NULL)""")
    return F.when(F.expr("size(_codes) > 1"), equal)


def base_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and base_failed."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, value.alias("_text")).select(
        *keep, "_text", F.array_remove(F.split("_text", f"{SPACE}+"), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    rows = rows.select(
        *keep, F.size("_words").cast("bigint").alias("n_words"), "_words",
        F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"))
    codes = F.expr("""
        CASE WHEN n_words > 3 THEN sort_array(transform(sequence(0, int(n_words) - 3),
            i -> named_struct('h', xxhash64(_words[i], _words[i + 1], _words[i + 2]), 'i', cast(i as bigint)))) END""")
    rows = rows.withColumn("_codes", codes).drop("_words").withColumn("_equal", _repeat_words()).drop("_codes")
    places = F.array_sort(F.array_distinct(F.concat("_equal.p", "_equal.q")))
    rows = rows.withColumn("_places", F.coalesce(places, F.array().cast("array<bigint>"))).drop("_equal")
    covered = F.expr("""
        aggregate(_places, named_struct('total', 0L, 'end', 0L),
                  (s, p) -> named_struct('total', s.total + p + 3 - greatest(p, s.end), 'end', p + 3), s -> s.total)""")
    rows = rows.withColumn("n_repeat_words", covered).drop("_places")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def thresholds(counted: DataFrame) -> DataFrame:
    """(level, lang, source, rows, <rule>_bound ...) from sketches of the rows that pass the base rules.

    Level 0 is a language and source, 1 a language, 2 everything; null is a group like any other.
    """
    ratios = counted.where("NOT base_failed").select("lang", "source", *(F.expr(r).alias(name) for name, (r, _, _) in RULES.items()))
    sketched = ratios.rollup("lang", "source").agg(F.grouping_id().alias("id"), F.count("*").alias("rows"), *(
        F.percentile_approx(name, [TAIL, 0.5, 1 - TAIL], ACCURACY).alias(name) for name in RULES))
    level = F.when(F.col("id") == 0, 0).when(F.col("id") == 1, 1).otherwise(2)
    bounds = []
    for name, (_, upper_only, slack) in RULES.items():
        low, middle, high = (F.col(name)[k] for k in range(3))
        bounds.append(F.greatest(high + FENCE * (high - middle), middle + slack).alias(f"{name}_high"))
        if not upper_only:
            bounds.append(F.least(low - FENCE * (middle - low), middle - slack).alias(f"{name}_low"))
    return sketched.select(level.alias("level"), "lang", "source", "rows", *bounds)


def judge(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Columns `keep` with the counts, `base_failed` and `kept`.

    Defined results: a null text has no words and fails the base rules; null languages and sources are groups of their
    own; repeated rows are judged each for itself; values equal to a bound are kept; texts of any length are counted whole; an
    empty table gives no rows; kept columns named like a count or verdict are replaced by it.
    """
    results = {"n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}
    keep = [c for c in keep if c not in results]
    inner = docs.select(F.struct(*keep).alias("row"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = stored(base_counts(inner, ["row", "lang", "source"]))
    bounds = stored(thresholds(counted))
    ids = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    names = [c for c in bounds.columns if c not in ("level", "lang", "source", "rows")]
    out = counted
    for number, keys in enumerate((["lang", "source"], ["lang"], [])):
        level = bounds.where((F.col("level") == number) & ((F.col("rows") >= MIN_GROUP) | (F.lit(number) == 2)))
        level = level.select(*(F.col(k).alias(f"_{k}") for k in keys), F.struct(*names).alias(f"bounds{number}"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = (out.join(level, same, "left") if keys else out.join(F.broadcast(level), how="left")).drop(*(f"_{k}" for k in keys))
    out = out.withColumn("bounds", F.coalesce("bounds0", "bounds1", "bounds2"))
    within = F.lit(True)
    for name, (ratio, upper_only, _) in RULES.items():
        value = F.expr(ratio)
        within = within & (value <= F.col(f"bounds.{name}_high"))
        if not upper_only:
            within = within & (value >= F.col(f"bounds.{name}_low"))
    kept = F.when(F.col("base_failed"), False).otherwise(F.coalesce(within, F.lit(False)))
    return out.select("row.*", *ids, kept.alias("kept"))
