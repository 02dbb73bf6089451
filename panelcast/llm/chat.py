"""Chat formatting after collapsing cumulative snapshots.

A logged conversation often holds an earlier log of itself as its first turns. Each turn gets two hashes of its place
and content; their running sums name the prefix up to that turn. A conversation whose whole name is a prefix of a
longer one is dropped by an anti-join, equal conversations are one, and the others are rendered.

Running sums go over blocks of turns and then over block totals, so a conversation of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.tables import stored

BLOCK = 4096
PART = 1024
HASH_BITS = 40  # sums of 40-bit hashes stay in a long for eight million turns, two of them name a prefix


def _before(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(conv, block, <column>_off ...): sums over the conversation's earlier blocks, and its total of `one`."""
    sums = rows.groupBy("conv", "block").agg(*(F.sum(c).alias(c) for c in columns))
    earlier = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv", "block", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_off") for c in columns),
                       F.sum(columns[0]).over(Window.partitionBy("conv")).alias("total"))


def prefixes(turns: DataFrame) -> DataFrame:
    """Every turn with its place in the conversation, the conversation's length and the name of the prefix it ends."""
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    rows = turns.select(key.alias("conv"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)).withColumn("one", F.lit(1).cast("bigint"))
    in_block = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    numbered = rows.withColumn("in_block", F.row_number().over(in_block)).join(_before(rows, ["one"]), ["conv", "block"])
    numbered = numbered.withColumn("place", F.col("in_block") + F.col("one_off"))
    mask = F.lit((1 << HASH_BITS) - 1)
    hashed = numbered.select("conv", "conv_id", "block", "place", F.col("total").alias("n_turns"), "role", "text", *(
        F.xxhash64(F.lit(seed), "place", "role", "text").bitwiseAND(mask).alias(name) for seed, name in ((1, "h1"), (2, "h2"))))
    to_here = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    summed = hashed.withColumns({f"{c}_in": F.sum(c).over(to_here) for c in ("h1", "h2")})
    named = summed.join(_before(hashed, ["h1", "h2"]).drop("total"), ["conv", "block"])
    return named.select("conv", "conv_id", "place", "n_turns", "role", "text",
                        (F.col("h1_in") + F.col("h1_off")).alias("name1"), (F.col("h2_in") + F.col("h2_off")).alias("name2"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """The turns of conversations that are no proper prefix of another, one of each set of equal ones (smallest id)."""
    named = stored(prefixes(turns))
    name = ["place", "name1", "name2"]
    whole = named.where("place = n_turns").groupBy(*name).agg(F.min(F.struct("conv_id", "conv")).alias("chosen"))
    inner = named.where("place < n_turns").select(*name).distinct()
    kept = whole.join(inner, name, "left_anti").select("chosen.conv")
    return named.join(kept, "conv", "left_semi")


def chatml(role: Column, text: Column) -> Column:
    """One turn in ChatML."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def render(turns: DataFrame, template=chatml, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, text): maximal conversations as text, `part` turns to a row.

    Turns go by number (null first), then role and text; null roles and texts are empty; a repeated row is another
    turn; turns without a conversation id form one conversation of their own; an empty table gives no rows. Other
    columns are not read.
    """
    kept = maximal_conversations(turns)
    rows = kept.withColumn("part", F.floor((F.col("place") - 1) / part).cast("int")).withColumn(
        "line", template(F.col("role"), F.col("text")))
    grouped = rows.groupBy("conv", "conv_id", "part", "n_turns").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("lines"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join("lines.line", "").alias("text"))
