"""Lookups in an ownership edge list: shared endpoints, neighbourhoods, name families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import name_prefix, substrings


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """Labels that occur both as a source and as a sink.

    Both endpoints are aggregated in one pass, so a label on a third of all edges is
    reduced to one row per task before the shuffle.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("source").alias("node"), F.lit(True).alias("out")),
        F.struct(F.col("sink").alias("node"), F.lit(False).alias("out")))).alias("e")).select("e.*")
    return (ends.filter(F.col("node").isNotNull()).groupBy("node")
            .agg(F.bool_or("out").alias("is_source"), F.bool_or(~F.col("out")).alias("is_sink"))
            .filter("is_source and is_sink").select("node"))


def _parts(catalog: DataFrame) -> DataFrame:
    """``(node, prefix)`` for every distinct substring of every name."""
    return catalog.select("node", F.explode(substrings(F.col("node"))).alias("prefix"))


def expand_by_prefix(catalog: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``(prefix, node)`` for every catalog name that contains the prefix anywhere.

    Names are short, so each is expanded to its distinct substrings and matched by
    equality, which hashes instead of testing every pair. Empty prefixes match nothing.
    """
    wanted = prefixes.select("prefix").filter(F.col("prefix") != "").distinct()
    return _parts(catalog).join(wanted, "prefix").select("prefix", "node")


def neighbors(edges: DataFrame, catalog: DataFrame, centers: DataFrame, on_unknown: str = "error") -> DataFrame:
    """``(center, node, is_center)`` for a whole table of centres at once.

    A centre that is both source and sink brings in every catalog name containing the
    text before its last underscore; any other centre stands alone. A centre missing
    from the catalog fails the job, or is left out with ``on_unknown='drop'``.
    """
    asked = centers.select("center").distinct()
    listed = catalog.select(F.col("node").alias("center"), F.lit(True).alias("_known"))
    if on_unknown == "drop":
        known = asked.join(listed, "center").select("center")
    else:
        message = F.concat(F.lit("centre not in the node catalog: "), F.col("center"))
        known = asked.join(listed, "center", "left").select(
            F.when(F.col("_known"), F.col("center")).otherwise(F.raise_error(message).cast("string")).alias("center"))
    shared = sources_and_sinks(edges).withColumnRenamed("node", "center")
    active = known.join(shared, "center").withColumn("prefix", name_prefix(F.col("center"))).filter("prefix <> ''")
    family = _parts(catalog).join(active, "prefix").filter(F.col("node") != F.col("center"))
    others = family.select("center", "node", F.lit(False).alias("is_center"))
    alone = known.select("center", F.col("center").alias("node"), F.lit(True).alias("is_center"))
    return alone.unionByName(others)


def crr_nodes(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog names that contain the prefix of any label that is both source and sink."""
    prefixes = sources_and_sinks(edges).select(name_prefix(F.col("node")).alias("prefix"))
    return expand_by_prefix(catalog, prefixes).select("node").distinct()


def neighbor_panel(df: DataFrame, neighborhood: DataFrame, series: str = "series_id") -> DataFrame:
    """Panel rows of every neighbourhood, ``(center, node, is_center, ts, value)``."""
    return (df.withColumnRenamed(series, "node").join(neighborhood, "node")
            .select("center", "node", "is_center", *[c for c in df.columns if c != series]))
