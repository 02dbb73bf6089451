"""Writers: wide tables, the name catalog, shard lists, train/test data, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.reshape import shard_map, to_csv_line


def write_wide(wide: DataFrame, path: str, fmt: str = "csv", null_text: str = "null") -> None:
    """Wide hour rows as Parquet, or as headerless text lines with NULL spelled out."""
    if fmt == "csv":
        to_csv_line(wide, null_text).write.mode("overwrite").text(path)
    else:
        wide.write.mode("overwrite").format(fmt).save(path)


def write_wide_shards(lines: DataFrame, path: str) -> None:
    """The text rows of every shard table, one folder per shard, hours in order within a file."""
    (lines.hint("rebalance", "shard").sortWithinPartitions("shard", "ts").select("shard", "line")
     .write.mode("overwrite").partitionBy("shard").text(path))


def write_panel(df: DataFrame, path: str, series: str = "series_id", time: str = "ts") -> None:
    """A long panel as Parquet, range-partitioned and sorted by series and time.

    Row-group statistics then let a scan for some series or dates skip the rest, and a
    long series is spread over several files.
    """
    df.repartitionByRange(series, time).sortWithinPartitions(series, time).write.mode("overwrite").parquet(path)


def write_catalog(catalog: DataFrame, path: str, single_file: bool = False) -> None:
    """Node names in order. Part files are in order too; ``single_file`` is for small catalogs."""
    names = catalog.select("node").orderBy("node")
    (names.coalesce(1) if single_file else names).write.mode("overwrite").text(path)


def write_shard_map(shards: DataFrame, path: str) -> None:
    """One JSON object ``{"table<i>": [names]}`` per shard."""
    entries = shard_map(shards).select(
        F.to_json(F.create_map(F.concat(F.lit("table"), F.col("shard").cast("string")), F.col("nodes"))))
    entries.write.mode("overwrite").text(path)


def write_report(report: DataFrame, path: str, single_file: bool = False) -> None:
    """Tab-separated report, a header line in every part; ``single_file`` is for short reports."""
    (report.coalesce(1) if single_file else report).write.mode("overwrite").csv(path, sep="\t", header=True, quote="")


def materialize_splits(splits: DataFrame, path: str) -> DataFrame:
    """Stores train/test rows partitioned by centre and split, and reads them back.

    The rebalance keeps the files of a folder few, and splits a folder that is too
    large for one task.
    """
    splits.hint("rebalance", "center", "split").write.mode("overwrite").partitionBy("center", "split").parquet(path)
    return splits.sparkSession.read.schema(splits.schema).parquet(path)
