"""Helpers on DataFrames shared by the operators: stored tables, bounded membership filters, column names."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.session import ensure_checkpoint_dir

FILTER_BITS = 24
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 2 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BROADCAST_LIMITS = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder; Spark removes them when nothing refers to them."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Jobs run inside send rows to Python in Arrow batches of about `size` bytes, not 10,000 texts of any length.

    A task holds a batch on both sides, and while it grows twice. The session's own limit comes back at the end, so
    what is lazy follows the limit of the time it runs.
    """
    before = spark.conf.get(BATCH_LIMIT, None)
    spark.conf.set(BATCH_LIMIT, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_LIMIT)
        else:
            spark.conf.set(BATCH_LIMIT, before)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside delete their shuffle files at once, not when the driver happens to collect its garbage.

    For operators of many jobs whose results are stored: what a stored table was made from is never read again. The
    session's own setting comes back at the end; versions of Spark without the setting keep the files as before.
    """
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def joins_by_shuffle(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside join by shuffles only, unless a table is marked for broadcast.

    For operators of many small joins: each side that Spark broadcasts because it happens to be small is a job of its own and
    goes through the driver in arrays of 1 to 4 MB, however few its rows. Such arrays in quick succession make the driver's heap
    grow by half a time and again. The session's own limits come back at the end.
    """
    before = {key: spark.conf.get(key, None) for key in BROADCAST_LIMITS}
    for key in BROADCAST_LIMITS:
        spark.conf.set(key, "-1")
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage now, with the files and broadcasts that nothing refers to, and gives heap back.

    For operators of many stages: each stage is sent out in an array of 4 MB, which the collector meets by more heap, not by
    emptying the old part of it.
    """
    spark._jvm.System.gc()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def maybe_in(df: DataFrame, key: str, members: DataFrame, flag: str, bits: int = FILTER_BITS) -> DataFrame:
    """Adds `flag`: false only for rows whose `key` is surely not in `members`.

    The filter is a bitmap of 2**bits bits (2 MB for 24) however many members there are, so it can be broadcast at
    any size; with very many members it lets more rows through, and the exact join that follows does the work. Its rows
    hold 256 words each: a row for each word would be five times as large for the driver, which collects and hashes them.
    """
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    words = members.where(F.col(key).isNotNull()).select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(_slot & 63))")).alias("_bits"))
    bitmap = words.groupBy(F.shiftright("_cell", 8).alias("_block")).agg(F.expr(
        "map_from_entries(collect_list(struct(int(_cell & 255), _bits)))").alias("_set")).selectExpr(
        "_block", "transform(sequence(0, 255), k -> coalesce(_set[k], 0L)) AS _words")
    out = df.withColumn("_block", F.shiftright(slot, 14)).join(F.broadcast(bitmap), "_block", "left")
    name = quoted(key)
    bit = F.expr(f"shiftright(get(_words, int(shiftright({name}, 6) & 255)), int({name} & 63)) & 1")
    return out.withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop("_block", "_words")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_long(hashes):
    """The bits of unsigned hashes as Spark's signed longs."""
    return hashes.view("int64")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder; what is written there goes when the session ends."""
    top = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return top


#: For rows of a megabyte and more: row groups of about 8 MB, measured every few rows, so that neither writer nor reader holds
#: a hundred such rows at a time.
WIDE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}


def written(df: DataFrame, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows as a Parquet table at `path`."""
    df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table of `shared_folder` that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
