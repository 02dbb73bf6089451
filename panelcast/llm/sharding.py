"""Contiguous shards of equal size in bytes, from global prefix sums.

Rows are sorted by range. Each partition's total and row count, one row per partition, are summed in order; a row's
place is its partition's offset plus a running sum inside the partition. Cutting the places at equal targets gives
the shard. Only sizes and keys are shuffled, never the texts. Rows with one key are split between partitions, as the
order goes on with the row's number in the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.tables import stored

SHARDS = 24
ROW_BYTES = 8


def _running(frame: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """Adds, for each `columns` item, the sum of the rows before."""
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return frame.select("*", *(F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(n) for n, c in columns.items()))


def contiguous_shards(rows: DataFrame, size: str, order: list[str], shards: int = SHARDS) -> DataFrame:
    """The rows with `shard` (0 to shards - 1) and `slot` (0, 1, ... within the shard), in the order of `order`.

    A row goes to the shard that holds the middle of its bytes, so a shard is off its equal share by less than one row.
    Defined results: nulls sort first; rows that tie keep their order in the input; repeated rows are placed each for
    itself; if all sizes are 0, all rows go to shard 0; an empty table gives no rows; input columns named `shard` or
    `slot` are replaced.
    """
    columns = [c for c in rows.columns if c not in ("shard", "slot")]
    numbered = rows.select(*columns).withColumn("_row", F.monotonically_increasing_id()).withColumn("_size", F.col(size).cast("bigint"))
    sort = [*order, "_row"]
    # stored, because evaluating a range partitioning twice may cut it at other places
    placed = stored(numbered.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum("_size").alias("_total"), F.count("*").alias("_rows"))
    offsets = _running(totals, [], ["_part"], {"_bytes_off": "_total", "_rows_off": "_rows"})
    all_bytes = totals.agg(F.sum("_total").alias("_all"))
    local = _running(placed.withColumn("_one", F.lit(1)), ["_part"], sort, {"_bytes_in": "_size", "_rows_in": "_one"})
    # one row per partition of the sort, and a single row: both bounded by the number of partitions
    whole = local.join(F.broadcast(offsets.select("_part", "_bytes_off", "_rows_off")), "_part").join(F.broadcast(all_bytes))
    middle = (F.col("_bytes_off") + F.col("_bytes_in")) * 2 + F.col("_size")
    shard = F.expr(f"least({shards - 1}, ({shards} * _middle) div greatest(2 * _all, 1))").cast("int")
    located = stored(whole.withColumn("_middle", middle).withColumn("shard", shard).select(
        *columns, "shard", (F.col("_rows_off") + F.col("_rows_in")).alias("_place")))
    first = located.groupBy("shard").agg(F.min("_place").alias("_first"))  # one row per shard
    return located.join(F.broadcast(first), "shard").select(*columns, "shard", (F.col("_place") - F.col("_first")).alias("slot"))


def document_sizes(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` with `size` (bytes of the text and of a row) and `text_crc32`; a null text is empty."""
    value = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, (F.octet_length(value) + ROW_BYTES).cast("bigint").alias("size"),
                       F.crc32(F.encode(value, "UTF-8")).alias("text_crc32"))
