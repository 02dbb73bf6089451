"""Row positions inside each series, and windows that survive a very long series.

Lags and windows here are positional, so every operator needs the row number of
each observation. Two layouts give the same numbers:

* a panel on an hourly or coarser grid (``panel.bounded``) is windowed per series:
  one shuffle, and no series can exceed about a million rows a century;
* any other panel is measured first. If some series is too long for one task its
  rows are numbered per time bucket (counts per bucket, running sum, local row
  number) and later windows run per block of consecutive positions. A block also
  receives copies of the neighbouring rows its windows reach (the halo), which are
  dropped afterwards, so block edges never show in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.panel import PANEL, Panel
from panelcast.session import stored

# candidate bucket widths in microseconds, widest first: 365 days, 30 days, 1 day, 1 hour, 1 minute,
# then 1 second down to the resolution of a timestamp
BUCKET_TICKS = (31_536_000_000_000, 2_592_000_000_000, 86_400_000_000, 3_600_000_000, 60_000_000,
                1_000_000, 100_000, 10_000, 1_000, 100, 10, 1)
BUCKETS_PER_SPAN = 100_000
SALTS = 32

_BUCKET, _BLOCK, _CORE, _SALT = "_bucket", "_block", "_core", "_salt"


def clock_ticks(df: DataFrame, time: str) -> Column:
    """Microseconds on the column's own clock, never through the session time zone.

    A numeric time column counts in its own units.
    """
    kind = df.schema[time].dataType
    c = F.col(time)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
        if isinstance(kind, T.DateType):
            return days * 86_400_000_000
        minutes = (days * 24 + F.hour(c)) * 60 + F.minute(c)
        return minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return F.floor(c).cast("long")


def _bucket_of(ticks: Column, width: int) -> Column:
    # whole-number arithmetic: a quotient of doubles could round up at a bucket's end
    return (ticks - F.pmod(ticks, F.lit(width).cast("long"))).cast("long")


def measure_bucket(df: DataFrame, panel: Panel = PANEL) -> int | None:
    """A bucket width whose fullest (series, bucket) fits one task; None = whole series fit.

    The finest width is taken where no width fits: rows of one series at one time are then one group, whose sort spills.

    The longest series' size and time span suggest the width, an exact count confirms
    it. Every probe is a count with map-side combine that returns one row.
    """
    timed = df.select(*panel.keys, clock_ticks(df, panel.time).alias("_t"))
    sizes = timed.groupBy(*panel.keys).agg(
        F.count(F.lit(1)).alias("rows"), (F.max("_t") - F.min("_t") + 1).cast("double").alias("span"))
    longest = sizes.agg(F.max("rows").alias("rows"), F.max_by("span", "rows").alias("span")).first()
    if not longest["rows"] or longest["rows"] <= panel.rows_per_task:
        return None
    for width in BUCKET_TICKS:
        if width > 1 and longest["rows"] * width > panel.rows_per_task * longest["span"]:
            continue
        counts = timed.groupBy(*panel.keys, _bucket_of(F.col("_t"), width).alias(_BUCKET)).agg(
            F.count(F.lit(1)).alias("rows"))
        if width == BUCKET_TICKS[-1] or counts.agg(F.max("rows")).first()[0] <= panel.rows_per_task:
            return width


def index_panel(df: DataFrame, panel: Panel = PANEL, bucket_ticks: int | None = None) -> DataFrame:
    """Adds ``pos`` (1-based position in the series) and ``n`` (series length).

    A panel that already carries both is returned as it is, so a chain of operators,
    or a table written with them, is numbered once.
    """
    if {"pos", "n"} <= set(df.columns):
        return df
    keys = list(panel.keys)
    if bucket_ticks is None and not panel.bounded:
        bucket_ticks = measure_bucket(df, panel)
    if bucket_ticks is None:
        w = Window.partitionBy(*keys)
        return df.withColumn("pos", F.row_number().over(w.orderBy(*panel.order)).cast("long")).withColumn(
            "n", F.count(F.lit(1)).over(w))
    bucketed = df.withColumn(_BUCKET, _bucket_of(clock_ticks(df, panel.time), bucket_ticks))
    starts = _bucket_starts(bucketed, keys, bucket_ticks)
    local = Window.partitionBy(*keys, _BUCKET).orderBy(*panel.order)
    numbered = bucketed.withColumn("_local", F.row_number().over(local))
    return (numbered.join(starts, [*keys, _BUCKET])
            .withColumn("pos", F.col("_start") + F.col("_local"))
            .select(*df.columns, "pos", "n"))


def _bucket_starts(bucketed: DataFrame, keys: list[str], width: int) -> DataFrame:
    """``(keys, bucket, _start, n)``: rows of the series before each bucket, and in all.

    Counts are summed along spans of at most ``BUCKETS_PER_SPAN`` buckets, and the spans'
    totals along the series, so that a long series of thin buckets is not one group.
    """
    span = _bucket_of(F.col(_BUCKET), width * BUCKETS_PER_SPAN)
    counts = bucketed.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias("_count")).withColumn("_span", span)

    def running(total: str, w: WindowSpec) -> Column:
        return F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    series = Window.partitionBy(*keys)
    spans = counts.groupBy(*keys, "_span").agg(F.sum("_count").alias("_total")).select(
        *keys, "_span", running("_total", series.orderBy("_span")).alias("_before"), F.sum("_total").over(series).alias("n"))
    inside = counts.withColumn("_inside", running("_count", Window.partitionBy(*keys, "_span").orderBy(_BUCKET)))
    return inside.join(spans, [*keys, "_span"]).select(
        *keys, _BUCKET, (F.col("_before") + F.col("_inside")).alias("_start"), "n")


def windowed(df: DataFrame, panel: Panel = PANEL, before: int = 0, after: int = 0) -> tuple[DataFrame, WindowSpec]:
    """An indexed panel plus the window that reaches ``before`` rows back and ``after`` ahead.

    Finish with :func:`core`, which drops the copied halo rows.
    """
    ix = index_panel(df, panel)
    if panel.bounded:
        return ix, Window.partitionBy(*panel.keys).orderBy("pos" if panel.ties else panel.time)
    first = F.floor((F.greatest(F.col("pos") - after, F.lit(1)) - 1) / panel.block_rows)
    last = F.floor((F.least(F.col("pos") + before, F.col("n")) - 1) / panel.block_rows)
    home = F.floor((F.col("pos") - 1) / panel.block_rows)
    blocks = ix.withColumn(_BLOCK, F.explode(F.sequence(first, last))).withColumn(_CORE, F.col(_BLOCK) == home)
    return blocks, Window.partitionBy(*panel.keys, _BLOCK).orderBy("pos")


def core(df: DataFrame) -> DataFrame:
    return df.filter(_CORE).drop(_CORE, _BLOCK) if _CORE in df.columns else df


def rebase(df: DataFrame, dropped: int | Column) -> DataFrame:
    """Renumbers after the first ``dropped`` rows of every series were removed."""
    return df.withColumn("pos", F.col("pos") - dropped).withColumn("n", F.col("n") - dropped)


def attach(df: DataFrame, stats: DataFrame, panel: Panel = PANEL, how: str = "inner") -> DataFrame:
    """Joins one row of ``stats`` per series onto an indexed panel; ``how='left'`` keeps series without one.

    Small statistics are broadcast by adaptive execution. Where they are not, and
    series are unbounded, the key is salted with the block of positions so that one
    long series is spread over ``SALTS`` tasks.
    """
    keys = list(panel.keys)
    if panel.bounded:
        return df.join(stats, keys, how)
    salted = index_panel(df, panel).withColumn(
        _SALT, F.floor((F.col("pos") - 1) / panel.block_rows) % SALTS)
    copies = stats.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, _SALT], how).drop(_SALT)


def global_position(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``rank``, the 0-based place of each row in the order of unique ``order`` columns.

    A range-partitioned sort numbers the rows of every partition; the counts of the
    partitions before it shift them. The sorted rows are checkpointed because two
    evaluations of a range partitioning may cut it at different places.
    """
    placed = stored(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    local = F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    # one row per partition of the sort, a number the session's settings bound
    sizes = sizes.withColumn("_start", F.coalesce(
        F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = placed.withColumn("_part", part).withColumn("_local", local)
    return (numbered.join(F.broadcast(sizes), "_part")
            .withColumn("rank", F.col("_start") + F.col("_local"))
            .select(*df.columns, "rank"))
