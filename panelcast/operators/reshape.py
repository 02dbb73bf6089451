"""Selection, completion and reshaping of panels (long and wide)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import all_of, hour_ts
from panelcast.operators.index import global_position

SHARD_SIZE = 1000

# Hub and load-zone names that belong to every node catalog.
HUB_ZONE_NODES = (
    "HB_BUSAVG", "HB_HOUSTON", "HB_HUBAVG", "HB_NORTH", "HB_SOUTH", "HB_WEST",
    "LZ_AEN", "LZ_CPS", "LZ_HOUSTON", "LZ_LCRA", "LZ_NORTH", "LZ_RAYBN", "LZ_SOUTH", "LZ_WEST",
)

# Which weather zones make up a load zone.
ACTUAL_ZONE_MAP = {
    "west": ["FAR_WEST", "WEST"],
    "north": ["EAST", "NORTH", "NORTH_C"],
    "south": ["SOUTHERN", "SOUTH_C"],
    "houston": ["COAST"],
}
FORECAST_ZONE_MAP = {
    "west": ["FarWest", "West"],
    "north": ["East", "North", "NorthCentral"],
    "south": ["SouthCentral", "Southern"],
    "houston": ["Coast"],
}


# --- filters and projections -------------------------------------------------------------

def select_nodes(df: DataFrame, nodes: str | Sequence[str], node: str = "node") -> DataFrame:
    names = [nodes] if isinstance(nodes, str) else list(nodes)
    return df.filter(F.col(node).isin(names))


def between_exclusive(df: DataFrame, start: str | dt.date, end: str | dt.date, on: str = "delivery_date",
                      hour_ending: bool = False) -> DataFrame:
    """Rows dated strictly after ``start`` and strictly before ``end`` (dates, padded or not).

    On a timestamp column every hour of either date is left out; with ``hour_ending`` a
    timestamp is the end of its hour, so midnight belongs to the day before. The bounds
    are written as plain comparisons so that they reach the scan.
    """
    kind = df.schema[on].dataType
    first = F.date_add(F.lit(str(start)).cast("date"), 1).cast(kind)
    if hour_ending:
        return df.filter((F.col(on) > first) & (F.col(on) <= F.lit(str(end)).cast("date").cast(kind)))
    return df.filter((F.col(on) >= first) & (F.col(on) < F.lit(str(end)).cast("date").cast(kind)))


def drop_any_zero(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(all_of([F.col(c) != 0 for c in cols]))


def rollup_zones(df: DataFrame, mapping: Mapping[str, Sequence[str]] = ACTUAL_ZONE_MAP,
                 keys: Sequence[str] = ("delivery_date", "hour_ending")) -> DataFrame:
    zones = [reduce(lambda a, b: a + b, [F.col(p) for p in parts]).alias(zone) for zone, parts in mapping.items()]
    return df.select(*keys, *zones)


def fill_null(df: DataFrame, value: float = 0.0, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.coalesce(F.col(col).cast("double"), F.lit(float(value))))


def to_hour_ts(df: DataFrame, mode: str = "hour_ending", date: str = "delivery_date",
               hour: str = "hour_ending", out: str = "ts") -> DataFrame:
    return df.withColumn(out, hour_ts(F.col(date), F.col(hour), mode))


def to_panel(prices: DataFrame, mode: str = "hour_ending") -> DataFrame:
    """Raw long prices to ``(series_id, ts, value)``; a repeated hour is averaged."""
    stamped = to_hour_ts(prices, mode)
    return (stamped.filter(F.col("node").isNotNull() & F.col("ts").isNotNull())
            .groupBy(F.col("node").alias("series_id"), "ts").agg(F.avg("price").alias("value")))


def to_csv_line(wide: DataFrame, null_text: str = "null") -> DataFrame:
    """One text line per row, columns in order, NULL written as ``null_text``."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(null_text)) for c in wide.columns]
    return wide.select(F.concat_ws(",", *cells).alias("line"))


def ordered_output(df: DataFrame, *order: str) -> DataFrame:
    return df.orderBy(*(order or ("delivery_date", "hour_ending")))


def pick_nth(df: DataFrame, order_cols: Sequence[str], n: int) -> DataFrame:
    """The row at 0-based place ``n`` of the given order; each task keeps at most ``n + 1`` rows."""
    return df.orderBy(*order_cols).offset(n).limit(1)


# --- node catalog and shards -------------------------------------------------------------

def node_catalog(panel: DataFrame, extra_nodes: Sequence[str] = (), node: str = "series_id") -> DataFrame:
    """Distinct names of a long panel together with a list of extra names."""
    spark = panel.sparkSession
    names = panel.select(F.col(node).cast("string").alias("node"), F.lit("node").alias("kind"))
    if extra_nodes:
        extra = spark.createDataFrame([(x, "extra") for x in extra_nodes], "node string, kind string")
        names = names.unionByName(extra)
    return names.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min("kind").alias("kind"))


def wide_catalog(wide: DataFrame, keys: Sequence[str] = ("delivery_date", "hour_ending"),
                 extra_nodes: Sequence[str] = ()) -> DataFrame:
    """Column names of a wide table without its keys, together with extra names."""
    names = [(c, "node") for c in wide.columns if c not in keys] + [(x, "extra") for x in extra_nodes]
    listed = wide.sparkSession.createDataFrame(names, "node string, kind string")
    return listed.groupBy("node").agg(F.max("kind").alias("kind"))


def node_counts(df: DataFrame, node: str = "series_id") -> DataFrame:
    return df.groupBy(F.col(node).alias("node")).agg(F.count(F.lit(1)).alias("n"))


def assign_shards(catalog: DataFrame, size: int = SHARD_SIZE) -> DataFrame:
    """Blocks of ``size`` names in name order: ``(node, shard)``."""
    ranked = global_position(catalog.select("node"), ["node"])
    return ranked.select("node", F.floor(F.col("rank") / size).cast("int").alias("shard"))


def shard_map(shards: DataFrame) -> DataFrame:
    """``(shard, nodes)``, each list sorted and no longer than the shard size."""
    return shards.groupBy("shard").agg(F.sort_array(F.collect_list("node")).alias("nodes"))


def filter_shard(df: DataFrame, shards: DataFrame, shard: int, node: str = "series_id") -> DataFrame:
    """Panel rows whose node belongs to one shard (at most a shard size of names)."""
    members = shards.filter(F.col("shard") == shard).select(F.col("node").alias(node))
    return df.join(members, node, "left_semi")


# --- hours: completion and completeness --------------------------------------------------

def complete_panel(df: DataFrame, shards: DataFrame, series: str = "series_id", time: str = "ts",
                   value: str = "value") -> DataFrame:
    """Adds NULL cells so that every hour a shard has any row for lists all nodes of the shard.

    The panel is read and grouped once, by ``(shard, hour)``. A group is no longer than the shard, whose name list
    then tells which cells are absent. Rows of nodes outside the shards are left out; a repeated cell stays repeated.
    """
    cells = _full_cells(df, shards, series, time, value).select(time, F.explode("cells").alias("_cell"))
    return cells.select(F.col("_cell.node").alias(series), time, F.col("_cell.price").alias(value))


def _full_cells(df: DataFrame, shards: DataFrame, series: str, time: str, value: str) -> DataFrame:
    """``(shard, ts, cells)``: the ``(node, price)`` pairs of every hour of a shard, absent nodes with a NULL price."""
    given = collect_hour(df.select(series, time, value), series, time, value, shards)
    absent = F.transform(F.array_except("nodes", F.col("cells.node")), lambda name: F.struct(
        name.alias("node"), F.lit(None).cast(df.schema[value].dataType).alias("price")))
    return given.join(shard_map(shards), "shard").select("shard", time, F.concat("cells", absent).alias("cells"))


def complete_hours(df: DataFrame, shards: DataFrame, series: str = "series_id", time: str = "ts") -> DataFrame:
    """Rows of hours for which every shard has at least one row."""
    pairs = df.join(shards.withColumnRenamed("node", series), series).select(time, "shard").distinct()
    wanted = shards.select(F.countDistinct("shard")).scalar()
    full = pairs.groupBy(time).agg(F.count(F.lit(1)).alias("_shards")).filter(F.col("_shards") == wanted)
    return df.join(full.select(time), time, "left_semi")


def join_shards(tables: Sequence[DataFrame], keys: Sequence[str] = ("delivery_date", "hour_ending")) -> DataFrame:
    """Inner equi-join of wide shard tables on the hour."""
    return reduce(lambda a, b: a.join(b, list(keys), "inner"), tables)


# --- long to wide ------------------------------------------------------------------------

def collect_hour(df: DataFrame, series: str = "series_id", time: str = "ts", value: str = "value",
                 shards: DataFrame | None = None) -> DataFrame:
    """``(ts, [shard,] cells)``: the hour's ``(node, price)`` pairs sorted by node.

    With ``shards`` a list holds one shard's nodes only, which bounds its length.
    """
    keys = [time]
    if shards is not None:
        df = df.join(shards.withColumnRenamed("node", series), series)
        keys.append("shard")
    pair = F.struct(F.col(series).alias("node"), F.col(value).alias("price"))
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("cells"))


def cell_prices(cells: Column) -> Column:
    """The prices of collected cells, names dropped."""
    return F.transform(cells, lambda c: c["price"])


def column_names(df: DataFrame, series: str = "series_id", most: int = SHARD_SIZE) -> list[str]:
    """The panel's names in order, for the columns of a wide table; an error beyond ``most``, as then shards are due."""
    names = [r[0] for r in df.select(series).filter(F.col(series).isNotNull()).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} names: write one table per shard")
    return sorted(names)


def pivot_prices(df: DataFrame, values: Sequence[str] | None = None, keys: Sequence[str] = ("ts",), series: str = "series_id",
                 value: str = "value", agg: str = "avg") -> DataFrame:
    """One row per hour, one column per node (listed, or found in the panel), NULL where the hour lacks the node."""
    values = column_names(df, series) if values is None else values
    reducer = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}[agg]
    return df.groupBy(*keys).pivot(series, sorted(values)).agg(reducer(value))


def wide_shard_lines(df: DataFrame, shards: DataFrame, series: str = "series_id", time: str = "ts",
                     value: str = "value", null_text: str = "null") -> DataFrame:
    """``(shard, ts, line)``: the text rows of all wide shard tables in one job.

    A line lists the hour and the prices of the shard's nodes in name order, missing
    ones as ``null_text``, one each: a repeated cell is averaged.
    """
    once = df.groupBy(series, time).agg(F.avg(value).alias(value))
    cells = _full_cells(once, shards, series, time, value)
    texts = F.transform(F.sort_array("cells"), lambda c: F.coalesce(c["price"].cast("string"), F.lit(null_text)))
    hour = F.date_format(time, "yyyy-MM-dd,HH:mm")
    return cells.select("shard", time, F.concat_ws(",", hour, F.array_join(texts, ",")).alias("line"))
