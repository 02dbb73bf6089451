"""Scans, sinks, filters and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import reshape as R
from panelcast.sources import readers, writers
from suite.registry import query
from suite.tables import (EV, LABELS, LI, LOAD, ORD, events_hourly, load_hours, part_labels,
                          priority_daily, r, scratch, sql_r, sql_stamp, stamp, supplier_daily, supplier_names, table)


def _hour_label(df: DataFrame) -> DataFrame:
    """Timestamps as date plus hour-ending label 1..24 (midnight closes the day before)."""
    moved = F.col("ts") - F.make_dt_interval(hours=F.lit(1))
    return df.withColumn("delivery_date", moved.cast("date")).withColumn("hour_ending", F.hour(moved) + 1)


def _price_lines(spark, sf_dir: str) -> list[str]:
    """Two price files with header lines, one per half of the days, as the raw feed has them."""
    peaks = _hour_label(events_hourly(spark, sf_dir).withColumn("value", r("value", 3)))
    line = F.concat_ws(",", F.col("delivery_date").cast("string"),
                       F.concat(F.lpad(F.col("hour_ending").cast("string"), 2, "0"), F.lit(":00")),
                       "series_id", F.col("value").cast("string"))
    header = spark.createDataFrame([("DeliveryDate,HourEnding,BusName,LMP",)], "line string")
    paths = []
    for half in (0, 1):
        path = scratch(spark, f"prices_{half}")
        body = peaks.filter(F.dayofmonth("delivery_date") % 2 == half).select(line.alias("line"))
        header.unionByName(body).write.text(path)
        paths.append(path)
    return paths


@query("price_files_scan", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', 3)} AS value FROM ({EV})""")
def price_files_scan(spark, sf_dir):
    prices = readers.read_prices(spark, _price_lines(spark, sf_dir))
    return R.to_panel(prices).select("series_id", stamp("ts").alias("ts"), r("value", 3).alias("value"))


@query("yearly_union", f"""
  SELECT yr, count(*) AS n, {sql_r('sum(value)', 2)} AS total FROM (
    SELECT *, year(ts) AS yr FROM ({ORD}) WHERE year(ts) <= 1997
    UNION ALL SELECT *, year(ts) AS yr FROM ({ORD}) WHERE year(ts) > 1997) GROUP BY yr""")
def yearly_union(spark, sf_dir):
    panel = priority_daily(spark, sf_dir).withColumn("yr", F.year("ts"))
    parts = [panel.filter("yr <= 1997"), panel.filter("yr > 1997")]
    union = reduce(lambda a, b: a.unionByName(b), parts)
    return union.groupBy(F.col("yr").cast("bigint").alias("yr")).agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 2).alias("total"))


@query("stored_panel_scan", f"""
  SELECT series_id, count(*) AS n, min({sql_stamp()}) AS first_ts, {sql_r('sum(value)', 2)} AS total
  FROM ({LI}) GROUP BY series_id""")
def stored_panel_scan(spark, sf_dir):
    path = scratch(spark, "panel")
    writers.write_panel(supplier_daily(spark, sf_dir), path)
    return readers.load_panel(spark, path).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(stamp("ts")).alias("first_ts"), r(F.sum("value"), 2).alias("total"))


@query("node_catalog", f"""
  SELECT node, min(kind) AS kind FROM (
    SELECT series_id AS node, 'node' AS kind FROM ({LI})
    UNION ALL SELECT unnest([{', '.join(f"'{n}'" for n in R.HUB_ZONE_NODES)}]), 'extra')
  GROUP BY node""")
def node_catalog(spark, sf_dir):
    return R.node_catalog(supplier_daily(spark, sf_dir), R.HUB_ZONE_NODES)


@query("wide_catalog", "SELECT DISTINCT event_type AS node, 'node' AS kind FROM events")
def wide_catalog(spark, sf_dir):
    """The columns of a stored wide table, which were made from the names in the data."""
    panel = events_hourly(spark, sf_dir)
    names = [row["node"] for row in R.node_catalog(panel).collect()]  # they become columns
    path = scratch(spark, "wide_table")
    R.pivot_prices(panel, names).write.parquet(path)
    return R.wide_catalog(spark.read.parquet(path), ("ts",))


@query("catalog_file", f"SELECT DISTINCT label AS node FROM ({LABELS})")
def catalog_file(spark, sf_dir):
    path = scratch(spark, "names")
    writers.write_catalog(part_labels(spark, sf_dir).select(F.col("label").alias("node")).distinct(), path)
    return spark.read.text(path).withColumnRenamed("value", "node")


@query("unpivot_prices", f"""
  SELECT {sql_stamp('h.ts')} AS ts, c.series_id AS node, {sql_r('p.value')} AS price
  FROM (SELECT DISTINCT ts FROM ({EV})) h CROSS JOIN (SELECT DISTINCT series_id FROM ({EV})) c
  LEFT JOIN ({EV}) p ON p.ts = h.ts AND p.series_id = c.series_id""")
def unpivot_prices(spark, sf_dir):
    wide = R.pivot_prices(events_hourly(spark, sf_dir))
    return readers.unpivot_prices(wide, ["ts"]).select(stamp("ts").alias("ts"), "node", r("price").alias("price"))


@query("wide_csv_lines", """
  WITH p AS (SELECT date_trunc('hour', ts) AS ts, event_type, max(value) AS value FROM events GROUP BY 1, 2)
  SELECT strftime(h.ts, '%Y-%m-%d %H:%M:%S') || ',' || string_agg(coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY c.event_type) AS line
  FROM (SELECT DISTINCT ts FROM p) h CROSS JOIN (SELECT DISTINCT event_type FROM p) c LEFT JOIN p ON p.ts = h.ts AND p.event_type = c.event_type
  GROUP BY h.ts""")
def wide_csv_lines(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series_id"), F.date_format("ts", "yyyy-MM-dd HH:00:00").alias("ts"), "value")
    wide = R.pivot_prices(ev, agg="max")
    path = scratch(spark, "wide")
    writers.write_wide(wide, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("wide_shard_lines", f"""
  WITH p AS (SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_shipdate AS ts, max(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2),
  s AS (SELECT node, (row_number() OVER (ORDER BY node) - 1) // 25 AS shard FROM (SELECT DISTINCT series_id AS node FROM p)),
  h AS (SELECT DISTINCT ts, shard FROM p JOIN s ON series_id = node)
  SELECT h.shard, strftime(h.ts, '%Y-%m-%d,%H:%M') || ',' || string_agg(coalesce(CAST(value AS VARCHAR), 'null'), ',' ORDER BY node) AS line
  FROM h JOIN s ON h.shard = s.shard LEFT JOIN p ON p.ts = h.ts AND series_id = node GROUP BY h.shard, h.ts""")
def wide_shard_lines(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    top = (li.groupBy("l_suppkey", F.col("l_shipdate").alias("ts")).agg(F.max("l_extendedprice").alias("value"))
           .select(F.col("l_suppkey").cast("string").alias("series_id"), "ts", "value"))
    path = scratch(spark, "shard_tables")
    writers.write_wide_shards(R.wide_shard_lines(top, R.assign_shards(supplier_names(spark, sf_dir), 25)), path)
    stored = spark.read.schema("value string, shard bigint").text(path)
    return stored.select("shard", F.col("value").alias("line"))


@query("shard_lists", f"""
  SELECT shard, count(*) AS n, string_agg(node, ',' ORDER BY node) AS nodes FROM (
    SELECT node, (row_number() OVER (ORDER BY node) - 1) // 25 AS shard
    FROM (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS node FROM lineitem)) GROUP BY shard""")
def shard_lists(spark, sf_dir):
    shards = R.assign_shards(supplier_names(spark, sf_dir), 25)
    return R.shard_map(shards).select(F.col("shard").cast("bigint").alias("shard"),
                                      F.size("nodes").cast("bigint").alias("n"), F.array_join("nodes", ",").alias("nodes"))


@query("shard_map_json", f"""
  SELECT 'table' || shard AS tab, count(*) AS n, string_agg(label, ',' ORDER BY label) AS nodes FROM (
    SELECT label, (row_number() OVER (ORDER BY label) - 1) // 40 AS shard FROM (SELECT DISTINCT label FROM ({LABELS})))
  GROUP BY shard""")
def shard_map_json(spark, sf_dir):
    names = part_labels(spark, sf_dir).select(F.col("label").alias("node")).distinct()
    path = scratch(spark, "shards")
    writers.write_shard_map(R.assign_shards(names, 40), path)
    parsed = spark.read.text(path).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return parsed.select(F.explode("m").alias("tab", "nodes")).select(
        "tab", F.size("nodes").cast("bigint").alias("n"), F.array_join("nodes", ",").alias("nodes"))


@query("select_nodes", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', 4)} AS value FROM ({LI}) WHERE series_id IN ('1', '3', '5')""")
def select_nodes(spark, sf_dir):
    picked = R.select_nodes(supplier_daily(spark, sf_dir), ["1", "3", "5"], "series_id")
    return picked.select("series_id", stamp("ts").alias("ts"), r("value", 4).alias("value"))


@query("date_range_exclusive", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', 2)} AS value FROM ({ORD})
  WHERE ts > TIMESTAMP '1997-01-31' AND ts < TIMESTAMP '1999-05-23'""")
def date_range_exclusive(spark, sf_dir):
    kept = R.between_exclusive(priority_daily(spark, sf_dir), "1997-1-31", "1999-5-23", on="ts")
    return kept.select("series_id", stamp("ts").alias("ts"), r("value", 2).alias("value"))


@query("drop_any_zero", f"SELECT {sql_stamp()} AS ts, {sql_r('COAST + WEST', 4)} AS edge FROM ({LOAD}) WHERE "
       + " AND ".join(f"{z} <> 0" for z in readers.load_zones()))
def drop_any_zero(spark, sf_dir):
    kept = R.drop_any_zero(load_hours(spark, sf_dir), readers.load_zones())
    return kept.select(stamp("ts").alias("ts"), r(F.col("COAST") + F.col("WEST"), 4).alias("edge"))


_ROLLUP = ", ".join(f"{sql_r(' + '.join(parts), 4)} AS {zone}" for zone, parts in R.ACTUAL_ZONE_MAP.items())


@query("zone_rollup", f"SELECT {sql_stamp()} AS ts, {_ROLLUP} FROM ({LOAD})")
def zone_rollup(spark, sf_dir):
    rolled = R.rollup_zones(load_hours(spark, sf_dir), keys=("ts",))
    return rolled.select(stamp("ts").alias("ts"), *[r(z, 4).alias(z) for z in R.ACTUAL_ZONE_MAP])


@query("load_file_rollup", f"SELECT {sql_stamp()} AS ts, {_ROLLUP} FROM ({LOAD}) WHERE "
       + " AND ".join(f"{sql_r(z, 4)} <> 0" for z in readers.load_zones()))
def load_file_rollup(spark, sf_dir):
    zones = readers.load_zones()
    hours = _hour_label(load_hours(spark, sf_dir))
    total = reduce(lambda a, b: a + b, [F.col(z) for z in zones])
    line = F.concat_ws(",", F.col("delivery_date").cast("string"),
                       F.concat(F.col("hour_ending").cast("string"), F.lit(":00")),
                       *[r(z, 4).cast("string") for z in zones], r(total, 4).cast("string"), F.lit("N"))
    header = spark.createDataFrame([(",".join(readers.LOAD_HEADERS["actual"]),)], "line string")
    path = scratch(spark, "load")
    header.unionByName(hours.select(line.alias("line"))).write.text(path)
    kept = R.drop_any_zero(readers.read_load(spark, path), zones)
    rolled = R.to_hour_ts(R.rollup_zones(kept, R.ACTUAL_ZONE_MAP))
    return rolled.select(stamp("ts").alias("ts"), *[r(z, 4).alias(z) for z in R.ACTUAL_ZONE_MAP])


@query("fill_null", f"""
  SELECT {sql_stamp('h.ts')} AS ts, c.series_id AS node, {sql_r('coalesce(p.value, 0.0)')} AS price
  FROM (SELECT DISTINCT ts FROM ({EV})) h CROSS JOIN (SELECT DISTINCT series_id FROM ({EV})) c
  LEFT JOIN ({EV}) p ON p.ts = h.ts AND p.series_id = c.series_id""")
def fill_null(spark, sf_dir):
    wide = R.pivot_prices(events_hourly(spark, sf_dir))
    filled = R.fill_null(readers.unpivot_prices(wide, ["ts"]), 0.0, "price")
    return filled.select(stamp("ts").alias("ts"), "node", r("price").alias("price"))


@query("hour_ending_timestamps", f"""
  SELECT series_id, d AS delivery_date, h AS hour_ending, strftime(CAST(d AS TIMESTAMP) + to_hours(h), '%Y-%m-%d %H:%M:%S') AS ts,
    strftime(CAST(d AS TIMESTAMP) + to_hours(h % 24), '%Y-%m-%d %H:%M:%S') AS compat_ts
  FROM (SELECT series_id, CAST(ts - INTERVAL 1 HOUR AS DATE) AS d, hour(ts - INTERVAL 1 HOUR) + 1 AS h FROM ({EV}))""")
def hour_ending_timestamps(spark, sf_dir):
    labelled = _hour_label(events_hourly(spark, sf_dir)).drop("ts")
    both = R.to_hour_ts(R.to_hour_ts(labelled), "compat", out="compat_ts")
    return both.select("series_id", "delivery_date", F.col("hour_ending").cast("bigint").alias("hour_ending"),
                       stamp("ts").alias("ts"), stamp("compat_ts").alias("compat_ts"))
