"""Analogue panels built from the given tables, each as a DataFrame and as SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.index import global_position
from panelcast.operators.reshape import node_catalog
from panelcast.panel import PANEL, Panel
from panelcast.session import ensure_checkpoint_dir

HOURLY = Panel(step=3_600)
DAILY = Panel(step=86_400)
MONTHLY = Panel(step=28 * 86_400)
# irregular series: measured, and cut into blocks when one outgrows a task
RAW = PANEL
EVENTS = Panel(ties=("event_id",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/panelcast-{uuid.uuid4().hex}/{name}"


def hour_of(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz") + F.make_dt_interval(hours=F.hour(ts))


def stamp(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def nudge(digits: int) -> float:
    """Far above summation noise, far below the rounding step: decides exact ties the same way everywhere."""
    return 10.0 ** -(digits + 4)


def r(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(nudge(digits)), digits)


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly series per event type; some hours are missing."""
    ev = table(spark, sf_dir, "events")
    return (ev.groupBy(F.col("event_type").alias("series_id"), hour_of(F.col("ts")).alias("ts"))
            .agg(F.avg("value").alias("value")))


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular series per event type, one row per event."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "value")


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series per supplier: many nodes, gaps."""
    li = table(spark, sf_dir, "lineitem")
    return (li.groupBy("l_suppkey", F.col("l_shipdate").alias("ts")).agg(F.avg("l_extendedprice").alias("value"))
            .select(F.col("l_suppkey").cast("string").alias("series_id"), "ts", "value"))


def supplier_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node catalog of the supplier series, from the key column alone."""
    return node_catalog(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id")))


def priority_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.groupBy(F.col("o_orderpriority").alias("series_id"), F.col("o_orderdate").alias("ts"))
            .agg(F.sum("o_totalprice").alias("value")))


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws("_", "p_type", "p_brand").alias("label"), "p_size")


def label_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly series per part label: the nodes of the edge list."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_shipdate", "l_extendedprice")
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").cast("timestamp_ntz")
    return (li.join(part_labels(spark, sf_dir).select("p_partkey", "label"), "p_partkey")
            .groupBy(F.col("label").alias("series_id"), month.alias("ts"))
            .agg(F.avg("l_extendedprice").alias("value")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and sink labels per line item, NULL where the part is not of the asked size."""
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    parts = part_labels(spark, sf_dir)
    n_parts = parts.select(F.count(F.lit(1))).scalar()
    src = parts.select(F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") <= 10, F.col("label")).alias("source"))
    snk = parts.select(F.col("p_partkey").alias("_snk"), F.when(F.col("p_size") > 40, F.col("label")).alias("sink"))
    return (li.withColumn("_snk", (F.col("l_partkey") + F.col("l_suppkey")) % n_parts)
            .join(src, "l_partkey").join(snk, "_snk").select("source", "sink"))


def label_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_labels(spark, sf_dir).select(F.col("label").alias("node")).distinct()


def families(names: DataFrame, size: int) -> DataFrame:
    """Every name as a centre with the next ``size - 1`` names in order, going round: ``(center, node, is_center)``."""
    placed = global_position(names.select("node"), ["node"])
    count = placed.select(F.count(F.lit(1))).scalar()
    asked = placed.select(F.col("node").alias("center"), "rank", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("step"))
    asked = asked.filter(F.col("step") < count).select("center", (F.col("step") == 0).alias("is_center"), ((F.col("rank") + F.col("step")) % count).alias("rank"))
    return asked.join(placed, "rank").select("center", "node", "is_center")


def load_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight zone columns per hour, named as in the actual-load file."""
    from panelcast.sources.readers import load_zones
    ev = table(spark, sf_dir, "events")
    hour = hour_of(F.col("ts"))
    sums = [F.coalesce(F.sum(F.when(F.col("user_id") % 8 == k, F.col("value"))), F.lit(0.0)).alias(z)
            for k, z in enumerate(load_zones("actual"))]
    return ev.groupBy(hour.alias("ts")).agg(*sums)


# --- the same as SQL ---------------------------------------------------------------------

EV = """SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM events GROUP BY event_type, date_trunc('hour', ts)"""
RAW_EV = "SELECT event_type AS series_id, ts, value FROM events"
LI = """SELECT CAST(l_suppkey AS VARCHAR) AS series_id, l_shipdate AS ts, avg(l_extendedprice) AS value
  FROM lineitem GROUP BY l_suppkey, l_shipdate"""
ORD = """SELECT o_orderpriority AS series_id, o_orderdate AS ts, sum(o_totalprice) AS value
  FROM orders GROUP BY o_orderpriority, o_orderdate"""
LABELS = "SELECT p_partkey, p_type || '_' || p_brand AS label, p_size FROM part"
LAB = f"""SELECT label AS series_id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS ts, avg(l_extendedprice) AS value
  FROM lineitem JOIN ({LABELS}) ON l_partkey = p_partkey GROUP BY 1, 2"""
EDGES = f"""SELECT CASE WHEN a.p_size <= 10 THEN a.label END AS source, CASE WHEN b.p_size > 40 THEN b.label END AS sink
  FROM (SELECT l_partkey, (l_partkey + l_suppkey) % (SELECT count(*) FROM part) AS snk FROM lineitem)
  JOIN ({LABELS}) a ON l_partkey = a.p_partkey JOIN ({LABELS}) b ON snk = b.p_partkey"""
ZONES = ["COAST", "EAST", "FAR_WEST", "NORTH", "NORTH_C", "SOUTHERN", "SOUTH_C", "WEST"]
LOAD = "SELECT date_trunc('hour', ts) AS ts, " + ", ".join(
    f"coalesce(sum(CASE WHEN user_id % 8 = {k} THEN value END), 0.0) AS {z}" for k, z in enumerate(ZONES)
) + " FROM events GROUP BY date_trunc('hour', ts)"


def sql_r(expr: str, digits: int = 6) -> str:
    """Rounded, with negative zero turned into zero."""
    return f"(round({expr} + {nudge(digits)!r}, {digits}) + CAST(0 AS DOUBLE))"


def sql_stamp(expr: str = "ts") -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


def sql_ix(panel_sql: str, extra: str = "") -> str:
    """The panel with ``pos`` and ``n``."""
    return f"""SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS pos,
  count(*) OVER (PARTITION BY series_id) AS n{extra} FROM ({panel_sql})"""


def sql_families(names: str, size: int) -> str:
    """The families of a query that yields ``node``, with each member's ``place``: the centre first, then by name."""
    ranked = f"SELECT node, row_number() OVER (ORDER BY node) - 1 AS rk, count(*) OVER () AS names FROM ({names})"
    return f"""SELECT a.node AS center, b.node AS node, row_number() OVER (PARTITION BY a.node ORDER BY b.rk <> a.rk, b.node) AS place
      FROM ({ranked}) a CROSS JOIN range(0, {size}) s(j) JOIN ({ranked}) b ON b.rk = (a.rk + j) % a.names WHERE j < a.names"""


def sql_family_rows(panel: str, names: str, size: int) -> str:
    """``(center, ts, x1, x2, ...)`` of the hours that every member has."""
    cells = ", ".join(f"max(CASE WHEN place = {i} THEN value END) AS x{i}" for i in range(1, size + 1))
    full = " AND ".join(f"x{i} IS NOT NULL" for i in range(1, size + 1))
    return f"""SELECT * FROM (SELECT center, ts, {cells} FROM ({sql_families(names, size)}) f JOIN ({panel}) p ON p.series_id = f.node
      GROUP BY center, ts) WHERE {full}"""


EV_NAMES = "SELECT DISTINCT event_type AS node FROM events"
LI_NAMES = "SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS node FROM lineitem"


def sql_scaled(source: str, part: str = "series_id", order: str = "ts") -> str:
    """A panel query with min-max scaling to [1, own max] and the log difference ``v``."""
    return f"""SELECT *, ln(s) - lag(ln(s)) OVER (PARTITION BY {part} ORDER BY {order}) AS v FROM (
  SELECT *, CASE WHEN hi = lo THEN 1.0 ELSE 1.0 + (value - lo) * (hi - 1.0) / (hi - lo) END AS s FROM (
    SELECT *, min(value) OVER (PARTITION BY {part}) AS lo, max(value) OVER (PARTITION BY {part}) AS hi FROM ({source})))"""
