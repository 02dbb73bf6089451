"""Shards, joins on the hour, pivots, ordering and edge-list lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import graph as G
from panelcast.operators import reshape as R
from panelcast.plans.datasets import neighborhood_matrix, query_prices, train_test_rows
from panelcast.sources.writers import materialize_splits
from suite.registry import query
from suite.tables import (EDGES, EV, LAB, LABELS, LI, MONTHLY, ORD, edges, events_hourly, label_catalog,
                          label_monthly, priority_daily, r, scratch, sql_r, sql_stamp, stamp, supplier_daily, supplier_names, table)

_SHARDS = """SELECT node, (row_number() OVER (ORDER BY node) - 1) // {size} AS shard
  FROM (SELECT DISTINCT series_id AS node FROM ({panel}))"""
_LI_SHARDS = _SHARDS.format(size=25, panel=LI)
_EV_SHARDS = _SHARDS.format(size=2, panel=EV)


def _supplier_shards(spark, sf_dir):
    return R.assign_shards(supplier_names(spark, sf_dir), 25)


@query("shard_filter", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', 4)} AS value FROM ({LI})
  WHERE series_id IN (SELECT node FROM ({_LI_SHARDS}) WHERE shard = 1)""")
def shard_filter(spark, sf_dir):
    panel = supplier_daily(spark, sf_dir)
    kept = R.filter_shard(panel, _supplier_shards(spark, sf_dir), 1)
    return kept.select("series_id", stamp("ts").alias("ts"), r("value", 4).alias("value"))


@query("shard_join", f"""
  WITH p AS ({EV}), s AS ({_EV_SHARDS}),
    full_ts AS (SELECT ts FROM p JOIN s ON series_id = node GROUP BY ts HAVING count(DISTINCT shard) = (SELECT count(DISTINCT shard) FROM s))
  SELECT {sql_stamp()} AS ts, {sql_r('COLUMNS(* EXCLUDE (ts))')}
  FROM (PIVOT (SELECT * FROM p WHERE ts IN (SELECT ts FROM full_ts)) ON series_id USING avg(value) GROUP BY ts)""")
def shard_join(spark, sf_dir):
    panel = events_hourly(spark, sf_dir)
    names = R.column_names(panel)
    tables = [R.pivot_prices(R.select_nodes(panel, names[k : k + 2], "series_id"), names[k : k + 2]) for k in range(0, len(names), 2)]
    joined = R.join_shards(tables, ["ts"])
    return joined.select(stamp("ts").alias("ts"), *[r(n).alias(n) for n in names])


def _complete_hours_sql(panel, shards, digits):
    return f"""WITH p AS ({panel}), s AS ({shards}),
      full_ts AS (SELECT ts FROM p JOIN s ON series_id = node GROUP BY ts
        HAVING count(DISTINCT shard) = (SELECT count(DISTINCT shard) FROM s))
      SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', digits)} AS value FROM p WHERE ts IN (SELECT ts FROM full_ts)"""


@query("complete_hours_events", _complete_hours_sql(EV, _EV_SHARDS, 6))
def complete_hours_events(spark, sf_dir):
    panel = events_hourly(spark, sf_dir)
    return R.complete_hours(panel, R.assign_shards(R.node_catalog(panel), 2)).select("series_id", stamp("ts").alias("ts"), r("value").alias("value"))


@query("complete_hours_suppliers", _complete_hours_sql(LI, _LI_SHARDS, 4))
def complete_hours_suppliers(spark, sf_dir):
    panel = supplier_daily(spark, sf_dir)
    return R.complete_hours(panel, _supplier_shards(spark, sf_dir)).select(
        "series_id", stamp("ts").alias("ts"), r("value", 4).alias("value"))


@query("query_prices", f"""WITH p AS ({EV}), s AS ({_EV_SHARDS}),
  ranged AS (SELECT * FROM p WHERE CAST(ts AS DATE) > DATE '2024-01-03' AND CAST(ts AS DATE) < DATE '2024-01-25'),
  full_ts AS (SELECT ts FROM ranged JOIN s ON series_id = node GROUP BY ts
    HAVING count(DISTINCT shard) = (SELECT count(DISTINCT shard) FROM s))
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('coalesce(value, 0.0)')} AS value FROM ranged
  WHERE ts IN (SELECT ts FROM full_ts) AND series_id IN ('click', 'view')""")
def query_prices_between(spark, sf_dir):
    panel = events_hourly(spark, sf_dir)
    shards = R.assign_shards(R.node_catalog(panel), 2)
    rows = query_prices(panel, ["click", "view"], "2024-1-3", "2024-1-25", shards)
    return rows.select("series_id", stamp("ts").alias("ts"), r("value").alias("value"))


@query("query_prices_hour_ending", f"""
  SELECT event_type AS series_id, {sql_stamp("date_trunc('hour', ts) + INTERVAL 1 HOUR")} AS ts, {sql_r('avg(value)')} AS value
  FROM events WHERE event_type IN ('click', 'view') AND CAST(ts AS DATE) > DATE '2024-01-03' AND CAST(ts AS DATE) < DATE '2024-01-25'
  GROUP BY event_type, date_trunc('hour', ts)""")
def query_prices_hour_ending(spark, sf_dir):
    """Delivery date and labels 1 to 24, as the price reader gives them."""
    events = table(spark, sf_dir, "events")
    raw = events.select(F.to_date("ts").alias("delivery_date"), (F.hour("ts") + 1).alias("hour_ending"),
                        F.col("event_type").alias("node"), F.col("value").alias("price"))
    rows = query_prices(R.to_panel(raw), ["click", "view"], "2024-1-3", "2024-1-25", hour_ending=True)
    return rows.select("series_id", stamp("ts").alias("ts"), r("value").alias("value"))


@query("complete_panel", f"""
  WITH p AS ({LI}), s AS ({_LI_SHARDS}),
  hours AS (SELECT DISTINCT ts, shard FROM p JOIN s ON series_id = node)
  SELECT node AS series_id, {sql_stamp('hours.ts')} AS ts, {sql_r('p.value', 4)} AS value
  FROM hours JOIN s ON hours.shard = s.shard LEFT JOIN p ON p.ts = hours.ts AND p.series_id = node""")
def complete_panel(spark, sf_dir):
    panel = supplier_daily(spark, sf_dir)
    full = R.complete_panel(panel, _supplier_shards(spark, sf_dir))
    return full.select("series_id", stamp("ts").alias("ts"), r("value", 4).alias("value"))


@query("node_counts", f"SELECT series_id AS node, count(*) AS n FROM ({LI}) GROUP BY series_id")
def node_counts(spark, sf_dir):
    return R.node_counts(supplier_daily(spark, sf_dir))


@query("collect_hour", f"""
  SELECT {sql_stamp()} AS ts, shard, count(*) AS n, string_agg(series_id, ',' ORDER BY series_id) AS nodes,
    {sql_r('sum(value)', 3)} AS total
  FROM ({LI}) JOIN ({_LI_SHARDS}) ON series_id = node GROUP BY ts, shard""")
def collect_hour(spark, sf_dir):
    panel = supplier_daily(spark, sf_dir)
    cells = R.collect_hour(panel, shards=_supplier_shards(spark, sf_dir))
    prices = R.cell_prices(F.col("cells"))
    return cells.select(stamp("ts").alias("ts"), F.col("shard").cast("bigint").alias("shard"),
                        F.size("cells").cast("bigint").alias("n"), F.array_join(F.col("cells.node"), ",").alias("nodes"),
                        r(F.aggregate(prices, F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("pivot_prices", f"""
  SELECT {sql_stamp()} AS ts, {sql_r('COLUMNS(* EXCLUDE (ts))')} FROM (PIVOT ({EV}) ON series_id USING avg(value) GROUP BY ts)""")
def pivot_prices(spark, sf_dir):
    wide = R.pivot_prices(events_hourly(spark, sf_dir))
    return wide.select(stamp("ts").alias("ts"), *[r(n).alias(n) for n in wide.columns[1:]])


@query("ordered_output", f"SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', 2)} AS value FROM ({ORD}) ORDER BY ts, series_id")
def ordered_output(spark, sf_dir):
    rows = priority_daily(spark, sf_dir)
    return R.ordered_output(rows, "ts", "series_id").select("series_id", stamp("ts").alias("ts"), r("value", 2).alias("value"))


_BOTH = "SELECT source AS node FROM e WHERE source IS NOT NULL INTERSECT SELECT sink FROM e WHERE sink IS NOT NULL"
_PREFIX = "regexp_extract({}, '^(.*)_', 1)"


@query("sources_and_sinks", f"WITH e AS ({EDGES}) {_BOTH}")
def sources_and_sinks(spark, sf_dir):
    return G.sources_and_sinks(edges(spark, sf_dir))


@query("pick_nth", f"WITH e AS ({EDGES}), b AS ({_BOTH}) SELECT node FROM b ORDER BY node LIMIT 1 OFFSET 5")
def pick_nth(spark, sf_dir):
    return R.pick_nth(G.sources_and_sinks(edges(spark, sf_dir)), ["node"], 5)


_CATALOG = f"SELECT DISTINCT label AS node FROM ({LABELS})"


@query("prefix_matches", f"""
  WITH c AS ({_CATALOG}), pre AS (SELECT DISTINCT {_PREFIX.format('node')} AS prefix FROM c)
  SELECT prefix, node FROM c JOIN pre ON contains(node, prefix) WHERE prefix <> ''""")
def prefix_matches(spark, sf_dir):
    from panelcast.functions.columns import name_prefix
    catalog = label_catalog(spark, sf_dir)
    return G.expand_by_prefix(catalog, catalog.select(name_prefix(F.col("node")).alias("prefix")))


_NEIGHBORS = f"""WITH e AS ({EDGES}), b AS ({_BOTH}), c AS ({_CATALOG}),
  fam AS (SELECT b.node AS center, c.node AS node FROM b JOIN c ON {_PREFIX.format('b.node')} <> ''
    AND contains(c.node, {_PREFIX.format('b.node')}) AND c.node <> b.node),
  nb AS (SELECT node AS center, node, true AS is_center FROM c UNION ALL SELECT center, node, false FROM fam)"""


@query("neighbors", f"{_NEIGHBORS} SELECT center, node, is_center FROM nb")
def neighbors(spark, sf_dir):
    catalog = label_catalog(spark, sf_dir)
    return G.neighbors(edges(spark, sf_dir), catalog, catalog.withColumnRenamed("node", "center"))


@query("crr_nodes", f"{_NEIGHBORS} SELECT DISTINCT c.node FROM b JOIN c ON {_PREFIX.format('b.node')} <> '' AND contains(c.node, {_PREFIX.format('b.node')})")
def crr_nodes(spark, sf_dir):
    return G.crr_nodes(edges(spark, sf_dir), label_catalog(spark, sf_dir))


def _neighborhoods(spark, sf_dir):
    catalog = label_catalog(spark, sf_dir)
    return G.neighbors(edges(spark, sf_dir), catalog, catalog.withColumnRenamed("node", "center"))


@query("neighbor_panel", f"""{_NEIGHBORS}, p AS ({LAB})
  SELECT center, node, is_center, count(*) AS n, {sql_r('sum(value)', 3)} AS total, min({sql_stamp()}) AS first_ts
  FROM nb JOIN p ON node = series_id GROUP BY center, node, is_center""")
def neighbor_panel(spark, sf_dir):
    rows = G.neighbor_panel(label_monthly(spark, sf_dir), _neighborhoods(spark, sf_dir))
    return rows.groupBy("center", "node", "is_center").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total"), F.min(stamp("ts")).alias("first_ts"))


@query("center_series", f"""{_NEIGHBORS}, p AS ({LAB})
  SELECT center, {sql_stamp()} AS ts, {sql_r('value', 4)} AS value FROM nb JOIN p ON node = series_id WHERE is_center""")
def center_series(spark, sf_dir):
    rows = G.neighbor_panel(label_monthly(spark, sf_dir), _neighborhoods(spark, sf_dir)).filter("is_center")
    return rows.select("center", stamp("ts").alias("ts"), r("value", 4).alias("value"))


_MATRIX = f"""{_NEIGHBORS}, p AS ({LAB}),
  h AS (SELECT DISTINCT center, ts FROM nb JOIN p ON node = series_id),
  m AS (SELECT h.center, h.ts, nb.node, nb.is_center, coalesce(p.value, 0.0) AS value FROM h JOIN nb ON h.center = nb.center
    LEFT JOIN p ON p.series_id = nb.node AND p.ts = h.ts)"""


@query("neighbor_matrix", f"""{_MATRIX}
  SELECT center, {sql_stamp()} AS ts, count(*) AS members, {sql_r('max(CASE WHEN is_center THEN value END)', 4)} AS center_value,
    {sql_r('sum(value)', 3)} AS total FROM m GROUP BY center, ts""")
def neighbor_matrix(spark, sf_dir):
    catalog = label_catalog(spark, sf_dir)
    matrix = neighborhood_matrix(label_monthly(spark, sf_dir), edges(spark, sf_dir), catalog,
                                 catalog.withColumnRenamed("node", "center"), fill=0.0)
    return matrix.select("center", stamp("ts").alias("ts"), F.size("values").cast("bigint").alias("members"),
                         r(F.col("values")[0], 4).alias("center_value"),
                         r(F.aggregate("values", F.lit(0.0), lambda a, v: a + v), 3).alias("total"))


@query("train_test_rows", f"""{_MATRIX},
  t AS (SELECT *, row_number() OVER (PARTITION BY center, node ORDER BY ts) AS pos, count(*) OVER (PARTITION BY center, node) AS n,
    dense_rank() OVER (PARTITION BY center ORDER BY CASE WHEN is_center THEN 0 ELSE 1 END, node) - 1 AS member FROM m)
  SELECT center, member, split, count(*) AS n, {sql_r('sum(value)', 3)} AS total, max({sql_stamp()}) AS last_ts
  FROM (SELECT *, CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split FROM t)
  GROUP BY center, member, split""")
def train_test(spark, sf_dir):
    catalog = label_catalog(spark, sf_dir)
    matrix = neighborhood_matrix(label_monthly(spark, sf_dir), edges(spark, sf_dir), catalog,
                                 catalog.withColumnRenamed("node", "center"), fill=0.0)
    rows = train_test_rows(matrix, 0.8, MONTHLY.with_keys("center").with_value("values"))
    stored = materialize_splits(rows, scratch(spark, "splits"))
    return stored.groupBy("center", F.col("member").cast("bigint").alias("member"), "split").agg(
        F.count(F.lit(1)).alias("n"), r(F.sum("value"), 3).alias("total"), F.max(stamp("ts")).alias("last_ts"))
