"""Positions, differences, lags, windows, splits, scaling, calendars and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelcast.operators import metrics as M
from panelcast.operators import scale as SC
from panelcast.operators import series as S
from panelcast.operators.index import index_panel
from panelcast.plans.datasets import train_test_lists, train_test_panel
from suite.registry import query
from suite.tables import (DAILY, EV, EVENTS, HOURLY, LI, LI_NAMES, ORD, RAW, RAW_EV, events_hourly, events_raw, families, priority_daily, r,
                          sql_family_rows, sql_ix, sql_r, sql_scaled, sql_stamp, stamp, supplier_daily, supplier_names)

_W = "(PARTITION BY series_id ORDER BY ts)"


def _out(df, *cols):
    return df.select("series_id", stamp("ts").alias("ts"), *cols)


# --- positions and splits ----------------------------------------------------------------

@query("panel_positions", f"SELECT series_id, {sql_stamp()} AS ts, pos, n FROM ({sql_ix(LI)})")
def panel_positions(spark, sf_dir):
    return _out(index_panel(supplier_daily(spark, sf_dir), DAILY), "pos", "n")


@query("event_positions", """
  SELECT event_type AS series_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos,
    count(*) OVER (PARTITION BY event_type) AS n FROM events""")
def event_positions(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series_id"), "event_id", "ts")
    return index_panel(ev, EVENTS).select("series_id", "event_id", "pos", "n")


def _split_sql(panel, digits):
    return f"""SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', digits)} AS value,
      CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split FROM ({sql_ix(panel)})"""


@query("chrono_split", _split_sql(LI, 4))
def chrono_split(spark, sf_dir):
    return _out(S.chrono_split(supplier_daily(spark, sf_dir), 0.8, DAILY), r("value", 4).alias("value"), "split")


@query("chrono_split_raw_events", f"""
  SELECT series_id, event_id, {sql_stamp()} AS ts, {sql_r('value')} AS value, CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split
  FROM (SELECT event_type AS series_id, event_id, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos,
    count(*) OVER (PARTITION BY event_type) AS n FROM events)""")
def chrono_split_raw(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("series_id"), "event_id", "ts", "value")
    return _out(S.chrono_split(ev, 0.8, EVENTS), "event_id", r("value").alias("value"), "split")


@query("three_way_split", f"""
  SELECT series_id, split, count(*) AS n, min({sql_stamp()}) AS first_ts FROM (
    SELECT *, CASE WHEN pos > floor(CAST(0.8 AS DOUBLE) * n) THEN 'test'
      WHEN pos > floor(CAST(0.8 AS DOUBLE) * floor(CAST(0.8 AS DOUBLE) * n)) THEN 'val' ELSE 'train' END AS split
    FROM ({sql_ix(EV)})) GROUP BY series_id, split""")
def three_way_split(spark, sf_dir):
    split = S.chrono_split(events_hourly(spark, sf_dir), 0.8, HOURLY, inner=0.8)
    return split.groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min(stamp("ts")).alias("first_ts"))


@query("train_test_normalized", f"""
  SELECT series_id, split, {sql_stamp()} AS ts, {sql_r('(value - mean) / sd')} AS value, {sql_r('(h - mh) / sh')} AS hour,
    {sql_r('coalesce((m - mm) / nullif(sm, 0), m - mm)')} AS month, {sql_r('(d - md) / sd2')} AS weekday FROM (
    SELECT *, avg(value) FILTER (WHERE split = 'train') OVER s AS mean, stddev_pop(value) FILTER (WHERE split = 'train') OVER s AS sd,
      avg(h) FILTER (WHERE split = 'train') OVER s AS mh, stddev_pop(h) FILTER (WHERE split = 'train') OVER s AS sh,
      avg(m) FILTER (WHERE split = 'train') OVER s AS mm, stddev_pop(m) FILTER (WHERE split = 'train') OVER s AS sm,
      avg(d) FILTER (WHERE split = 'train') OVER s AS md, stddev_pop(d) FILTER (WHERE split = 'train') OVER s AS sd2
    FROM (SELECT *, hour(ts) AS h, month(ts) AS m, isodow(ts) - 1 AS d,
      CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split FROM ({sql_ix(EV)}))
    WINDOW s AS (PARTITION BY series_id))""")
def train_test_normalized(spark, sf_dir):
    rows = train_test_panel(events_hourly(spark, sf_dir), normalize=True, include_calendar=True, panel=HOURLY)
    return rows.select("series_id", "split", stamp("ts").alias("ts"), *[r(c).alias(c) for c in ("value", "hour", "month", "weekday")])


@query("train_test_log_differences", f"""
  SELECT series_id, split, {sql_stamp()} AS ts, pos - 1 AS pos, {sql_r('v')} AS value FROM (
    SELECT *, ln(value) - lag(ln(value)) OVER (PARTITION BY series_id, split ORDER BY ts) AS v,
      row_number() OVER (PARTITION BY series_id, split ORDER BY ts) AS pos
    FROM (SELECT * EXCLUDE (pos), CASE WHEN pos <= floor(CAST(0.8 AS DOUBLE) * n) THEN 'train' ELSE 'test' END AS split
      FROM ({sql_ix(ORD)}))) WHERE pos > 1""")
def train_test_log_differences(spark, sf_dir):
    rows = train_test_panel(priority_daily(spark, sf_dir), log_differences=True, panel=DAILY)
    return rows.select("series_id", "split", stamp("ts").alias("ts"), F.col("pos").cast("bigint").alias("pos"), r("value").alias("value"))


# one cut at the hours that all members of a list have
_LISTS = f"""SELECT *, row_number() OVER (PARTITION BY center ORDER BY ts) AS rn, count(*) OVER (PARTITION BY center) AS cnt
  FROM ({sql_family_rows(LI, LI_NAMES, 3)})"""
_LIST_ROWS = " UNION ALL ".join(
    f"""SELECT center, {i - 1} AS member, ts, x{i} AS value, CASE WHEN rn <= floor(CAST(0.8 AS DOUBLE) * cnt) THEN 'train' ELSE 'test' END AS split
  FROM ({_LISTS})""" for i in (1, 2, 3))


def _z_sql(c: str) -> str:
    return (f"({c} - avg({c}) FILTER (WHERE split = 'train') OVER s) / "
            f"coalesce(nullif(stddev_pop({c}) FILTER (WHERE split = 'train') OVER s, 0), 1)")


@query("train_test_lists_normalized", f"""
  SELECT center, member, split, {sql_stamp()} AS ts, {', '.join(f"{sql_r(c)} AS {c}" for c in ("value", "month", "weekday"))} FROM (
    SELECT center, member, split, ts, {_z_sql('value')} AS value, {_z_sql('m')} AS month, {_z_sql('d')} AS weekday
    FROM (SELECT *, month(ts) AS m, isodow(ts) - 1 AS d FROM ({_LIST_ROWS})) WINDOW s AS (PARTITION BY center, member))""")
def train_test_lists_normalized(spark, sf_dir):
    rows = train_test_lists(supplier_daily(spark, sf_dir), families(supplier_names(spark, sf_dir), 3), normalize=True, include_calendar=True,
                            panel=DAILY)
    return rows.select("center", "member", "split", stamp("ts").alias("ts"), *[r(c).alias(c) for c in ("value", "month", "weekday")])


@query("train_test_lists_log_differences", f"""
  SELECT center, member, split, {sql_stamp()} AS ts, pos - 1 AS pos, {sql_r('v')} AS value FROM (
    SELECT *, ln(value) - lag(ln(value)) OVER w AS v, row_number() OVER w AS pos FROM ({_LIST_ROWS})
    WINDOW w AS (PARTITION BY center, member, split ORDER BY ts)) WHERE pos > 1""")
def train_test_lists_log_differences(spark, sf_dir):
    rows = train_test_lists(supplier_daily(spark, sf_dir), families(supplier_names(spark, sf_dir), 3), log_differences=True, panel=DAILY)
    return rows.select("center", "member", "split", stamp("ts").alias("ts"), F.col("pos").cast("bigint").alias("pos"), r("value").alias("value"))


# --- differences -------------------------------------------------------------------------

def _difference_sql(panel, lag, digits):
    return f"""SELECT series_id, {sql_stamp()} AS ts, {sql_r('v', digits)} AS v FROM (
      SELECT *, value - lag(value, {lag}) OVER {_W} AS v FROM ({sql_ix(panel)})) WHERE pos > {lag}"""


@query("difference_lag24", _difference_sql(EV, 24, 6))
def difference_lag24(spark, sf_dir):
    return _out(S.difference(events_hourly(spark, sf_dir), 24, HOURLY), r("value").alias("v"))


@query("difference_raw_events", f"""
  SELECT series_id, count(*) AS n, {sql_r('sum(abs(v))', 3)} AS total_abs, {sql_r('max(v)')} AS top FROM (
    SELECT *, value - lag(value, 2) OVER {_W} AS v FROM ({sql_ix(RAW_EV)})) WHERE pos > 2 GROUP BY series_id""")
def difference_raw(spark, sf_dir):
    diff = S.difference(events_raw(spark, sf_dir), 2, RAW)
    return diff.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.abs("value")), 3).alias("total_abs"),
                                         r(F.max("value")).alias("top"))


@query("undifference", f"SELECT series_id, {sql_stamp()} AS ts, {sql_r('value', 2)} AS value FROM ({sql_ix(ORD)}) WHERE pos > 7")
def undifference(spark, sf_dir):
    panel = index_panel(priority_daily(spark, sf_dir), DAILY)
    back = S.undifference(panel, S.difference(panel, 7, DAILY), 7, DAILY)
    return _out(back, r("value", 2).alias("value"))


@query("log_difference", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('v')} AS v FROM (
    SELECT *, ln(value) - lag(ln(value)) OVER {_W} AS v FROM ({sql_ix(EV)})) WHERE pos > 1""")
def log_difference(spark, sf_dir):
    return _out(S.log_difference(events_hourly(spark, sf_dir), HOURLY), r("value").alias("v"))


@query("nonpositive_counts", f"""
  SELECT series_id, count(*) FILTER (WHERE NOT v > 0) AS n_nonpositive FROM (
    SELECT *, value - lag(value) OVER {_W} AS v FROM ({EV})) WHERE v IS NOT NULL GROUP BY series_id""")
def nonpositive_counts(spark, sf_dir):
    return S.nonpositive_counts(S.difference(events_hourly(spark, sf_dir), 1, HOURLY), HOURLY)


# --- scaling -----------------------------------------------------------------------------

@query("minmax_stats", f"""
  SELECT series_id, {sql_r('min(value)')} AS low, {sql_r('max(value)')} AS high, {sql_r('max(max(value)) OVER ()')} AS upper
  FROM ({EV}) GROUP BY series_id""")
def minmax_stats(spark, sf_dir):
    stats = SC.minmax_stats(events_hourly(spark, sf_dir), panel=HOURLY)
    return stats.select("series_id", *[r(c).alias(c) for c in ("low", "high", "upper")])


@query("minmax_scale_plus_one", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('1.0 + (value - lo) * hi / (hi - lo)', 4)} AS scaled FROM (
    SELECT *, min(value) OVER (PARTITION BY series_id) AS lo, max(value) OVER (PARTITION BY series_id) AS hi FROM ({ORD}))""")
def minmax_scale_plus_one(spark, sf_dir):
    panel = priority_daily(spark, sf_dir)
    scaled = SC.minmax_scale(panel, SC.minmax_stats(panel, "col_max_plus_1", panel=DAILY), DAILY)
    return _out(scaled, r("value", 4).alias("scaled"))


@query("scale_log_difference", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('v')} AS v FROM ({sql_scaled(sql_ix(LI))}) WHERE pos > 1""")
def scale_log_difference(spark, sf_dir):
    out = SC.scale_log_difference(supplier_daily(spark, sf_dir), by=DAILY.keys, panel=DAILY)
    return _out(out, r("value").alias("v"))


_STD = f"""SELECT series_id, avg(value) AS mean, stddev_pop(value) AS sd FROM ({sql_ix(EV)})
  WHERE pos <= floor(CAST(0.8 AS DOUBLE) * n) GROUP BY series_id"""


@query("standard_stats", f"SELECT series_id, {sql_r('mean')} AS mean, {sql_r('sd')} AS sd FROM ({_STD})")
def standard_stats(spark, sf_dir):
    stats = SC.standard_stats(events_hourly(spark, sf_dir), panel=HOURLY)
    return stats.select("series_id", r("mean").alias("mean"), r("sd").alias("sd"))


@query("standardize", f"""SELECT series_id, {sql_stamp()} AS ts, {sql_r('(value - mean) / sd')} AS z
  FROM ({EV}) JOIN ({_STD}) USING (series_id)""")
def standardize(spark, sf_dir):
    panel = index_panel(events_hourly(spark, sf_dir), HOURLY)
    return _out(SC.standardize(panel, SC.standard_stats(panel, panel=HOURLY), HOURLY), r("value").alias("z"))


@query("inverse_log_scale", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('lo + (exp(0.5 * v + ln(past)) - 1.0) * (hi - lo) / (hi - 1.0)')} AS restored FROM (
    SELECT *, lag(s) OVER {_W} AS past FROM ({sql_scaled(EV)})) WHERE v IS NOT NULL""")
def inverse_log_scale(spark, sf_dir):
    panel = index_panel(events_hourly(spark, sf_dir), HOURLY)
    stats = SC.minmax_stats(panel, by=HOURLY.keys, panel=HOURLY)
    diffs = SC.scale_log_difference(panel, by=HOURLY.keys, panel=HOURLY)
    pred = diffs.withColumn("predicted", 0.5 * F.col("value"))
    back = SC.inverse_log_scale(panel, pred, stats, HOURLY)
    return _out(back, r("restored").alias("restored"))


# --- lags and windows --------------------------------------------------------------------

@query("lag_features", f"""
  SELECT series_id, {sql_stamp()} AS ts, {', '.join(f"{sql_r(f'l{k}')} AS lag_{k}" for k in (1, 2, 3))} FROM (
    SELECT *, {', '.join(f'lag(value, {k}) OVER {_W} AS l{k}' for k in (1, 2, 3))} FROM ({sql_ix(EV)})) WHERE pos > 3""")
def lag_features(spark, sf_dir):
    return _out(S.lag_features(events_hourly(spark, sf_dir), 3, HOURLY), *[r(f"lag_{k}").alias(f"lag_{k}") for k in (1, 2, 3)])


@query("lag_dataset", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('l1', 4)} AS lag_1, {sql_r('l2', 4)} AS lag_2, {sql_r('target', 4)} AS target,
    CASE WHEN pos - 3 <= floor(CAST(0.6 AS DOUBLE) * (n - 5)) THEN 'train' ELSE 'test' END AS split FROM (
    SELECT *, lag(value, 1) OVER {_W} AS l1, lag(value, 2) OVER {_W} AS l2, lead(value, 2) OVER {_W} AS target
    FROM ({sql_ix(LI)})) WHERE pos >= 4 AND target IS NOT NULL""")
def lag_dataset(spark, sf_dir):
    data = S.lag_dataset(supplier_daily(spark, sf_dir), 2, 3, DAILY)
    data = data.withColumn("split", S.lag_dataset_split(2, 3, 0.6))
    return _out(data, *[r(c, 4).alias(c) for c in ("lag_1", "lag_2", "target")], "split")


RF, H = S.receptive_field(2, [1, 2, 4, 8], 9), 2


@query("sliding_sequences", f"""
  SELECT series_id, {sql_stamp()} AS ts, {RF} AS width, {sql_r('total', 4)} AS total, {sql_r('first_value')} AS first_value,
    {sql_r('value')} AS last_value, {sql_r('target')} AS target FROM (
    SELECT *, sum(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {RF - 1} PRECEDING AND CURRENT ROW) AS total,
      lag(value, {RF - 1}) OVER {_W} AS first_value, lead(value, {H}) OVER {_W} AS target FROM ({sql_ix(EV)}))
  WHERE pos >= {RF} AND pos + {H} <= n - 1""")
def sliding_sequences(spark, sf_dir):
    seq = S.sliding_sequences(events_hourly(spark, sf_dir), RF, H, HOURLY)
    total = F.aggregate("past", F.lit(0.0), lambda a, v: a + v)
    return _out(seq, F.size("past").alias("width"), r(total, 4).alias("total"), r(F.col("past")[0]).alias("first_value"),
                r(F.col("past")[RF - 1]).alias("last_value"), r("target").alias("target"))


@query("chunk_sequences", f"""
  WITH ix AS ({sql_ix(LI)}),
  c AS (SELECT series_id, (pos - 1) // 20 AS chunk, count(*) AS filled, sum(value) AS total, max_by(value, pos) AS tail FROM ix GROUP BY 1, 2
    UNION ALL SELECT series_id, n // 20, 0, 0.0, 0.0 FROM ix WHERE pos = n AND n % 20 = 0)
  SELECT series_id, chunk, 20 AS size, {sql_r('total', 3)} AS total,
    {sql_r('CASE WHEN filled = 20 THEN tail ELSE 0.0 END', 4)} AS last_value FROM c""")
def chunk_sequences(spark, sf_dir):
    chunks = S.chunk_sequences(supplier_daily(spark, sf_dir), 20, panel=DAILY)
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return chunks.select("series_id", "chunk", F.size("values").alias("size"), r(total, 3).alias("total"),
                         r(F.col("values")[19], 4).alias("last_value"))


@query("dilated_filter", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('y', 4)} AS y FROM (
    SELECT *, 0.25 * lag(value, 8) OVER {_W} + 0.5 * lag(value, 4) OVER {_W} - 0.125 * value AS y FROM ({sql_ix(LI)}))
  WHERE pos > 8""")
def dilated_filter(spark, sf_dir):
    return _out(S.dilated_filter(supplier_daily(spark, sf_dir), [0.25, 0.5, -0.125], 4, DAILY), r("value", 4).alias("y"))


@query("dilated_stack", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('y')} AS y FROM (
    SELECT *, lag(a, 2) OVER {_W} + 3.0 * a AS y FROM (
      SELECT *, 0.5 * lag(value, 1) OVER {_W} + 2.0 * value AS a FROM ({sql_ix(EV)}))) WHERE pos > 3""")
def dilated_stack(spark, sf_dir):
    first = S.dilated_filter(events_hourly(spark, sf_dir), [0.5, 2.0], 1, HOURLY)
    return _out(S.dilated_filter(first, [1.0, 3.0], 2, HOURLY), r("value").alias("y"))


_LAGS = ", ".join(f"lag(value, {k}) OVER {_W} AS l{k}" for k in range(1, 24))
_CORR = " UNION ALL ".join(f"SELECT series_id, {k} AS lag, corr(value, l{k}) AS r FROM x GROUP BY series_id" for k in range(1, 24))


def _autocorrelation_sql(panel):
    return f"WITH x AS (SELECT *, {_LAGS} FROM ({panel})) SELECT series_id, lag, {sql_r('r')} AS r FROM ({_CORR})"


@query("autocorrelation", _autocorrelation_sql(EV))
def autocorrelation(spark, sf_dir):
    return S.autocorrelation(events_hourly(spark, sf_dir), 24, HOURLY).select("series_id", "lag", r("r").alias("r"))


@query("autocorrelation_raw_events", _autocorrelation_sql(RAW_EV))
def autocorrelation_raw(spark, sf_dir):
    return S.autocorrelation(events_raw(spark, sf_dir), 24, RAW).select("series_id", "lag", r("r").alias("r"))


@query("window_mase", f"""
  WITH x AS (SELECT *, abs(value - lag(value) OVER {_W}) AS step, lead(value, 1) OVER {_W} AS target FROM ({sql_ix(EV)})),
  y AS (SELECT *, sum(step) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS steps FROM x),
  z AS (SELECT series_id, abs(target - value) AS e, steps + abs(target - value) AS s FROM y WHERE pos >= 12 AND pos + 1 <= n - 1)
  SELECT series_id, {sql_r('avg(e)')} AS mae, {sql_r('sum(s) / (12 * count(*))')} AS mean_abs_step,
    {sql_r('avg(e) / (sum(s) / (12 * count(*)))')} AS mase FROM z GROUP BY series_id""")
def window_mase(spark, sf_dir):
    seq = S.sliding_sequences(events_hourly(spark, sf_dir), 12, 1, HOURLY)
    scored = S.window_mase(seq.withColumn("predicted", F.col("past")[11]))
    return scored.select("series_id", *[r(c).alias(c) for c in ("mae", "mean_abs_step", "mase")])


@query("companded_histogram", f"""
  WITH v AS (SELECT series_id, least(greatest(v, -1.0), 1.0) AS x FROM ({sql_scaled(EV)}) WHERE v IS NOT NULL),
  b AS (SELECT *, CAST(floor((sign(x) * ln(1 + 255 * abs(x)) / ln(256) + 1) / 2 * 255 + 0.5) AS INTEGER) AS bin FROM v),
  d AS (SELECT *, 2.0 * (CAST(bin AS DOUBLE) / 255) - 1 AS s FROM b)
  SELECT series_id, bin, count(*) AS n,
    {sql_r('avg(abs(x - sign(s) * (pow(CAST(256 AS DOUBLE), abs(s)) - 1) / 255))')} AS mean_abs_error FROM d GROUP BY series_id, bin""")
def companded_histogram(spark, sf_dir):
    diffs = SC.scale_log_difference(events_hourly(spark, sf_dir), by=HOURLY.keys, panel=HOURLY)
    hist = S.companded_histogram(diffs, 256, HOURLY)
    return hist.select("series_id", "bin", "n", r("mean_abs_error").alias("mean_abs_error"))


@query("calendar_features", f"""
  SELECT series_id, {sql_stamp()} AS ts, CAST(hour(ts) AS INTEGER) AS hour, CAST(month(ts) AS INTEGER) AS month,
    CAST(isodow(ts) - 1 AS INTEGER) AS weekday, dayname(ts) AS day_name FROM ({EV})""")
def calendar_features(spark, sf_dir):
    return _out(S.calendar_features(events_hourly(spark, sf_dir)), "hour", "month", "weekday", "day_name")


# --- forecasts and scores ----------------------------------------------------------------

def metrics_sql(source: str, by: str = "series_id", part: str = "series_id", order: str = "ts", horizon: int = 1,
                rounded: bool = True) -> str:
    """Scores of a query that yields ``predicted`` and ``actual``."""
    w = f"(PARTITION BY {part} ORDER BY {order})"
    shown = sql_r if rounded else str
    return f"""SELECT {by}, {shown('avg(abs(predicted - actual))')} AS mae, {shown('avg(naive)')} AS naive_mae,
      {shown('avg(abs(predicted - actual)) / nullif(avg(naive), 0)')} AS mase,
      {shown('avg(CASE WHEN dp * da > 0 THEN abs(predicted) END)')} AS hits,
      {shown('avg(CASE WHEN dp * da > 0 THEN 1.0 WHEN dp * da <= 0 THEN 0.0 END)')} AS hit_rate FROM (
      SELECT *, abs(actual - lag(actual, {horizon}) OVER {w}) AS naive, predicted - lag(predicted) OVER {w} AS dp,
        actual - lag(actual) OVER {w} AS da FROM ({source})) GROUP BY {by}"""


def scores(df, *by):
    return df.select(*by, *[r(c).alias(c) for c in ("mae", "naive_mae", "mase", "hits", "hit_rate")])


def _persistence_sql(panel, horizon=1):
    return f"SELECT *, lag(value, {horizon}) OVER {_W} AS predicted, value AS actual FROM ({panel})"


@query("persistence_forecast", f"SELECT series_id, {sql_stamp()} AS ts, {sql_r('predicted', 2)} AS predicted, "
       f"{sql_r('actual', 2)} AS actual FROM ({_persistence_sql(ORD, 7)})")
def persistence_forecast(spark, sf_dir):
    pred = M.persistence_forecast(priority_daily(spark, sf_dir), 7, DAILY)
    return _out(pred, r("predicted", 2).alias("predicted"), r("actual", 2).alias("actual"))


_TEST_EV = f"SELECT * FROM ({sql_ix(EV)}) WHERE pos > floor(CAST(0.8 AS DOUBLE) * n)"


@query("persistence_scores_events", metrics_sql(_persistence_sql(_TEST_EV)))
def persistence_scores_events(spark, sf_dir):
    test = S.take_split(events_hourly(spark, sf_dir), "test", 0.8, HOURLY)
    return scores(M.forecast_metrics(M.persistence_forecast(test, 1, HOURLY), panel=HOURLY), "series_id")


@query("persistence_scores_suppliers", metrics_sql(_persistence_sql(LI)))
def persistence_scores_suppliers(spark, sf_dir):
    pred = M.persistence_forecast(supplier_daily(spark, sf_dir), 1, DAILY)
    return scores(M.forecast_metrics(pred, panel=DAILY), "series_id")


@query("persistence_scores_raw_events", metrics_sql(_persistence_sql(RAW_EV, 3), horizon=3))
def persistence_scores_raw(spark, sf_dir):
    pred = M.persistence_forecast(events_raw(spark, sf_dir), 3, RAW)
    return scores(M.forecast_metrics(pred, horizon=3, panel=RAW), "series_id")


@query("pooled_scores", metrics_sql(f"SELECT * FROM ({_persistence_sql(EV)})", by="grp").replace(
    "SELECT *, abs(actual", "SELECT *, CASE WHEN series_id < 'f' THEN 'early' ELSE 'late' END AS grp, abs(actual"))
def pooled_scores(spark, sf_dir):
    pred = M.persistence_forecast(events_hourly(spark, sf_dir), 1, HOURLY)
    grouped = pred.withColumn("grp", F.when(F.col("series_id") < "f", "early").otherwise("late"))
    return scores(M.forecast_metrics(grouped, ["grp"], panel=HOURLY), "grp")
