"""Positions and block windows against plain Python, with one series holding most rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helpers import BLOCKS, GRID, LAYOUTS, by_series, panel_of, skewed
from panelcast.operators import index
from panelcast.operators import metrics as M
from panelcast.operators import scale as SC
from panelcast.operators import series as S
from panelcast.operators.index import (attach, clock_ticks, core, global_position, index_panel, measure_bucket,
                                       windowed)
from panelcast.panel import Panel
from panelcast.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def skew(spark):
    values, hours = skewed()
    return panel_of(spark, values, hours), values


@pytest.mark.parametrize("panel", LAYOUTS)
def test_positions(skew, panel):
    df, values = skew
    got = by_series(index_panel(df, panel), "pos", "n", "value")
    for s, xs in values.items():
        assert got[s] == [(i + 1, len(xs), x) for i, x in enumerate(xs)]


def test_running_counts_cross_spans(skew, monkeypatch):
    df, values = skew
    monkeypatch.setattr(index, "BUCKETS_PER_SPAN", 4)
    got = by_series(index_panel(df, BLOCKS, bucket_ticks=7 * 3_600_000_000), "pos", "n")
    for s, xs in values.items():
        assert got[s] == [(i + 1, len(xs)) for i in range(len(xs))]


def test_small_tasks_force_buckets_and_blocks(skew):
    df, _ = skew
    assert measure_bucket(df, GRID) is None
    assert measure_bucket(df, BLOCKS) is not None
    blocks = windowed(df, BLOCKS, before=3, after=2)[0]
    sizes = [r["count"] for r in blocks.groupBy("series_id", "_block").count().collect()]
    assert max(sizes) <= 7 + 3 + 2 and len(sizes) > 40
    assert core(blocks).count() == df.count()


def test_a_crowded_second_is_cut_finer(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, 0, i * 7)) for i in range(30)] + [("b", dt.datetime(1960, 1, 1))]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz")
    panel = Panel(rows_per_task=10)
    assert measure_bucket(df, panel) == 10
    got = [(r.pos, r.n) for r in index_panel(df, panel).filter("series_id = 'a'").orderBy("ts").collect()]
    assert got == [(i + 1, 30) for i in range(30)]


@pytest.mark.parametrize("panel", [Panel(rows_per_task=10, block_rows=7, ties=("tie",)), Panel(step=3600, ties=("tie",))])
def test_rows_at_one_time_are_ordered_by_their_ties(spark, panel):
    rows = [("a", dt.datetime(2024, 1, 1), (i * 17) % 40, float((i * 17) % 40)) for i in range(40)] + [("a", dt.datetime(2023, 1, 1), 9, -1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, tie int, value double").repartition(5)
    got = [r.value for r in index_panel(df, panel).orderBy("pos").collect()]
    assert got == [-1.0, *map(float, range(40))]
    steps = [r.value for r in S.difference(df, 1, panel).orderBy("pos").collect()]
    assert steps == [1.0] * 40


@pytest.mark.parametrize("kind, sql, want", [
    (T.TimestampNTZType, "timestamp_ntz'2024-03-10 02:30:07.000009'", 1710037807000009),
    (T.TimestampNTZType, "timestamp_ntz'1969-12-31 23:59:59.5'", -500000),
    (T.TimestampType, "timestamp'2024-03-10 02:30:07.25'", 1710037807250000),
    (T.DateType, "date'2024-03-10'", 1710028800000000), (T.LongType, "1710000000L", 1710000000)])
def test_clock_ticks(spark, kind, sql, want):
    df = spark.sql(f"SELECT {sql} AS ts")
    assert isinstance(df.schema["ts"].dataType, kind)
    assert df.select(clock_ticks(df, "ts")).first()[0] == want


@pytest.mark.parametrize("make", [
    lambda df, p: S.difference(df, 3, p),
    lambda df, p: S.log_difference(S.difference(S.difference(df, 1, p), 9, p).withColumn("value", F.abs("value") + 1), p),
    lambda df, p: S.lag_features(df, 8, p),
    lambda df, p: S.lag_dataset(df, 5, 4, p),
    lambda df, p: S.sliding_sequences(df, 17, 3, p).withColumn("past", F.array_join("past", ",")),
    lambda df, p: S.dilated_filter(df, [1.0, -2.0, 0.5], 6, p),
    lambda df, p: S.undifference(df, S.difference(df, 12, p), 12, p),
    lambda df, p: SC.scale_log_difference(df, by=p.keys, panel=p),
    lambda df, p: S.chrono_split(df, 0.8, p, inner=0.7),
    lambda df, p: S.take_split(df, "test", 0.6, p),
    lambda df, p: M.persistence_forecast(df, 5, p),
    lambda df, p: SC.standardize(df, SC.standard_stats(df, panel=p), p),
])
def test_blocks_give_what_whole_series_give(skew, make):
    df, _ = skew
    a, b = make(df, GRID), make(df, BLOCKS)
    assert set(a.columns) == set(b.columns)
    cols = sorted(a.columns)
    left, right = by_series(a, *cols), by_series(b, *cols)
    assert left.keys() == right.keys()
    for s in left:
        assert len(left[s]) == len(right[s]) > 0
        for u, v in zip(left[s], right[s]):
            for x, y in zip(u, v):
                assert x == y or abs(x - y) < 1e-9


def test_scores_and_correlations_agree_across_layouts(skew):
    df, values = skew
    for make in (lambda p: S.autocorrelation(df, 6, p),
                 lambda p: M.forecast_metrics(M.persistence_forecast(df, 2, p), horizon=2, panel=p)):
        a = {tuple(r)[:-1][:2]: r for r in make(GRID).collect()}
        b = {tuple(r)[:-1][:2]: r for r in make(BLOCKS).collect()}
        assert len(a) == len(b)
        for x, y in zip(sorted(map(tuple, a.values())), sorted(map(tuple, b.values()))):
            assert x[0] == y[0] and np.allclose(x[1:], y[1:])
    x = np.array(values["hot"])
    r = {(row["series_id"], row["lag"]): row["r"] for row in S.autocorrelation(df, 6, BLOCKS).collect()}
    for k in range(1, 6):
        assert r["hot", k] == pytest.approx(np.corrcoef(x[k:], x[:-k])[0, 1])


def test_attach_keeps_every_row(skew):
    df, values = skew
    stats = df.groupBy("series_id").agg(F.max("value").alias("top"))
    got = by_series(attach(index_panel(df, BLOCKS), stats, BLOCKS), "top")
    assert {s: len(rows) for s, rows in got.items()} == {s: len(xs) for s, xs in values.items()}
    assert all(top == max(values[s]) for s, rows in got.items() for (top,) in rows)


def test_global_position(spark):
    names = [f"common_prefix_{i:04d}" for i in range(500)] + ["a", "zz"]
    df = spark.createDataFrame([(n,) for n in names], "node string").repartition(7)
    got = {r["node"]: r["rank"] for r in global_position(df, ["node"]).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_checkpoint_folder_follows_the_session(spark):
    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
