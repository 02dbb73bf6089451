"""Hand-computed rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import LAYOUTS, START, by_series, panel_of, values
from panelcast.functions.columns import hour_ts
from panelcast.models.arma import arma_residual_ss
from panelcast.operators import graph as G
from panelcast.operators import metrics as M
from panelcast.operators import reshape as R
from panelcast.operators import scale as SC
from panelcast.operators import series as S


def test_zone_rollup_and_zero_rows(spark):
    zones = ["COAST", "EAST", "FAR_WEST", "NORTH", "NORTH_C", "SOUTHERN", "SOUTH_C", "WEST"]
    schema = "delivery_date string, hour_ending string, " + ", ".join(f"{z} double" for z in zones)
    rows = [("2011-01-01", "01:00", 10.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0)]
    rows += [("2011-01-01", "02:00", *[0.0 if i == k else 1.0 for i in range(8)]) for k in range(8)]
    kept = R.rollup_zones(R.drop_any_zero(spark.createDataFrame(rows, schema), zones)).collect()
    assert [(r.west, r.north, r.south, r.houston) for r in kept] == [(9.0, 8.0, 11.0, 10.0)]


def test_pivot_fills_with_null(spark):
    rows = [("01-02", 1, "A", 1.5), ("01-02", 1, "B", 2.5), ("01-02", 24, "A", 3.5)]
    df = spark.createDataFrame(rows, "delivery_date string, hour_ending int, node string, price double")
    wide = R.pivot_prices(df, ["C", "A", "B"], ["delivery_date", "hour_ending"], "node", "price")
    assert wide.columns[2:] == ["A", "B", "C"]
    assert sorted(map(tuple, wide.collect())) == [("01-02", 1, 1.5, 2.5, None), ("01-02", 24, 3.5, None, None)]
    lines = sorted(r.line for r in R.to_csv_line(wide).collect())
    assert lines == ["01-02,1,1.5,2.5,null", "01-02,24,3.5,null,null"]


def test_hour_24(spark):
    row = spark.sql("SELECT date'2011-01-02' AS d, 24 AS h").select(
        hour_ts(F.col("d"), F.col("h")).alias("a"), hour_ts(F.col("d"), F.col("h"), "compat").alias("b")).first()
    assert (row.a, row.b) == (dt.datetime(2011, 1, 3), dt.datetime(2011, 1, 2))


@pytest.mark.parametrize("panel", LAYOUTS)
def test_difference(spark, panel):
    assert values(S.difference(panel_of(spark, {"s": [1, 4, 9, 16]}), 2, panel)) == [8.0, 12.0]


@pytest.mark.parametrize("panel", LAYOUTS)
def test_lag_dataset_skips_the_first_target(spark, panel):
    got = by_series(S.lag_dataset(panel_of(spark, {"s": [0, 1, 2, 3, 4, 5]}), 2, 1, panel), "lag_1", "lag_2", "target")
    assert got["s"] == [(2, 1, 3), (3, 2, 4), (4, 3, 5)]


@pytest.mark.parametrize("panel", LAYOUTS)
def test_lag_features(spark, panel):
    got = by_series(S.lag_features(panel_of(spark, {"s": [0, 1, 2, 3, 4]}), 2, panel), "lag_1", "lag_2", "value")
    assert got["s"] == [(1, 0, 2), (2, 1, 3), (3, 2, 4)]


@pytest.mark.parametrize("panel", LAYOUTS)
def test_sliding_sequences_leave_out_the_last_window(spark, panel):
    got = by_series(S.sliding_sequences(panel_of(spark, {"s": [0, 1, 2, 3, 4, 5]}), 3, 1, panel), "past", "target")
    assert got["s"] == [([0, 1, 2], 3), ([1, 2, 3], 4)]


@pytest.mark.parametrize("panel", LAYOUTS)
def test_metrics(spark, panel):
    rows = [("s", START + dt.timedelta(hours=i), p, a) for i, (p, a) in enumerate([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0)])]
    pred = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, predicted double, actual double")
    row = M.forecast_metrics(pred, panel=panel).first()
    assert (row.mae, row.naive_mae, row.mase, row.hits) == (0.75, 2.0, 0.375, 3.0)
    assert row.hit_rate == pytest.approx(2 / 3)


@pytest.mark.parametrize("panel", LAYOUTS)
def test_minmax(spark, panel):
    df = panel_of(spark, {"a": [2, 4, 6], "b": [5, 5]})
    assert by_series(SC.scale_own_range(df, panel), "value") == {"a": [(1.0,), (3.5,), (6.0,)], "b": [(1.0,), (1.0,)]}
    plus = SC.minmax_scale(df, SC.minmax_stats(df, "col_max_plus_1", panel=panel), panel)
    assert by_series(plus, "value")["a"] == [(1.0,), (4.0,), (7.0,)]
    shared = SC.minmax_stats(df, panel=panel).collect()
    assert {r.upper for r in shared} == {6.0}


@pytest.mark.parametrize("panel", LAYOUTS)
def test_split(spark, panel):
    got = by_series(S.chrono_split(panel_of(spark, {"s": range(7)}), 0.8, panel), "split")["s"]
    assert [x for (x,) in got] == ["train"] * 5 + ["test"] * 2


def test_arma_residuals(spark):
    got = arma_residual_ss(panel_of(spark, {"s": [1, 2, 3]}), {"mu": [0.1], "phi": [0.5], "theta": [0.2]}).first()
    assert got.ss == pytest.approx(4.248616) and got.n == 2


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "source string, sink string")


def test_neighbors(spark):
    catalog = spark.createDataFrame([(n,) for n in ("CAL_CALGT1", "CALAVER_JKS1", "KING_KINGNW")], "node string")
    centers = spark.createDataFrame([("CAL_CALGT1",)], "center string")
    both = _edges(spark, [("CAL_CALGT1", "X"), ("Y", "CAL_CALGT1"), (None, "Z")])
    got = {(r.node, r.is_center) for r in G.neighbors(both, catalog, centers).collect()}
    assert got == {("CAL_CALGT1", True), ("CALAVER_JKS1", False)}
    one_sided = _edges(spark, [("CAL_CALGT1", "X")])
    assert {(r.node, r.is_center) for r in G.neighbors(one_sided, catalog, centers).collect()} == {("CAL_CALGT1", True)}
    unknown = spark.createDataFrame([("NOWHERE_1",)], "center string")
    with pytest.raises(Exception, match="centre not in the node catalog: NOWHERE_1"):
        G.neighbors(both, catalog, unknown).collect()
    assert G.neighbors(both, catalog, unknown, "drop").count() == 0


def test_names_without_underscore_bring_in_nothing(spark):
    catalog = spark.createDataFrame([("HUB",), ("A_1",)], "node string")
    edges = _edges(spark, [("HUB", "HUB"), ("A_1", "A_1")])
    assert [r.node for r in G.crr_nodes(edges, catalog).collect()] == ["A_1"]


@pytest.mark.parametrize("panel", LAYOUTS)
def test_dilated_filter(spark, panel):
    assert values(S.dilated_filter(panel_of(spark, {"s": [1, 2, 3, 4, 5]}), [1.0, 10.0], 2, panel)) == [31.0, 42.0, 53.0]


def test_chunks_and_the_extra_zero_chunk(spark):
    df = panel_of(spark, {"even": [1, 2, 3, 4], "odd": [1, 2, 3]})
    got = {(r.series_id, r.chunk): r["values"] for r in S.chunk_sequences(df, 2).collect()}
    assert got == {("even", 0): [1, 2], ("even", 1): [3, 4], ("even", 2): [0, 0], ("odd", 0): [1, 2], ("odd", 1): [3, 0]}
    assert S.chunk_sequences(df, 2, compat=False).count() == 4


def test_completion_and_complete_hours(spark):
    df = panel_of(spark, {"a": [1, 2, 3], "b": [4, 5], "c": [6]})
    shards = R.assign_shards(R.node_catalog(df), 2)
    assert {(r.node, r.shard) for r in shards.collect()} == {("a", 0), ("b", 0), ("c", 1)}
    full = R.complete_panel(df, shards)
    assert full.count() == 3 * 2 + 1
    missing = full.filter("value is null").collect()
    assert [(r.series_id, r.ts.hour) for r in missing] == [("b", 2)]
    assert {r.ts.hour for r in R.complete_hours(df, shards).collect()} == {0}
    assert [r.node for r in R.pick_nth(R.node_catalog(df), ["node"], 1).collect()] == ["b"]


def test_window_mase(spark):
    df = panel_of(spark, {"s": [1, 3, 2, 6, 7]})
    windows = S.sliding_sequences(df, 2, 1).withColumn("predicted", F.lit(2.0))
    row = S.window_mase(windows).first()
    # windows [1,3]->2 and [3,2]->6: errors 0 and 4, steps (2+1) and (1+4)
    assert (row.mae, row.mean_abs_step, row.mase) == (2.0, 2.0, 1.0)


def test_a_missing_value_keeps_its_place_in_the_window(spark):
    df = panel_of(spark, {"s": [1, 2, 3, 4, 5]}).withColumn("value", F.expr("nullif(value, 2)"))
    got = by_series(S.sliding_sequences(df, 3, 1), "past")["s"]
    assert str(got[0][0]) == "[1.0, nan, 3.0]"


def test_date_range_leaves_out_every_hour_of_both_ends(spark):
    df = panel_of(spark, {"s": range(96)})
    kept = R.between_exclusive(df, "2024-1-1", "2024-01-04", "ts").collect()
    assert {r.ts.day for r in kept} == {2, 3} and len(kept) == 48
