"""Faults found in review: hour-ending ranges, large offsets, NULL cells and repeated hours."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np
import pytest
from helpers import GRID, LAYOUTS, START, panel_of
from pyspark.sql import functions as F

from check import compare
from panelcast.models.ar import ARSpec, ar_ridge_fit
from panelcast.models.var import VARSpec, incomplete_rows, to_matrix, var_ridge_fit
from panelcast.operators import reshape as R
from panelcast.operators.reshape import column_names, wide_shard_lines
from panelcast.plans.datasets import query_prices
from panelcast.plans.evaluation import evaluate_ar
from suite import QUERIES


def test_hour_24_belongs_to_its_delivery_date(spark):
    rows = [(f"2024-01-{d:02d}", h, "a", float(100 * d + h)) for d in range(1, 5) for h in range(1, 25)]
    panel = R.to_panel(spark.createDataFrame(rows, "delivery_date string, hour_ending int, node string, price double"))
    kept = sorted(r.value for r in query_prices(panel, "a", "2024-1-1", "2024-1-4", hour_ending=True).collect())
    assert kept == [100.0 * d + h for d in (2, 3) for h in range(1, 25)]


def test_five_lags_far_from_zero(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(1e8 + rng.normal(size=300))
    spec = ARSpec(p=5, q=0, log_difference=False)
    got = ar_ridge_fit(panel_of(spark, {"s": x}), spec, GRID).first()
    lag = spec.lag
    d = x[lag:] - x[:-lag]
    rows = np.array([d[k - 5 : k][::-1] for k in range(5, len(d))])
    y = d[5:]
    centred = rows - rows.mean(axis=0)
    want = np.linalg.solve(centred.T @ centred + spec.alpha * np.eye(5), centred.T @ (y - y.mean()))
    assert np.allclose(got.weights, want, atol=1e-6)
    assert np.isclose(got.intercept, y.mean() - rows.mean(axis=0) @ want, rtol=1e-6)


def test_a_null_cell_leaves_out_its_rows_only(spark):
    rng = np.random.default_rng(9)
    values = rng.normal(50, 5, (60, 2))
    rows = [("c", START + dt.timedelta(hours=k), [float(v) if (k, m) != (7, 1) else None for m, v in enumerate(row)]) for k, row in enumerate(values)]
    matrix = spark.createDataFrame(rows, "center string, ts timestamp_ntz, values array<double>")
    spec = VARSpec(look_back=1, log_difference=False)
    coefs = var_ridge_fit(matrix, spec).first().coefs
    assert all(np.isfinite(w).all() and len(w) == 2 for _, w in coefs)
    assert incomplete_rows(matrix, spec).first().incomplete == 2


def test_a_repeated_hour_is_averaged(spark):
    rows = [("c", START, "c", 1.0), ("c", START, "m", 2.0), ("c", START, "m", 4.0)]
    cells = spark.createDataFrame(rows, "center string, ts timestamp_ntz, node string, value double")
    family = spark.createDataFrame([("c", "c", True), ("c", "m", False)], "center string, node string, is_center boolean")
    assert to_matrix(cells, family).select(F.col("values")).first()[0] == [1.0, 3.0]


@pytest.fixture(scope="module")
def six_types(spark, tmp_path_factory):
    """The events with a sixth type, ``zoom``, beside ``view``."""
    folder = str(tmp_path_factory.mktemp("six"))
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    more = events.filter("event_type = 'view'").withColumns({
        "event_type": F.lit("zoom"), "event_id": F.col("event_id") + 1_000_000, "value": F.col("value") * 1.25 + 1})
    events.union(more).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["pivot_prices", "shard_join", "unpivot_prices", "fill_null", "wide_csv_lines", "var_forecast_pair",
                                  "var_forecast_center", "var_scores_events"])
def test_a_new_name_in_the_data_is_found(spark, six_types, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{six_types}/events.parquet/*.parquet')")
    ok, note = compare(spark, con, name, six_types)
    assert ok, note
    rows = QUERIES[name](spark, six_types)
    if name in ("pivot_prices", "shard_join"):
        assert "zoom" in rows.columns
    elif name == "wide_csv_lines":
        assert rows.first()["line"].count(",") == 6
    else:
        column = "node" if "node" in rows.columns else "center"
        assert "zoom" in {r[column] for r in rows.select(column).distinct().collect()}


def test_a_repeated_cell_is_one_price_of_a_line(spark):
    rows = [("a", START, 1.0), ("a", START, 3.0), ("b", START, 5.0), ("c", START + dt.timedelta(hours=1), 7.0)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    shards = spark.createDataFrame([("a", 0), ("b", 0), ("c", 0)], "node string, shard int")
    lines = sorted(r["line"] for r in wide_shard_lines(df, shards).collect())
    assert [x.split(",")[2:] for x in lines] == [["2.0", "5.0", "null"], ["null", "null", "7.0"]]


def test_names_of_a_wide_table_are_bounded(spark):
    df = spark.createDataFrame([(f"s{k}",) for k in range(5)] + [(None,)], "series_id string")
    assert column_names(df) == [f"s{k}" for k in range(5)]
    with pytest.raises(ValueError, match="more than 4 names"):
        column_names(df, most=4)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_a_short_series_keeps_its_row(spark, layout):
    rng = np.random.default_rng(3)
    series = {"long": list(np.exp(rng.normal(3, 0.2, 200))), "short": [1.0, 2.0, 3.0, 4.0]}
    got = {r.series_id: r for r in evaluate_ar(panel_of(spark, series), ARSpec(p=2, lag=1, q=1), panel=layout).collect()}
    assert set(got) == {"long", "short"} and got["long"].mae > 0 and got["short"].mae is None and got["short"].hits is None
