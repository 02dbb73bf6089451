"""Registered queries against their SQL, and the shape of their plans."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import compare
from suite import QUERIES, SQL

SF = "/root/testdata/sf0.001"
# 25-member regressions have no exact SQL; their parts are tested against numpy
ROWS_ONLY = {"var_scores_neighborhoods"}
PYTHON = {"lag_gram", "score_windows", "score_panel", "roll_forward", "var_forecast_pair",
          "var_forecast_center", "var_forecast_prices", "var_recursive_forecast", "var_report", "var_scores_events", "var_scores_suppliers",
          "var_scores_neighborhoods", "nonlinear_forecast", "nonlinear_neighborhoods", "seed_report"}
# written and read back, so the plan seen here is the reading side only
PLANNED = ["ar_fit_five_lags", "ar_scores_five_lags", "ar_scores_suppliers", "ar_scores_raw_events", "complete_panel", "neighbors", "scale_log_difference",
           "sliding_sequences", "autocorrelation_raw_events", "arma_posterior", "persistence_scores_suppliers",
           "recursive_forecast", "evaluation_grid", "train_test_normalized", "chunk_sequences", "pivot_prices"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(SQL) == ROWS_ONLY
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ROWS_ONLY])
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok, note
    assert "types differ" not in note


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_in_the_jvm_and_partition_their_windows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not re.search(r"PythonUDF|BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    for line in text.splitlines():
        if re.search(r"Window \[", line):
            # _part: one row per partition of a sort
            assert re.search(r"windowspecdefinition\((series_id|_part)#", line), line


@pytest.mark.parametrize("name", sorted(PYTHON & set(QUERIES)))
def test_python_is_arrow_batched(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in text and "FlatMapGroupsInPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["ar_fit_suppliers"](spark, SF))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas and all(s.count(":") == 3 for s in schemas)
    from panelcast.operators.reshape import between_exclusive
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(between_exclusive(orders, "1997-01-31", "1999-05-23", on="o_orderdate").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThan(o_orderdate" in text
