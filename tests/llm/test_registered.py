"""Registered queries against their SQL, and native plans without Python."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point
from check import compare
from panelcast.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_all_thirteen_and_the_pipeline_are_registered():
    numbers = {int(name[2:].split("_")[0]) for name in QUERIES}
    assert numbers == set(range(1, 14)) and "pipeline" in entry_point.queries() and set(QUERIES) <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    ok, note = compare(spark, con, name, SF)
    assert ok and "types differ" not in note, note


@pytest.mark.parametrize("name", [n for n in QUERIES if n.split("_")[0] in ("op3", "op5", "op9", "op10")])
def test_native_plans_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct") if w in plan]
