"""Linear algebra in column expressions against numpy."""

import numpy as np
import pytest
from helpers import GRID, panel_of
from pyspark.sql import functions as F

from panelcast.functions.linear import cholesky, triangular_solve
from panelcast.models.ar import ARSpec, ar_ridge_fit


def solved(spark, rows):
    df = spark.createDataFrame(rows, "id int, a array<array<double>>, b array<double>")
    df = df.withColumn("l", cholesky(F.col("a"))).withColumn("x", triangular_solve(F.col("l"), F.col("b")))
    return {r.id: (r.l, r.x) for r in df.collect()}


def test_solves_systems_of_any_size(spark):
    rng = np.random.default_rng(1)
    rows = []
    for size in (1, 2, 3, 5, 9):
        half = rng.normal(size=(size, size + 2))
        rows.append((size, (half @ half.T).tolist(), rng.normal(size=size).tolist()))
    got = solved(spark, rows)
    for size, a, b in rows:
        lower, x = got[size]
        want = np.linalg.cholesky(np.array(a))
        assert all(np.allclose(row, want[i, : i + 1]) for i, row in enumerate(lower)) and np.allclose(x, np.linalg.solve(a, b))


def test_empty_and_singular_systems(spark):
    got = solved(spark, [(0, [], []), (1, [[0.0]], [1.0]), (2, [[4.0, 0.0], [0.0, 0.0]], [8.0, 1.0])])
    assert got[0] == ([], []) and got[1][1] == [None] and got[2][1][1] is None


@pytest.mark.parametrize("p", [1, 2, 3, 5, 12])
def test_one_path_for_any_number_of_lags(spark, p):
    rng = np.random.default_rng(p)
    x = 1e6 + rng.normal(0, 1, 150).cumsum()  # far from zero: uncentred products would lose their digits
    got = ar_ridge_fit(panel_of(spark, {"s": list(x)}), ARSpec(p=p, lag=1, q=0, log_difference=False), GRID).first()
    d = x[1:] - x[:-1]
    lags = np.array([d[k - p : k][::-1] for k in range(p, len(d))])
    y = d[p:]
    centred = lags - lags.mean(0)
    want = np.linalg.solve(centred.T @ centred + np.eye(p), centred.T @ (y - y.mean()))
    assert np.allclose(got.weights, want, atol=1e-8) and np.isclose(got.intercept, y.mean() - lags.mean(0) @ want, atol=1e-8)
