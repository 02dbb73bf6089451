"""Direct h-step nonlinear autoregression: one hidden layer of rectified units per series, for many seeds in one job.

The weights of the hidden layer are drawn from a seed, the output layer is fitted by ridge regression, so a fit is exact,
needs one pass for all series and seeds, and equals SQL with the same weights. The units see the lags of one series, or of
all members of a neighbourhood. Windows are taken inside tasks (see :mod:`panelcast.operators.blocks`), and tasks emit
Gram matrices only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.moments import GramSums, solve_ridge, sum_grams
from panelcast.operators.blocks import map_windows, own_columns
from panelcast.operators.index import index_panel
from panelcast.operators.series import train_stop
from panelcast.panel import PANEL, Panel


@dataclass(frozen=True)
class NonlinearSpec:
    """``units`` hidden units over ``look_back`` lags of each member; the first ``train_fraction`` of the lag rows train.

    ``outputs='center'`` predicts a neighbourhood's first member only. Give differences or standardised values:
    Gram matrices of large values lose digits.
    """

    look_back: int = 48
    horizon: int = 1
    units: int = 100
    alpha: float = 1.0
    train_fraction: float = 0.6
    outputs: str = "all"


@lru_cache(256)
def hidden_layer(seed: int, inputs: int, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights ``[units, inputs]`` and biases drawn evenly from a range that keeps the variance of inputs and units alike."""
    rng = np.random.default_rng([seed, inputs, units])
    bound = (6.0 / (inputs + units)) ** 0.5
    return rng.uniform(-bound, bound, (units, inputs)), rng.uniform(-bound, bound, units)


def _active(lags: np.ndarray, seed: int, units: int) -> np.ndarray:
    weights, biases = hidden_layer(int(seed), lags.shape[1], units)
    return np.maximum(lags @ weights.T + biases, 0.0)


def _lags_and_targets(rows: pd.DataFrame, windows: np.ndarray, spec: NonlinearSpec):
    """Lags (newest first, all members of a lag together) and targets; also the numbers of the lag rows and how many there are."""
    k = spec.look_back
    members = 1 if spec.outputs == "center" else windows.shape[2]
    lags = windows[:, k - 1 :: -1, :] if k > 1 else windows[:, :1, :]
    first = k + 1  # the first legal target is left out
    return (lags.reshape(len(windows), -1), windows[:, k + spec.horizon - 1, :members], rows["pos"].to_numpy() - first,
            rows["n"].to_numpy() - first - (spec.horizon - 1))


def _fit(spec: NonlinearSpec, seeds: Sequence[int], keys: list[str]):
    def fit(key: tuple, rows: pd.DataFrame, windows: np.ndarray, head) -> Iterator[pd.DataFrame]:
        x, y, row, count = _lags_and_targets(rows, windows, spec)
        train = (row >= 1) & (row <= np.floor(spec.train_fraction * count)) & ~np.isnan(x).any(1) & ~np.isnan(y).any(1)
        if train.any():
            sums = GramSums([*keys, "seed"])
            for seed in seeds:
                sums.add((*key, seed), _active(x[train], seed, spec.units), y[train])
            yield sums.take()
    return fit


def nonlinear_fit(df: DataFrame, spec: NonlinearSpec, seeds: Sequence[int] = (1234,), panel: Panel = PANEL) -> DataFrame:
    """``(keys, seed, coefs)``: per output an intercept and a weight per unit, of every series under every seed.

    Lag rows with a missing value are left out; a series without a complete training row has no row here.
    """
    keys = list(panel.keys)
    partials = map_windows(df, _fit(spec, tuple(seeds), keys), own_columns(df, keys, "seed int, n_x int, cells array<double>"),
                           spec.look_back, spec.horizon - 1, panel)
    return solve_ridge(sum_grams(partials, [*keys, "seed"]), [*keys, "seed"], spec.alpha)


def _predict(spec: NonlinearSpec, keys: list[str], time: str):
    def predict(key: tuple, rows: pd.DataFrame, windows: np.ndarray, head) -> Iterator[pd.DataFrame]:
        x, y, row, count = _lags_and_targets(rows, windows, spec)
        legal = row >= 1
        if head is None or not legal.any():
            return
        rows, x, y = rows[legal], x[legal], y[legal]
        for model in head["models"]:
            weights = np.array([c["weights"] for c in model["coefs"]])
            out = rows[[*keys, time]].copy()
            out["seed"], out["pos"], out["n"] = model["seed"], row[legal], count[legal]
            predicted = _active(x, model["seed"], spec.units) @ weights.T + [c["intercept"] for c in model["coefs"]]
            out["predicted"] = [[None if np.isnan(v) else v for v in p] for p in predicted]
            out["actual"] = [[None if np.isnan(v) else v for v in a] for a in y]
            yield out
    return predict


def nonlinear_predict(df: DataFrame, models: DataFrame, spec: NonlinearSpec, panel: Panel = PANEL) -> DataFrame:
    """``(keys, seed, member, ts, pos, n, predicted, actual)`` of every lag row; ``pos`` and ``n`` count lag rows.

    Member 0 is the series itself, or the centre of a neighbourhood. A series that has no model comes back once, with a NULL
    seed and NULL predictions.
    """
    keys = list(panel.keys)
    each = models.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seed", "coefs"))).alias("models"))
    ix = index_panel(df, panel)
    found = map_windows(ix, _predict(spec, keys, panel.time),
                        own_columns(df, [*keys, panel.time], "seed int, pos bigint, n bigint, predicted array<double>, actual array<double>"),
                        spec.look_back, spec.horizon - 1, panel, heads=each)
    pairs = F.posexplode(F.arrays_zip("predicted", "actual"))
    rows = found.select(*keys, "seed", F.col(panel.time), F.col("pos").alias("_pos"), "n", pairs)
    rows = rows.select(*keys, "seed", F.col("pos").alias("member"), panel.time, F.col("_pos").alias("pos"), "n", "col.predicted", "col.actual")
    lost = ix.groupBy(*keys).agg(F.max("n").alias("n")).join(each, keys, "left_anti")
    return rows.unionByName(lost.select(*keys), allowMissingColumns=True)


def is_test(train_fraction: float):
    """Of rows that ``nonlinear_predict`` numbered, those after the training share."""
    return F.col("pos") > train_stop(train_fraction)


def nonlinear_ar(df: DataFrame, spec: NonlinearSpec, seeds: Sequence[int] = (1234,), panel: Panel = PANEL) -> DataFrame:
    """Fits on the training share of the lag rows and predicts the rest."""
    ix = index_panel(df, panel)
    pred = nonlinear_predict(ix, nonlinear_fit(ix, spec, seeds, panel), spec, panel)
    return pred.filter(is_test(spec.train_fraction) | F.col("seed").isNull())
