"""Fit, forecast and score whole panels over settings and seeds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.models.ar import ARSpec, ar_ridge_fit, ar_ridge_scores
from panelcast.models.nonlinear import NonlinearSpec, nonlinear_fit, nonlinear_predict
from panelcast.models.var import VARSpec, matrix_stats, var_ridge_fit, var_ridge_predict
from panelcast.operators.index import index_panel
from panelcast.operators.metrics import forecast_metrics
from panelcast.operators.scale import minmax_stats
from panelcast.operators.series import take_split
from panelcast.panel import MATRIX, PANEL, Panel
from panelcast.session import stored


def evaluate_ar(df: DataFrame, spec: ARSpec = ARSpec(), fraction: float = 0.8, scaler: str = "refit",
                panel: Panel = PANEL) -> DataFrame:
    """Scores per series: fit on the first ``fraction`` of its rows, forecast the rest.

    ``scaler='refit'`` scales the test rows by their own range, ``'train'`` by the
    range of the training rows.
    """
    ix = index_panel(df, panel)
    train = take_split(ix, "train", fraction, panel)
    if scaler not in ("refit", "train"):
        raise ValueError(f"unknown scaler {scaler!r}")
    ranges = minmax_stats(train, by=panel.keys, panel=panel) if scaler == "train" else None
    return ar_ridge_scores(take_split(ix, "test", fraction, panel), ar_ridge_fit(train, spec, panel), spec, ranges,
                           panel=panel)


def forecast_var(matrix: DataFrame, spec: VARSpec = VARSpec(), fraction: float = 0.8, scaler: str = "refit",
                 restore: bool = False, panel: Panel = MATRIX) -> DataFrame:
    """Fits on the first ``fraction`` of every neighbourhood's rows and forecasts the rest.

    ``scaler='refit'`` scales the test rows by their own ranges, ``'train'`` by those of the training rows.
    """
    if scaler not in ("refit", "train"):
        raise ValueError(f"unknown scaler {scaler!r}")
    ix = index_panel(matrix, panel)
    train = take_split(ix, "train", fraction, panel)
    ranges = matrix_stats(train, panel) if scaler == "train" else None
    return var_ridge_predict(take_split(ix, "test", fraction, panel), var_ridge_fit(train, spec, panel), spec, panel, ranges, restore)


def evaluate_var(matrix: DataFrame, spec: VARSpec = VARSpec(), fraction: float = 0.8,
                 panel: Panel = MATRIX) -> DataFrame:
    """Pooled scores per centre over all outputs of its neighbourhood."""
    pred = forecast_var(matrix, spec, fraction, panel=panel)
    return forecast_metrics(pred, list(panel.keys), spec.horizon, panel.with_keys(*panel.keys, "member"))


def evaluate_grid(df: DataFrame, models: Mapping[str, ARSpec], fraction: float = 0.8,
                  scalers: Sequence[str] = ("refit",), panel: Panel = PANEL) -> DataFrame:
    """Scores ``(keys, type, run, ...)`` of every series under every named setting.

    All series go through one plan per setting; nothing loops over series. ``run``
    numbers the scalers, which stand where a seeded model would repeat its seeds. The
    numbered panel is stored once, since every setting reads it twice.
    """
    ix = stored(index_panel(df, panel))
    parts = [
        evaluate_ar(ix, spec, fraction, scaler, panel).withColumn("type", F.lit(name)).withColumn("run", F.lit(run))
        for name, spec in models.items() for run, scaler in enumerate(scalers)
    ]
    return reduce(DataFrame.unionByName, parts)


def evaluate_var_grid(matrix: DataFrame, models: Mapping[str, VARSpec], fraction: float = 0.8,
                      panel: Panel = MATRIX) -> DataFrame:
    """Pooled scores ``(center, type, ...)`` of every neighbourhood under every named setting."""
    ix = stored(index_panel(matrix, panel))
    parts = [evaluate_var(ix, spec, fraction, panel).withColumn("type", F.lit(name)) for name, spec in models.items()]
    return reduce(DataFrame.unionByName, parts)


def evaluate_seeds(df: DataFrame, spec: NonlinearSpec, seeds: Sequence[int], fraction: float = 0.8,
                   panel: Panel = PANEL) -> DataFrame:
    """Scores ``(keys, type, run, ...)`` of the nonlinear model, ``run`` being the seed; all seeds in one job.

    The panel may hold single values or arrays; scores of arrays are pooled over the members.
    """
    keys = list(panel.keys)
    ix = stored(index_panel(df, panel))
    train, test = (take_split(ix, part, fraction, panel) for part in ("train", "test"))
    pred = nonlinear_predict(test, nonlinear_fit(train, spec, seeds, panel), spec, panel)
    scored = forecast_metrics(pred, [*keys, "seed"], spec.horizon, panel.with_keys(*keys, "seed", "member"))
    return scored.withColumn("type", F.lit("nonlinear")).withColumnRenamed("seed", "run")
