"""Batched scoring of sliding windows with a model the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.blocks import map_windows, own_columns
from panelcast.panel import PANEL, Panel

ModelFn = Callable[[np.ndarray], np.ndarray]


def score_windows(windows: DataFrame, model_fn: ModelFn, past: str = "past", keep_past: bool = True) -> DataFrame:
    """Adds ``predicted = model_fn(past)``, one call per Arrow batch of shape ``[rows, width]``."""
    columns = windows.columns if keep_past else [c for c in windows.columns if c != past]
    schema = T.StructType([windows.schema[c] for c in columns] + [T.StructField("predicted", T.DoubleType())])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                out = batch[columns].copy()
                out["predicted"] = np.asarray(model_fn(np.stack(batch[past].to_numpy())), dtype=float)
                yield out

    return windows.mapInPandas(score, schema)


def _shaped(past: np.ndarray, model_fn: ModelFn, single: bool) -> np.ndarray:
    """The model's answer ``[windows, members]``; a model of single values gets ``[windows, width]``."""
    answer = np.asarray(model_fn(past[:, :, 0] if single else past), dtype=float)
    return answer.reshape(len(past), -1)


def _is_single(df: DataFrame, panel: Panel) -> bool:
    return not isinstance(df.schema[panel.value].dataType, T.ArrayType)


def _null_nan(c: str):
    return F.transform(c, lambda v: F.when(~F.isnan(v), v))


def score_panel(df: DataFrame, model_fn: ModelFn, width: int, horizon: int = 1, panel: Panel = PANEL) -> DataFrame:
    """``(keys, member, ts, pos, n, predicted, actual)`` of every window of ``width`` values and the value ``horizon`` rows on.

    The windows are those of :func:`sliding_sequences`, but rows are sent to Python once and windows are views there.
    ``model_fn`` gets ``[windows, width]``, or ``[windows, width, members]`` for a panel of arrays, oldest rows first, at most
    4,096 windows at a time, and returns a value per window (and member). A window with a missing value has NaN in it.
    """
    keys, single = list(panel.keys), _is_single(df, panel)

    def score(key: tuple, rows: pd.DataFrame, windows: np.ndarray, head) -> Iterator[pd.DataFrame]:
        legal = (rows["pos"] + horizon <= rows["n"] - 1).to_numpy()
        if legal.any():
            out = rows.loc[legal, [*keys, panel.time, "pos", "n"]].copy()
            out["predicted"] = list(_shaped(windows[legal, :width], model_fn, single))
            out["actual"] = list(windows[legal, -1])
            yield out

    found = map_windows(df, score, own_columns(df, [*keys, panel.time], "pos bigint, n bigint, predicted array<double>, actual array<double>"),
                        width - 1, horizon, panel)
    pairs = F.posexplode(F.arrays_zip(_null_nan("predicted").alias("predicted"), _null_nan("actual").alias("actual")))
    return found.select(*keys, panel.time, F.col("pos").alias("_pos"), "n", pairs).select(
        *keys, F.col("pos").alias("member"), panel.time, F.col("_pos").alias("pos"), "n", "col.predicted", "col.actual")


def roll_forward(df: DataFrame, model_fn: ModelFn, width: int, n_steps: int, panel: Panel = PANEL) -> DataFrame:
    """``(keys, origin, step, member, predicted)``: ``n_steps`` values after every row that ends a full window.

    Each step drops the oldest row of the windows and takes the last prediction as the newest, for all windows of a batch
    at once; there is no job per step. ``model_fn`` is called as in :func:`score_panel` and must predict every member.
    """
    keys, single = list(panel.keys), _is_single(df, panel)

    def roll(key: tuple, rows: pd.DataFrame, windows: np.ndarray, head) -> Iterator[pd.DataFrame]:
        past, path = windows.copy(), []
        for _ in range(n_steps):
            path.append(_shaped(past, model_fn, single))
            past = np.concatenate([past[:, 1:], path[-1][:, None, :]], axis=1)
        out = rows[[*keys, panel.time]].rename(columns={panel.time: "origin"})
        out["path"] = [[list(p) for p in steps] for steps in np.stack(path, axis=1)]
        yield out

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("origin", df.schema[panel.time].dataType),
                           T.StructField("path", T.ArrayType(T.ArrayType(T.DoubleType())))])
    found = map_windows(df, roll, schema, width - 1, 0, panel)
    steps = found.select(*keys, "origin", F.posexplode("path").alias("_step", "_values"))
    return steps.select(*keys, "origin", (F.col("_step") + 1).alias("step"), F.posexplode(_null_nan("_values")).alias("member", "predicted"))
