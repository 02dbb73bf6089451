"""Ridge autoregression with a moving-average residual correction, for all series in one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from panelcast.functions.columns import dot, safe_ln
from panelcast.functions.linear import cholesky, triangular_solve
from panelcast.operators.index import attach, core, index_panel, windowed
from panelcast.operators.metrics import score_columns
from panelcast.operators.scale import minmax_scale, scale_own_range
from panelcast.panel import PANEL, Panel


@dataclass(frozen=True)
class ARSpec:
    """``p`` lags of a series differenced at ``lag``; ``q`` residuals in the correction.

    ``lag`` is a seasonal offset, not an order; log mode differences at offset 1 after
    scaling each series to ``[1, max]``.
    """

    p: int = 2
    lag: int = 24
    q: int = 2
    log_difference: bool = True
    alpha: float = 1.0

    @property
    def offset(self) -> int:
        return 1 if self.log_difference else self.lag


def _scaled(ix: DataFrame, spec: ARSpec, panel: Panel, ranges: DataFrame | None = None) -> DataFrame:
    if not spec.log_difference:
        return ix
    return scale_own_range(ix, panel) if ranges is None else minmax_scale(ix, ranges, panel)


def _differenced(rows: DataFrame, w: WindowSpec, spec: ARSpec, panel: Panel) -> DataFrame:
    """Adds the difference ``_v``, its base ``_base`` and the lags ``_l1.._lp``."""
    x = F.col(panel.value)
    level = safe_ln(x) if spec.log_difference else x
    rows = rows.withColumn("_base", F.lag(level, spec.offset).over(w)).withColumn("_v", level - F.col("_base"))
    return rows.select("*", *[F.lag("_v", k).over(w).alias(f"_l{k}") for k in range(1, spec.p + 1)])


def _lag_names(spec: ARSpec) -> list[str]:
    return [f"_l{k}" for k in range(1, spec.p + 1)]


def centred_ridge(rows: DataFrame, keys: Sequence[str], target: str, lags: Sequence[str], alpha: float) -> DataFrame:
    """``(keys, intercept, weights)`` of a ridge regression on any number of columns, from centred moments.

    Moments are summed about the means in one grouped pass with map-side combine; the normal equations are solved by a
    Cholesky factorisation in column arithmetic. Rows must be complete.
    """
    n = F.count(F.lit(1))
    pairs = {(i, j): (n * F.covar_pop(a, b)).alias(f"_s{i}_{j}") for i, a in enumerate(lags) for j, b in enumerate(lags) if i <= j}
    moments = rows.groupBy(*keys).agg(
        F.avg(target).alias("_mean"), *[F.avg(a).alias(f"_m{i}") for i, a in enumerate(lags)],
        *[(n * F.covar_pop(a, target)).alias(f"_r{i}") for i, a in enumerate(lags)], *pairs.values())
    size = range(len(lags))
    matrix = F.array(*[F.array(*[F.col(f"_s{min(i, j)}_{max(i, j)}") + (float(alpha) if i == j else 0.0) for j in size]) for i in size])
    # one step at a time, so that no expression is written out within another
    factored = moments.withColumn("_matrix", matrix).withColumn("_rows", cholesky(F.col("_matrix")))
    solved = factored.withColumn("_b", F.array(*[f"_r{i}" for i in size])).withColumn("weights", triangular_solve(F.col("_rows"), F.col("_b")))
    means = F.array(*[f"_m{i}" for i in size])
    return solved.select(*keys, (F.col("_mean") - dot(F.col("weights"), means)).alias("intercept"), "weights")


def ar_ridge_fit(df: DataFrame, spec: ARSpec = ARSpec(), panel: Panel = PANEL) -> DataFrame:
    """``(keys, intercept, weights)`` per series."""
    keys = list(panel.keys)
    rows, w = windowed(_scaled(index_panel(df, panel), spec, panel), panel, before=spec.offset + spec.p)
    lagged = core(_differenced(rows, w, spec, panel)).filter(F.col("pos") > spec.offset + spec.p)
    lagged = lagged.select(*keys, "_v", *_lag_names(spec)).dropna()
    return centred_ridge(lagged, keys, "_v", _lag_names(spec), spec.alpha)


def _predicted(df: DataFrame, coef: DataFrame, spec: ARSpec, ranges: DataFrame | None, panel: Panel,
               reach: int = 0) -> tuple[DataFrame, WindowSpec]:
    """Rows with ``predicted`` and ``actual``, both NULL where a series has too short a past or no model."""
    fitted = attach(_scaled(index_panel(df, panel), spec, panel, ranges), coef, panel, "left")  # no model: NULL predictions
    start = spec.offset + spec.p
    rows, w = windowed(fitted, panel, before=start + spec.q + reach)
    rows = _differenced(rows, w, spec, panel)
    ahead = F.col("intercept")
    for k in range(spec.p):
        ahead = ahead + F.col("weights")[k] * F.col(f"_l{k + 1}")
    rows = rows.withColumn("_ahead", F.when(F.col("pos") > start, ahead))
    if spec.q:
        error = F.when(F.col("pos") > start, F.col("_ahead") - F.col("_v"))
        rows = rows.withColumn("_ahead", F.col("_ahead") + F.avg(error).over(w.rowsBetween(-spec.q, -1)))
    kept = F.col("pos") > start + spec.q
    predicted: Column = F.col("_ahead") if spec.log_difference else F.col("_ahead") + F.col("_base")
    actual = F.col("_v") if spec.log_difference else F.col(panel.value)
    rows = rows.withColumns({"predicted": F.when(kept, predicted), "actual": F.when(kept, actual)})
    dropped = ["_base", "_v", "_ahead", "intercept", "weights", *_lag_names(spec)]
    return rows.drop(*dropped), w


def ar_ridge_predict(df: DataFrame, coef: DataFrame, spec: ARSpec = ARSpec(), ranges: DataFrame | None = None,
                     panel: Panel = PANEL) -> DataFrame:
    """One-step forecasts ``(keys, ts, pos, n, predicted, actual)``.

    A series without a model has NULL predictions. In log mode both are scaled log differences. The scaler is refitted on ``df``
    itself unless ``ranges``, the min-max statistics of the training rows, are given.
    """
    rows, _ = _predicted(df, coef, spec, ranges, panel)
    kept = core(rows).filter(F.col("pos") > spec.offset + spec.p + spec.q)
    return kept.select(*panel.keys, panel.time, "pos", "n", "predicted", "actual")


def ar_ridge_scores(df: DataFrame, coef: DataFrame, spec: ARSpec = ARSpec(), ranges: DataFrame | None = None,
                    horizon: int = 1, panel: Panel = PANEL) -> DataFrame:
    """Forecast and score under one window layout, without a shuffle in between."""
    rows, w = _predicted(df, coef, spec, ranges, panel, reach=horizon)
    return score_columns(rows, w, list(panel.keys), horizon)


def recursive_forecast(df: DataFrame, coef: DataFrame, n_steps: int, spec: ARSpec = ARSpec(),
                       panel: Panel = PANEL) -> DataFrame:
    """``(keys, origin, step, predicted)``: ``n_steps`` differences ahead of every row.

    Each step feeds the previous prediction back as the newest lag.
    """
    scaled = _scaled(index_panel(df, panel), spec, panel)
    rows, w = windowed(attach(scaled, coef, panel), panel, before=spec.offset + spec.p)
    rows = core(_differenced(rows, w, spec, panel)).filter(F.col("pos") >= spec.offset + spec.p)
    state = F.array("_v", *_lag_names(spec)[:spec.p - 1])
    start = F.struct(state.alias("lags"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        ahead = F.array(F.col("intercept") + dot(F.col("weights"), acc["lags"]))
        return F.struct(F.concat(ahead, F.slice(acc["lags"], 1, spec.p - 1)).alias("lags"),
                        F.concat(acc["out"], ahead).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(n_steps)), start, step, lambda acc: acc["out"])
    return rows.select(*panel.keys, F.col(panel.time).alias("origin"), F.posexplode(path)).select(
        *panel.keys, "origin", (F.col("pos") + 1).alias("step"), F.col("col").alias("predicted"))
