"""Forecast scores and the evaluation report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.index import core, windowed
from panelcast.panel import PANEL, Panel

METRICS = ("mae", "mase", "hits")


def persistence_forecast(df: DataFrame, horizon: int = 1, panel: Panel = PANEL) -> DataFrame:
    """The value ``horizon`` rows ago as the prediction; NULL on the first rows."""
    rows, w = windowed(df, panel, before=horizon)
    x = F.col(panel.value)
    return core(rows.withColumn("predicted", F.lag(x, horizon).over(w)).withColumn("actual", x)).drop(panel.value)


def score_columns(df: DataFrame, w, by: Sequence[str], horizon: int) -> DataFrame:
    """Aggregates scores of rows that already carry ``predicted`` and ``actual`` under window ``w``."""
    p, a = F.col("predicted"), F.col("actual")
    steps = core(df.withColumns({
        "_naive": F.abs(a - F.lag("actual", horizon).over(w)),
        "_agree": (p - F.lag("predicted", 1).over(w)) * (a - F.lag("actual", 1).over(w)) > 0,
    }))
    mae, naive = F.avg(F.abs(p - a)), F.avg("_naive")
    return steps.groupBy(*by).agg(
        mae.alias("mae"),
        naive.alias("naive_mae"),
        (mae / F.nullif(naive, F.lit(0.0))).alias("mase"),
        F.avg(F.when(F.col("_agree"), F.abs(p))).alias("hits"),
        F.avg(F.col("_agree").cast("double")).alias("hit_rate"),
    )


def forecast_metrics(pred_df: DataFrame, by: Sequence[str] | None = None, horizon: int = 1,
                     panel: Panel = PANEL) -> DataFrame:
    """``(by, mae, naive_mae, mase, hits, hit_rate)`` of rows ``(keys, ts, predicted, actual)``.

    ``mase`` divides pooled means, over all series of a group. ``hits`` is the mean
    absolute prediction on steps whose direction agrees; ``hit_rate`` is their share.
    """
    rows, w = windowed(pred_df, panel, before=max(horizon, 1))
    return score_columns(rows, w, list(by or panel.keys), horizon)


def metrics_report(metrics: DataFrame, by: Sequence[str] = ("node", "type")) -> DataFrame:
    """Mean and population sd over repeated runs, also as ``mean+/-sd`` text."""
    stats = metrics.groupBy(*by).agg(
        *[F.avg(m).alias(f"{m}_avg") for m in METRICS],
        *[F.stddev_pop(m).alias(f"{m}_sd") for m in METRICS])
    texts = [F.format_string("%f+/-%f", F.col(f"{m}_avg"), F.col(f"{m}_sd")).alias(m) for m in METRICS]
    return stats.select(*by, *[f"{m}_{s}" for m in METRICS for s in ("avg", "sd")], *texts)


def plain_report(metrics: DataFrame, by: Sequence[str] = ("node",)) -> DataFrame:
    """Scores of single runs as ``%f`` text, one row per group."""
    return metrics.select(*by, *[F.format_string("%f", F.col(m)).alias(m) for m in METRICS])
