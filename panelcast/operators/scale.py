"""Scaling statistics and transforms; all are pure, none overwrites its input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.functions.columns import safe_ln, scale_to_one, unscale_from_one
from panelcast.operators.index import attach, core, index_panel, windowed
from panelcast.operators.series import log_difference, train_stop
from panelcast.panel import PANEL, Panel


def minmax_stats(df: DataFrame, upper: str = "global_max", by: Sequence[str] | None = None,
                 panel: Panel = PANEL) -> DataFrame:
    """``(keys, low, high, upper)``: the range and the upper bound it is scaled to.

    ``global_max`` takes the largest value of one matrix: all series that share the
    ``by`` columns; ``by=None`` means the whole panel and ``by=panel.keys`` a matrix of
    one column. ``col_max_plus_1`` takes each series' own maximum plus one.
    """
    stats = df.groupBy(*panel.keys).agg(F.min(panel.value).alias("low"), F.max(panel.value).alias("high"))
    if upper == "col_max_plus_1":
        return stats.withColumn("upper", F.col("high") + 1.0)
    if upper != "global_max":
        raise ValueError(f"unknown upper bound {upper!r}")
    if by is None:
        return stats.withColumn("upper", stats.select(F.max("high")).scalar())
    if tuple(by) == tuple(panel.keys):
        return stats.withColumn("upper", F.col("high"))
    top = stats.groupBy(*by).agg(F.max("high").alias("upper"))
    return stats.join(top, list(by)).select(*panel.keys, "low", "high", "upper")


def minmax_scale(df: DataFrame, stats: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Scales every series to ``[1, upper]``."""
    held = attach(index_panel(df, panel), stats, panel)
    scaled = scale_to_one(F.col(panel.value), F.col("low"), F.col("high"), F.col("upper"))
    return held.withColumn(panel.value, scaled).drop("low", "high", "upper")


def scale_own_range(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Scales every series to ``[1, its own maximum]``.

    A bounded series already sits in one task for its positions, so its range is taken
    there in the same pass; otherwise the range is aggregated first and joined.
    """
    ix = index_panel(df, panel)
    if not panel.bounded:
        return minmax_scale(ix, minmax_stats(ix, by=panel.keys, panel=panel), panel)
    x, w = F.col(panel.value), Window.partitionBy(*panel.keys)
    ranged = ix.withColumns({"_low": F.min(x).over(w), "_high": F.max(x).over(w)})
    scaled = scale_to_one(x, F.col("_low"), F.col("_high"), F.col("_high"))
    return ranged.withColumn(panel.value, scaled).drop("_low", "_high")


def scale_log_difference(df: DataFrame, upper: str = "global_max", by: Sequence[str] | None = None,
                         panel: Panel = PANEL) -> DataFrame:
    """Min-max scale to ``[1, upper]``, then the log difference."""
    ix = index_panel(df, panel)
    if upper == "global_max" and by is not None and tuple(by) == tuple(panel.keys):
        return log_difference(scale_own_range(ix, panel), panel)
    return log_difference(minmax_scale(ix, minmax_stats(ix, upper, by, panel), panel), panel)


def inverse_log_scale(df: DataFrame, pred: DataFrame, stats: DataFrame, panel: Panel = PANEL,
                      predicted: str = "predicted") -> DataFrame:
    """Predicted log differences back to the original units.

    ``df`` is the original panel, ``stats`` its min-max statistics: the prediction is
    added to the log of the previous scaled value, exponentiated and unscaled.
    """
    rows, w = windowed(minmax_scale(df, stats, panel), panel, before=1)
    past = core(rows.withColumn("_past", F.lag(safe_ln(F.col(panel.value)), 1).over(w)).filter("pos > 1"))
    keys = [*panel.keys, panel.time]
    joined = pred.select(*keys, predicted).join(past.select(*keys, "pos", "n", "_past"), keys)
    restored = attach(joined, stats, panel)
    level = unscale_from_one(F.exp(F.col(predicted) + F.col("_past")), F.col("low"), F.col("high"), F.col("upper"))
    return restored.select(*keys, level.alias("restored"))


def standard_stats(df: DataFrame, train_only: bool = True, fraction: float = 0.8, panel: Panel = PANEL) -> DataFrame:
    """``(keys, mean, sd)`` with the population sd, by default of the training rows only."""
    if train_only:
        df = index_panel(df, panel).filter(F.col("pos") <= train_stop(fraction))
    return df.groupBy(*panel.keys).agg(F.avg(panel.value).alias("mean"), F.stddev_pop(panel.value).alias("sd"))


def standardize(df: DataFrame, stats: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """``(x - mean) / sd``; a constant series is only centred."""
    held = attach(index_panel(df, panel), stats, panel)
    z = (F.col(panel.value) - F.col("mean")) / F.coalesce(F.nullif("sd", F.lit(0.0)), F.lit(1.0))
    return held.withColumn(panel.value, z).drop("mean", "sd")
