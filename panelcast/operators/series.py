"""Positional time-series operators on a long panel.

Each takes a panel and returns an indexed panel (``pos``, ``n`` included), so chained
operators number the rows once. Offsets count rows, not hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import calendar_columns, compand_bin, expand_bin, safe_ln
from panelcast.operators.index import core, index_panel, rebase, windowed
from panelcast.panel import PANEL, Panel


# --- differences -------------------------------------------------------------------------

def difference(df: DataFrame, lag: int, panel: Panel = PANEL) -> DataFrame:
    """``x[t] - x[t-lag]``; the first ``lag`` rows of a series are dropped."""
    rows, w = windowed(df, panel, before=lag)
    x = F.col(panel.value)
    out = rows.withColumn(panel.value, x - F.lag(x, lag).over(w))
    return rebase(core(out.filter(F.col("pos") > lag)), lag)


def undifference(df: DataFrame, diff: DataFrame, lag: int, panel: Panel = PANEL) -> DataFrame:
    """Restores ``v[t] + x[t-lag]`` from differences ``diff`` and the original panel."""
    rows, w = windowed(df, panel, before=lag)
    base = core(rows.withColumn("_base", F.lag(panel.value, lag).over(w)).filter(F.col("pos") > lag))
    keys = [*panel.keys, panel.time]
    joined = diff.select(*keys, F.col(panel.value).alias("_v")).join(base, keys)
    return rebase(joined.withColumn(panel.value, F.col("_v") + F.col("_base")).drop("_v", "_base"), lag)


def log_difference(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """``ln x[t] - ln x[t-1]``; NULL where either value is not positive."""
    logged = df.withColumn(panel.value, safe_ln(F.col(panel.value)))
    return difference(logged, 1, panel)


def nonpositive_counts(df: DataFrame, panel: Panel = PANEL) -> DataFrame:
    """Per series, how many values a log difference would turn into NULL."""
    return df.groupBy(*panel.keys).agg(F.count_if(~(F.col(panel.value) > 0)).alias("n_nonpositive"))


# --- lag features and windows ------------------------------------------------------------

def lag_features(df: DataFrame, p: int, panel: Panel = PANEL) -> DataFrame:
    """Adds ``lag_1..lag_p``; rows without all lags are dropped."""
    rows, w = windowed(df, panel, before=p)
    out = rows.select("*", *[F.lag(panel.value, k).over(w).alias(f"lag_{k}") for k in range(1, p + 1)])
    return core(out.filter(F.col("pos") > p))


def lag_dataset(df: DataFrame, look_back: int, horizon: int = 1, panel: Panel = PANEL) -> DataFrame:
    """Lag vector plus direct ``horizon``-step target.

    The first legal target position is skipped, so rows start at ``look_back + 2``.
    """
    rows, w = windowed(df, panel, before=look_back, after=horizon - 1)
    lags = [F.lag(panel.value, k).over(w).alias(f"lag_{k}") for k in range(1, look_back + 1)]
    target = F.lead(panel.value, horizon - 1).over(w) if horizon > 1 else F.col(panel.value)
    out = rows.select("*", *lags, target.alias("target"))
    return core(out.filter((F.col("pos") >= look_back + 2) & (F.col("pos") + horizon - 1 <= F.col("n"))))


def lag_dataset_split(look_back: int, horizon: int = 1, fraction: float = 0.6) -> Column:
    """``train`` / ``test`` for the rows of a lag dataset: the first ``fraction`` of them train."""
    row = F.col("pos") - (look_back + 1)
    rows = F.col("n") - (look_back + 1) - (horizon - 1)
    return F.when(row <= F.floor(F.lit(float(fraction)) * rows), "train").otherwise("test")


def receptive_field(filter_width: int, dilations: Sequence[int], initial_width: int) -> int:
    return (filter_width - 1) * sum(dilations) + initial_width


def sliding_sequences(df: DataFrame, rf: int, horizon: int = 1, panel: Panel = PANEL) -> DataFrame:
    """``past`` (the last ``rf`` values, oldest first) and ``target`` ``horizon`` rows ahead.

    The last legal window is left out, as the rule ``start + rf + horizon < length``
    asks. Windows repeat each value ``rf`` times: consume them in the same stage
    rather than storing them. A missing value is NaN inside ``past``.
    """
    rows, w = windowed(df, panel, before=rf - 1, after=horizon)
    x = F.coalesce(F.col(panel.value), F.lit(float("nan")))
    out = rows.withColumn("past", F.collect_list(x).over(w.rowsBetween(-(rf - 1), 0))).withColumn(
        "target", F.lead(panel.value, horizon).over(w))
    return core(out.filter((F.col("pos") >= rf) & (F.col("pos") + horizon <= F.col("n") - 1)))


def chunk_sequences(df: DataFrame, length: int, compat: bool = True, panel: Panel = PANEL) -> DataFrame:
    """Non-overlapping chunks of ``length`` values, the last one padded with zeros.

    With ``compat`` a series whose size is a multiple of ``length`` gets one more,
    all-zero chunk.
    """
    ix = index_panel(df, panel)
    chunk = F.floor((F.col("pos") - 1) / length)
    chunks = F.array(chunk)
    if compat:
        closes = (F.col("pos") == F.col("n")) & (F.col("n") % length == 0)
        chunks = F.when(closes, F.array(chunk, chunk + 1)).otherwise(chunks)
    placed = ix.withColumn("chunk", F.explode(chunks))
    cell = F.when(F.col("chunk") == chunk, F.struct("pos", F.col(panel.value).alias("v")))
    grouped = placed.groupBy(*panel.keys, "chunk").agg(F.sort_array(F.collect_list(cell)).alias("_cells"))
    values = F.transform("_cells", lambda c: c["v"])
    padding = F.array_repeat(F.lit(0.0), (F.lit(length) - F.size("_cells")).cast("int"))
    return grouped.select(*panel.keys, "chunk", F.concat(values, padding).alias("values"))


def dilated_filter(df: DataFrame, weights: Sequence[float], dilation: int, panel: Panel = PANEL) -> DataFrame:
    """Causal filter ``sum_k w_k x[t - (W-1-k) * dilation]``; rows without a full window are dropped."""
    reach = (len(weights) - 1) * dilation
    rows, w = windowed(df, panel, before=reach)
    x = F.col(panel.value)
    terms = [float(wk) * (F.lag(x, (len(weights) - 1 - k) * dilation).over(w) if k < len(weights) - 1 else x)
             for k, wk in enumerate(weights)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return rebase(core(rows.withColumn(panel.value, total).filter(F.col("pos") > reach)), reach)


# --- splits ------------------------------------------------------------------------------

def train_stop(fraction: float, n: Column | None = None) -> Column:
    return F.floor(F.lit(float(fraction)) * (F.col("n") if n is None else n))


def chrono_split(df: DataFrame, fraction: float = 0.8, panel: Panel = PANEL, inner: float | None = None) -> DataFrame:
    """Adds ``split``: the first ``floor(fraction * n)`` rows train, the rest test.

    With ``inner`` the training rows are cut once more, into ``train`` and ``val``.
    """
    ix = index_panel(df, panel)
    stop = train_stop(fraction)
    label = F.when(F.col("pos") > stop, "test")
    if inner is not None:
        label = label.when(F.col("pos") > train_stop(inner, stop), "val")
    return ix.withColumn("split", label.otherwise("train"))


def take_split(df: DataFrame, part: str, fraction: float = 0.8, panel: Panel = PANEL) -> DataFrame:
    """One side of the chronological split as a panel of its own, numbered from 1."""
    ix = index_panel(df, panel)
    stop = train_stop(fraction)
    if part == "train":
        return ix.filter(F.col("pos") <= stop).withColumn("n", stop)
    return rebase(ix.filter(F.col("pos") > stop).withColumn("_stop", stop), F.col("_stop")).drop("_stop")


# --- calendar, correlation, companding ---------------------------------------------------

def calendar_features(df: DataFrame, time: str = "ts") -> DataFrame:
    """Adds ``hour``, ``month``, ``weekday`` (Monday = 0) and ``day_name``."""
    return df.withColumns(calendar_columns(F.col(time)))


def autocorrelation(df: DataFrame, max_lag: int = 24, panel: Panel = PANEL) -> DataFrame:
    """``(keys, lag, r)`` for lags ``1..max_lag-1``: Pearson r of the overlapping pairs.

    One windowed scan yields all lags; each task reduces its rows to one partial
    correlation per series and lag before anything is shuffled. No row is multiplied.
    """
    lags = range(1, max_lag)
    rows, w = windowed(df, panel, before=max_lag - 1)
    x = F.col(panel.value)
    lagged = core(rows.select("*", *[F.lag(x, k).over(w).alias(f"_past_{k}") for k in lags]))
    found = lagged.groupBy(*panel.keys).agg(F.array(*[F.corr(panel.value, f"_past_{k}") for k in lags]).alias("_r"))
    return found.select(*panel.keys, F.posexplode("_r").alias("_k", "r")).select(
        *panel.keys, (F.col("_k") + 1).alias("lag"), "r")


def companded_histogram(df: DataFrame, channels: int = 256, panel: Panel = PANEL) -> DataFrame:
    """Mu-law bins of values in [-1, 1]: rows per bin and the mean error of decoding the bin."""
    mu = float(channels - 1)
    x = F.col(panel.value)
    clipped = F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0))
    binned = df.filter(x.isNotNull()).withColumn("bin", compand_bin(x, mu))
    error = F.abs(clipped - expand_bin(F.col("bin"), mu))
    return binned.groupBy(*panel.keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("mean_abs_error"))


def window_mase(windows: DataFrame, predicted: str = "predicted", by: Sequence[str] = ("series_id",)) -> DataFrame:
    """MAE over the mean absolute step inside each window (past values and target)."""
    seq = F.concat("past", F.array("target"))
    n = F.size(seq)
    steps = F.zip_with(F.slice(seq, F.lit(2), n - 1), F.slice(seq, F.lit(1), n - 1), lambda a, b: F.abs(a - b))
    scored = windows.select(*by, F.abs(F.col("target") - F.col(predicted)).alias("_e"),
                            F.aggregate(steps, F.lit(0.0), lambda a, v: a + v).alias("_s"), (n - 1).alias("_k"))
    step = F.sum("_s") / F.sum("_k")
    return scored.groupBy(*by).agg(F.avg("_e").alias("mae"), step.alias("mean_abs_step"),
                                   (F.avg("_e") / F.nullif(step, F.lit(0.0))).alias("mase"))


