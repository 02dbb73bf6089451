"""Vector ridge autoregression over neighbourhoods of series, all centres in one job.

A neighbourhood's hour is one row with an array of its members' values, centre first,
so neighbourhoods of different sizes share a plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.columns import dot, safe_ln, scale_to_one, unscale_from_one
from panelcast.models.moments import gram, solve_ridge
from panelcast.operators.index import attach, core, index_panel, rebase, windowed
from panelcast.operators.series import train_stop
from panelcast.panel import MATRIX, Panel


@dataclass(frozen=True)
class VARSpec:
    """``outputs='all'`` predicts every member, ``'center'`` the first one only.

    In log mode members are scaled before they are differenced: to ``[1, largest value of all]`` (``'joint'``), to ``[1, own
    largest value]`` (``'member'``) or to ``[1, own largest value + 1]`` (``'member_plus_one'``).
    """

    look_back: int = 2
    horizon: int = 1
    alpha: float = 1.0
    log_difference: bool = True
    train_fraction: float = 0.6
    outputs: str = "all"
    scaling: str = "joint"

    def upper(self, i: Column) -> Column:
        """The value that member ``i``'s largest is scaled to."""
        if self.scaling == "joint":
            return F.col("upper")
        if self.scaling not in ("member", "member_plus_one"):
            raise ValueError(f"unknown scaling {self.scaling!r}")
        return F.get("highs", i) + (1.0 if self.scaling == "member_plus_one" else 0.0)


def members(neighborhood: DataFrame) -> DataFrame:
    """``(center, members)``: names of a neighbourhood, centre first, then in order."""
    place = F.struct((~F.col("is_center")).alias("later"), "node")
    return neighborhood.groupBy("center").agg(
        F.transform(F.sort_array(F.collect_list(place)), lambda m: m["node"]).alias("members"))


def to_matrix(rows: DataFrame, neighborhood: DataFrame, fill: float | None = None, time: str = "ts",
              value: str = "value") -> DataFrame:
    """``(center, ts, values)``; hours that lack a member are dropped, or filled with ``fill``.

    Each row brings its member's place along, so an hour's cells are put in order without a lookup.
    """
    listed = members(neighborhood)
    places = listed.select("center", F.posexplode("members").alias("_place", "node"), F.size("members").alias("_size"))
    placed = rows.join(places, ["center", "node"])
    # a repeated hour is averaged; both groupings share the one shuffle
    once = placed.repartition("center", time).groupBy("center", time, "_place").agg(
        F.avg(value).alias("_value"), F.first("_size").alias("_size"))
    cells = once.filter(F.col("_value").isNotNull() | F.lit(fill is not None)).groupBy("center", time).agg(
        F.sort_array(F.collect_list(F.struct("_place", "_value"))).alias("_cells"), F.first("_size").alias("_size"))
    if fill is None:
        whole = cells.filter(F.size("_cells") == F.col("_size"))
        return whole.select("center", time, F.col("_cells._value").alias("values"))
    lookup = F.map_from_entries("_cells")
    filled = F.transform(F.sequence(F.lit(0), F.col("_size") - 1), lambda i: F.coalesce(F.element_at(lookup, i), F.lit(float(fill))))
    return cells.select("center", time, filled.alias("values"))


def matrix_stats(matrix: DataFrame, panel: Panel = MATRIX) -> DataFrame:
    """Per centre the members' minima, maxima and means, and the largest value of all."""
    keys = list(panel.keys)
    columns = matrix.select(*keys, F.posexplode(panel.value)).groupBy(*keys, "pos").agg(
        F.min("col").alias("low"), F.max("col").alias("high"), F.avg("col").alias("mean"))
    listed = columns.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("pos", "low", "high", "mean"))).alias("s"))
    return listed.select(*keys, F.col("s.low").alias("lows"), F.col("s.high").alias("highs"),
                         F.col("s.mean").alias("means"), F.array_max("s.high").alias("upper"))


def log_difference_matrix(matrix: DataFrame, spec: VARSpec = VARSpec(), panel: Panel = MATRIX, ranges: DataFrame | None = None) -> DataFrame:
    """The matrix with its members scaled as ``spec`` says and log-differenced; the first row of a centre goes."""
    ix = attach(index_panel(matrix, panel), matrix_stats(matrix, panel) if ranges is None else ranges, panel)
    scaled = F.transform(panel.value, lambda v, i: safe_ln(scale_to_one(v, F.get("lows", i), F.get("highs", i), spec.upper(i))))
    rows, w = windowed(ix.withColumn("_s", scaled), panel, before=1)
    rows = core(rows.withColumn(panel.value, F.zip_with("_s", F.lag("_s", 1).over(w), lambda a, b: a - b)).filter("pos > 1"))
    return rebase(rows.select(*panel.keys, panel.time, panel.value, "pos", "n"), 1)


def _lagged(matrix: DataFrame, spec: VARSpec, panel: Panel, ranges: DataFrame | None = None) -> DataFrame:
    """Adds lag vector ``x`` (lag-major), target vector ``y`` and the row number ``row`` of ``rows``.

    Rows start two places after the last lag and end where the target would leave the
    series. In log mode members are scaled by ``ranges`` (their own by default) and log-differenced; ``past`` is then the
    scaled log before the target.
    """
    off = 1 if spec.log_difference else 0
    ix = attach(index_panel(matrix, panel), matrix_stats(matrix, panel) if ranges is None else ranges, panel)
    rows, w = windowed(ix, panel, before=spec.look_back + off, after=spec.horizon - 1)
    if spec.log_difference:
        scaled = F.transform(panel.value, lambda v, i: scale_to_one(v, F.get("lows", i), F.get("highs", i), spec.upper(i)))
        rows = rows.withColumn("_s", F.transform(scaled, safe_ln))
        before = F.lag("_s", 1).over(w)
        past = before if spec.horizon == 1 else F.col("_s") if spec.horizon == 2 else F.lead("_s", spec.horizon - 2).over(w)
        rows = rows.withColumn("past", past)
        v = F.zip_with("_s", before, lambda a, b: a - b)
    else:
        v = F.col(panel.value)
    rows = rows.withColumn("_v", v)
    x = F.concat(*[F.lag("_v", k).over(w) for k in range(1, spec.look_back + 1)])
    y = F.lead("_v", spec.horizon - 1).over(w) if spec.horizon > 1 else F.col("_v")
    rows = rows.withColumns({"x": x, "y": F.slice(y, 1, 1) if spec.outputs == "center" else y})
    first = spec.look_back + 1 + off
    rows = core(rows).filter((F.col("pos") > first) & (F.col("pos") + spec.horizon - 1 <= F.col("n")))
    return rows.withColumn("row", F.col("pos") - first).withColumn(
        "rows", F.col("n") - first - (spec.horizon - 1))


def _complete() -> Column:
    return ~(F.exists("x", lambda v: v.isNull()) | F.exists("y", lambda v: v.isNull()))


def incomplete_rows(matrix: DataFrame, spec: VARSpec = VARSpec(), panel: Panel = MATRIX) -> DataFrame:
    """``(center, incomplete)``: training rows that a fit leaves out, because a lag or target is NULL."""
    rows = _lagged(matrix, spec, panel).filter(F.col("row") <= train_stop(spec.train_fraction, F.col("rows")))
    return rows.groupBy(*panel.keys).agg(F.count_if(~_complete()).alias("incomplete"))


def var_ridge_fit(matrix: DataFrame, spec: VARSpec = VARSpec(), panel: Panel = MATRIX) -> DataFrame:
    """``(center, coefs)`` from the first ``train_fraction`` of the lag rows, without those that hold a NULL."""
    keys = list(panel.keys)
    rows = _lagged(matrix, spec, panel)
    train = rows.filter((F.col("row") <= train_stop(spec.train_fraction, F.col("rows"))) & _complete())
    if spec.log_difference:
        return solve_ridge(gram(train, keys), keys, spec.alpha)
    # centre before products are summed, then undo the shift in the intercept
    def centred(arr: str):
        return F.transform(arr, lambda v, i: v - F.get("means", i % F.size("means")))
    shifted = train.select(*keys, centred("x").alias("x"), centred("y").alias("y"))
    solved = solve_ridge(gram(shifted, keys), keys, spec.alpha)
    means = matrix_stats(matrix, panel).select(*keys, "means")
    tiled = F.flatten(F.array_repeat("means", spec.look_back))
    moved = F.transform("coefs", lambda c, i: F.struct(
        (c["intercept"] + F.get("means", i) - dot(c["weights"], F.col("tiled"))).alias("intercept"),
        c["weights"].alias("weights")))
    return solved.join(means, keys).withColumn("tiled", tiled).select(*keys, moved.alias("coefs"))


def var_ridge_predict(matrix: DataFrame, coef: DataFrame, spec: VARSpec = VARSpec(), panel: Panel = MATRIX,
                      ranges: DataFrame | None = None, restore: bool = False) -> DataFrame:
    """``(center, member, ts, pos, n, predicted, actual)``; member 0 is the centre.

    In log mode the scaler is refitted on ``matrix`` unless ``ranges``, the :func:`matrix_stats` of the training rows, are
    given, and predictions are scaled log differences. ``restore`` adds ``restored`` and ``restored_actual``, both in the
    units of the matrix: the difference is added to the scaled log before the target, exponentiated and unscaled.
    """
    rows = attach(_lagged(matrix, spec, panel, ranges), coef, panel)

    def level(v: Column, i: Column) -> Column:
        if not spec.log_difference:
            return v
        return unscale_from_one(F.exp(v + F.get("past", i)), F.get("lows", i), F.get("highs", i), spec.upper(i))

    def pair(c: Column, i: Column) -> Column:
        predicted, actual = c["intercept"] + dot(c["weights"], F.col("x")), F.get("y", i)
        more = [level(predicted, i).alias("restored"), level(actual, i).alias("restored_actual")] if restore else []
        return F.struct(predicted.alias("predicted"), actual.alias("actual"), *more)

    numbered = rows.select(*panel.keys, panel.time, F.col("row").alias("pos_"), F.col("rows").alias("n_"),
                           F.posexplode(F.transform("coefs", pair)))
    return numbered.select(*panel.keys, F.col("pos").alias("member"), panel.time, F.col("pos_").alias("pos"),
                           F.col("n_").alias("n"), "col.*")


def var_recursive_forecast(matrix: DataFrame, coef: DataFrame, n_steps: int, spec: VARSpec = VARSpec(),
                           panel: Panel = MATRIX) -> DataFrame:
    """``(center, origin, step, member, predicted)``: ``n_steps`` vectors after every row with ``look_back`` rows up to it.

    Predictions are of the rows' own kind: scaled log differences in log mode. The state of the fold is the lag matrix; each
    step is one product with the coefficients, and its vector becomes the newest lag. Needs a model of all members.
    """
    if spec.outputs != "all" or spec.horizon != 1:
        raise ValueError("a recursion needs one-step models of all members")
    off = 1 if spec.log_difference else 0
    ix = attach(index_panel(matrix, panel), matrix_stats(matrix, panel), panel)
    rows, w = windowed(ix, panel, before=spec.look_back + off)
    if spec.log_difference:
        scaled = F.transform(panel.value, lambda v, i: scale_to_one(v, F.get("lows", i), F.get("highs", i), spec.upper(i)))
        rows = rows.withColumn("_s", F.transform(scaled, safe_ln))
        rows = rows.withColumn("_v", F.zip_with("_s", F.lag("_s", 1).over(w), lambda a, b: a - b))
    else:
        rows = rows.withColumn("_v", F.col(panel.value))
    lags = F.concat("_v", *[F.lag("_v", k).over(w) for k in range(1, spec.look_back)])
    held = core(rows.withColumn("_x", lags)).filter(F.col("pos") >= spec.look_back + off)
    start = F.struct(F.col("_x").alias("lags"), F.array().cast("array<array<double>>").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        ahead = F.transform("coefs", lambda c: c["intercept"] + dot(c["weights"], acc["lags"]))
        return F.struct(F.concat(ahead, F.slice(acc["lags"], F.lit(1), F.size(acc["lags"]) - F.size("coefs"))).alias("lags"),
                        F.concat(acc["out"], F.array(ahead)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(n_steps)), start, step, lambda acc: acc["out"])
    steps = attach(held, coef, panel).select(*panel.keys, F.col(panel.time).alias("origin"), F.posexplode(path).alias("_step", "_values"))
    return steps.select(*panel.keys, "origin", (F.col("_step") + 1).alias("step"), F.posexplode("_values").alias("member", "predicted"))
