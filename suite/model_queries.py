"""Ridge autoregressions, vector autoregressions, ARMA grids, nonlinear models and reports."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from panelcast.models.ar import ARSpec, ar_ridge_fit, ar_ridge_predict, recursive_forecast
from panelcast.models.arma import arma_grid_posterior, arma_residual_ss
from panelcast.models.moments import gram
from panelcast.models.nonlinear import NonlinearSpec, hidden_layer, nonlinear_ar, nonlinear_fit, nonlinear_predict
from panelcast.models.scoring import roll_forward, score_panel, score_windows
from panelcast.models.var import VARSpec, log_difference_matrix, to_matrix, var_recursive_forecast, var_ridge_fit
from panelcast.operators import metrics as M
from panelcast.operators import scale as SC
from panelcast.operators import series as S
from panelcast.operators.graph import neighbor_panel
from panelcast.operators.index import index_panel
from panelcast.operators.reshape import node_catalog
from panelcast.plans.datasets import neighborhood_matrix
from panelcast.plans.evaluation import evaluate_ar, evaluate_grid, evaluate_seeds, evaluate_var, evaluate_var_grid, forecast_var
from panelcast.session import stored
from panelcast.sources.writers import write_report
from suite.registry import query
from suite.series_queries import metrics_sql, scores
from suite.tables import (DAILY, EV, EV_NAMES, HOURLY, LI, LI_NAMES, MONTHLY, RAW, RAW_EV, edges, events_hourly, events_raw,
                          families, label_catalog, label_monthly, r, scratch, sql_family_rows, sql_ix, sql_r, sql_scaled, sql_stamp,
                          stamp, supplier_daily, supplier_names)

_W = "(PARTITION BY series_id ORDER BY ts)"


# --- SQL builders ------------------------------------------------------------------------

def sql_solve(moments: str, keys: str, p: int, outs: int = 1) -> str:
    """Gauss-Jordan elimination of ``a{i}_{j} w = b{i}_{o}`` row by row; yields ``w{i}_{o}``."""
    src = f"({moments})"
    for k in range(1, p + 1):
        cols = [keys]
        for i in range(1, p + 1):
            for j in range(k + 1, p + 1):
                cols.append(f"a{i}_{j}" if i == k else f"a{i}_{j} - a{i}_{k} / a{k}_{k} * a{k}_{j} AS a{i}_{j}")
            for o in range(1, outs + 1):
                cols.append(f"b{i}_{o}" if i == k else f"b{i}_{o} - a{i}_{k} / a{k}_{k} * b{k}_{o} AS b{i}_{o}")
            if i <= k:
                cols.append(f"a{k}_{k} AS d{i}" if i == k else f"d{i}")
        # earlier diagonals stay as they are once their column is eliminated
        src = f"(SELECT {', '.join(cols)} FROM {src})"
    w = ", ".join(f"b{i}_{o} / d{i} AS w{i}_{o}" for i in range(1, p + 1) for o in range(1, outs + 1))
    return f"SELECT {keys}, {w} FROM {src}"


def sql_ridge(rows: str, key: str, xs: list[str], ys: list[str], alpha: float = 1.0) -> str:
    """Ridge weights ``w{i}_{o}`` and intercepts ``c{o}`` per key from rows with inputs and outputs."""
    p, q = len(xs), len(ys)
    parts = [f"{key}"]
    for i in range(p):
        for j in range(p):
            extra = f" + {alpha}" if i == j else ""
            parts.append(f"count(*) * covar_pop({xs[i]}, {xs[j]}){extra} AS a{i + 1}_{j + 1}")
        for o in range(q):
            parts.append(f"count(*) * covar_pop({xs[i]}, {ys[o]}) AS b{i + 1}_{o + 1}")
    moments = f"SELECT {', '.join(parts)} FROM ({rows}) GROUP BY {key}"
    means = ", ".join([f"avg({x}) AS mx{i + 1}" for i, x in enumerate(xs)] + [f"avg({y}) AS my{o + 1}" for o, y in enumerate(ys)])
    cs = ", ".join(f"my{o} - ({' + '.join(f'w{i}_{o} * mx{i}' for i in range(1, p + 1))}) AS c{o}" for o in range(1, q + 1))
    return f"""SELECT s.*, {cs} FROM ({sql_solve(moments, key, p, q)}) s
      JOIN (SELECT {key}, {means} FROM ({rows}) GROUP BY {key}) m USING ({key})"""


def _split_parts(panel: str, fraction: float = 0.8) -> tuple[str, str]:
    stop = f"floor(CAST({fraction} AS DOUBLE) * n)"
    ix = sql_ix(panel)
    return (f"SELECT series_id, ts, value, pos FROM ({ix}) WHERE pos <= {stop}",
            f"SELECT series_id, ts, value, CAST(pos - {stop} AS BIGINT) AS pos FROM ({ix}) WHERE pos > {stop}")


def _differenced(source: str, spec: ARSpec) -> str:
    if spec.log_difference:
        base = f"SELECT *, lag(ln(s)) OVER {_W} AS base FROM ({sql_scaled(source)})"
    else:
        base = f"""SELECT *, value - lag(value, {spec.lag}) OVER {_W} AS v, lag(value, {spec.lag}) OVER {_W} AS base
          FROM ({source})"""
    lags = ", ".join(f"lag(v, {k}) OVER {_W} AS l{k}" for k in range(1, spec.p + 1))
    return f"SELECT *, {lags} FROM ({base})"


def sql_ar_fit(source: str, spec: ARSpec) -> str:
    rows = f"SELECT * FROM ({_differenced(source, spec)}) WHERE pos > {spec.offset + spec.p}"
    return sql_ridge(rows, "series_id", [f"l{k}" for k in range(1, spec.p + 1)], ["v"], spec.alpha)


def sql_ar_predict(source: str, fit: str, spec: ARSpec) -> str:
    start = spec.offset + spec.p
    ahead = " + ".join(["c1"] + [f"w{k}_1 * l{k}" for k in range(1, spec.p + 1)])
    corrected = f"SELECT *, {ahead} AS vh FROM ({_differenced(source, spec)}) JOIN ({fit}) USING (series_id) WHERE pos > {start}"
    if spec.q:
        corrected = f"""SELECT * EXCLUDE (vh), vh + avg(vh - v) OVER (PARTITION BY series_id ORDER BY ts
          ROWS BETWEEN {spec.q} PRECEDING AND 1 PRECEDING) AS vh FROM ({corrected})"""
    level = ("vh", "v") if spec.log_difference else ("vh + base", "value")
    return f"""SELECT series_id, ts, pos, {level[0]} AS predicted, {level[1]} AS actual
      FROM ({corrected}) WHERE pos > {start + spec.q}"""


def sql_ar_scores(panel: str, spec: ARSpec, rounded: bool = True) -> str:
    train, test = _split_parts(panel)
    return metrics_sql(sql_ar_predict(test, sql_ar_fit(train, spec), spec), rounded=rounded)


# --- ridge autoregression ----------------------------------------------------------------

LOG2 = ARSpec(p=2, lag=1, q=2, log_difference=True)
LEVEL2 = ARSpec(p=2, lag=1, q=2, log_difference=False)
SEASONAL = ARSpec(p=2, lag=24, q=2, log_difference=False)
LEVEL1 = ARSpec(p=1, lag=7, q=0, log_difference=False)
LOG5 = ARSpec(p=5, q=3, log_difference=True)


@query("ar_fit_suppliers", f"""SELECT series_id, {sql_r('c1', 5)} AS intercept, {sql_r('w1_1', 5)} AS w1, {sql_r('w2_1', 5)} AS w2
  FROM ({sql_ar_fit(sql_ix(LI), LOG2)})""")
def ar_fit_suppliers(spark, sf_dir):
    coef = ar_ridge_fit(supplier_daily(spark, sf_dir), LOG2, DAILY)
    return coef.select("series_id", r("intercept", 5).alias("intercept"), r(F.col("weights")[0], 5).alias("w1"),
                       r(F.col("weights")[1], 5).alias("w2"))


@query("ar_fit_five_lags", f"""SELECT series_id, {sql_r('c1', 5)} AS intercept, {', '.join(f"{sql_r(f'w{k}_1', 5)} AS w{k}" for k in range(1, 6))}
  FROM ({sql_ar_fit(sql_ix(EV), LOG5)})""")
def ar_fit_five_lags(spark, sf_dir):
    coef = ar_ridge_fit(events_hourly(spark, sf_dir), LOG5, HOURLY)
    return coef.select("series_id", r("intercept", 5).alias("intercept"),
                       *[r(F.col("weights")[k], 5).alias(f"w{k + 1}") for k in range(5)])


def _predict_sql(panel, spec, digits):
    train, test = _split_parts(panel)
    return f"""SELECT series_id, {sql_stamp()} AS ts, {sql_r('predicted', digits)} AS predicted, {sql_r('actual', digits)} AS actual
      FROM ({sql_ar_predict(test, sql_ar_fit(train, spec), spec)})"""


def _predict(panel_df, spec, panel, digits):
    ix = index_panel(panel_df, panel)
    coef = ar_ridge_fit(S.take_split(ix, "train", 0.8, panel), spec, panel)
    pred = ar_ridge_predict(S.take_split(ix, "test", 0.8, panel), coef, spec, panel=panel)
    return pred.select("series_id", stamp("ts").alias("ts"), r("predicted", digits).alias("predicted"),
                       r("actual", digits).alias("actual"))


@query("ar_forecast_seasonal", _predict_sql(EV, SEASONAL, 5))
def ar_forecast_seasonal(spark, sf_dir):
    return _predict(events_hourly(spark, sf_dir), SEASONAL, HOURLY, 5)


@query("ar_forecast_no_correction", _predict_sql(LI, LEVEL1, 3))
def ar_forecast_no_correction(spark, sf_dir):
    return _predict(supplier_daily(spark, sf_dir), LEVEL1, DAILY, 3)


@query("ar_scores_events", sql_ar_scores(EV, LEVEL2))
def ar_scores_events(spark, sf_dir):
    return scores(evaluate_ar(events_hourly(spark, sf_dir), LEVEL2, panel=HOURLY), "series_id")


@query("ar_scores_suppliers", sql_ar_scores(LI, LOG2))
def ar_scores_suppliers(spark, sf_dir):
    return scores(evaluate_ar(supplier_daily(spark, sf_dir), LOG2, panel=DAILY), "series_id")


@query("ar_scores_five_lags", sql_ar_scores(EV, LOG5))
def ar_scores_five_lags(spark, sf_dir):
    return scores(evaluate_ar(events_hourly(spark, sf_dir), LOG5, panel=HOURLY), "series_id")


@query("ar_scores_raw_events", sql_ar_scores(RAW_EV, LEVEL2))
def ar_scores_raw_events(spark, sf_dir):
    return scores(evaluate_ar(events_raw(spark, sf_dir), LEVEL2, panel=RAW), "series_id")


@query("lag_gram", f"""
  SELECT series_id, count(*) AS n, {', '.join(f"{sql_r(f'sum({a} * {b})')} AS {a}_{b}" for a, b in (("l1", "l1"), ("l1", "l2"), ("l2", "l2"), ("l1", "v"), ("l2", "v")))}
  FROM ({_differenced(sql_ix(EV), LOG2)}) WHERE pos > 3 GROUP BY series_id""")
def lag_gram(spark, sf_dir):
    diffs = SC.scale_log_difference(events_hourly(spark, sf_dir), by=HOURLY.keys, panel=HOURLY)
    rows = S.lag_features(diffs, 2, HOURLY).select("series_id", F.array("lag_1", "lag_2").alias("x"), F.array("value").alias("y"))
    g = F.col("cells")
    return gram(rows, ["series_id"]).select(
        "series_id", F.round(g[0]).cast("bigint").alias("n"), r(g[4]).alias("l1_l1"), r(g[5]).alias("l1_l2"),
        r(g[7]).alias("l2_l2"), r(g[6]).alias("l1_v"), r(g[8]).alias("l2_v"))


def _recursive_sql():
    rows = f"SELECT * FROM ({_differenced(sql_ix(EV), LOG2)}) JOIN ({sql_ar_fit(sql_ix(EV), LOG2)}) USING (series_id) WHERE pos >= 3"
    one = f"SELECT *, c1 + w1_1 * v + w2_1 * l1 AS f1 FROM ({rows})"
    two = f"SELECT *, c1 + w1_1 * f1 + w2_1 * v AS f2 FROM ({one})"
    three = f"SELECT *, c1 + w1_1 * f2 + w2_1 * f1 AS f3 FROM ({two})"
    return " UNION ALL ".join(
        f"SELECT series_id, {sql_stamp()} AS origin, {k} AS step, {sql_r(f'f{k}')} AS predicted FROM ({three})" for k in (1, 2, 3))


@query("recursive_forecast", _recursive_sql())
def recursive(spark, sf_dir):
    panel = index_panel(events_hourly(spark, sf_dir), HOURLY)
    path = recursive_forecast(panel, ar_ridge_fit(panel, LOG2, HOURLY), 3, LOG2, HOURLY)
    return path.select("series_id", stamp("origin").alias("origin"), "step", r("predicted").alias("predicted"))


# --- vector autoregression ---------------------------------------------------------------

_C = "(PARTITION BY center ORDER BY ts)"
_OF = "(PARTITION BY center)"


def _event_names(spark, sf_dir):
    return node_catalog(events_hourly(spark, sf_dir))


def _event_families(spark, sf_dir, size):
    """Every event type with the types after it, by hour: many neighbourhoods with names from the data."""
    family = stored(families(_event_names(spark, sf_dir), size))
    # fit and forecast read the matrix and its ranges: store it once
    return stored(to_matrix(neighbor_panel(events_hourly(spark, sf_dir), family), family))


def _supplier_families(spark, sf_dir, size):
    family = stored(families(supplier_names(spark, sf_dir), size))
    return stored(to_matrix(neighbor_panel(supplier_daily(spark, sf_dir), family), family))


def _top(i: int, k: int, spec: VARSpec) -> str:
    if spec.scaling == "joint":
        return "greatest(" + ", ".join(f"hi{j}" for j in range(1, k + 1)) + ")"
    return f"hi{i}" if spec.scaling == "member" else f"(hi{i} + 1.0)"


def _var_logs(rows: str, k: int, spec: VARSpec) -> str:
    """Scaled logs ``g``, log differences ``d`` and the position of family rows."""
    stats = ", ".join(f"min(x{i}) OVER {_OF} AS lo{i}, max(x{i}) OVER {_OF} AS hi{i}" for i in range(1, k + 1))
    logs = ", ".join(f"ln(CASE WHEN hi{i} = lo{i} THEN 1.0 ELSE 1.0 + (x{i} - lo{i}) * ({_top(i, k, spec)} - 1.0) / (hi{i} - lo{i}) END) AS g{i}"
                     for i in range(1, k + 1))
    diffs = ", ".join(f"g{i} - lag(g{i}) OVER {_C} AS d{i}" for i in range(1, k + 1))
    return f"""SELECT *, row_number() OVER {_C} AS pos, count(*) OVER {_OF} AS cnt, {diffs} FROM (
        SELECT *, {logs} FROM (SELECT *, {stats} FROM ({rows})))"""


def _side(rows: str, part: str) -> str:
    stop = f"floor(CAST(0.8 AS DOUBLE) * count(*) OVER {_OF})"
    return f"""SELECT * EXCLUDE (rn, stop) FROM (SELECT *, row_number() OVER {_C} AS rn, {stop} AS stop FROM ({rows}))
      WHERE rn {'<=' if part == 'train' else '>'} stop"""


def _var_rows(rows: str, part: str, k: int, spec: VARSpec) -> str:
    """Lag rows of one side of the 0.8 split, scaled and log-differenced; ``y`` are targets, ``past`` the logs before them."""
    p, h = spec.look_back, spec.horizon
    lags = ", ".join(f"lag(d{i}, {j}) OVER {_C} AS l{j}_{i}" for j in range(1, p + 1) for i in range(1, k + 1))
    ahead = ", ".join(f"lead(d{i}, {h - 1}) OVER {_C} AS y{i}, {f'lag(g{i}, 1)' if h == 1 else f'lead(g{i}, {h - 2})'} OVER {_C} AS past{i}"
                      for i in range(1, k + 1))
    return f"""SELECT *, row_number() OVER {_C} AS rw, count(*) OVER {_OF} AS rws FROM (
      SELECT *, {lags}, {ahead} FROM ({_var_logs(_side(rows, part), k, spec)})) WHERE pos > {p + 2} AND pos + {h - 1} <= cnt"""


def _lag_names(k: int, spec: VARSpec) -> list[str]:
    return [f"l{j}_{i}" for j in range(1, spec.look_back + 1) for i in range(1, k + 1)]


def _outs(k: int, spec: VARSpec) -> list[str]:
    return [f"y{o}" for o in range(1, (1 if spec.outputs == "center" else k) + 1)]


def _var_fit(rows: str, k: int, spec: VARSpec) -> str:
    train = f"SELECT * FROM ({_var_rows(rows, 'train', k, spec)}) WHERE rw <= floor(CAST(0.6 AS DOUBLE) * rws)"
    return sql_ridge(train, "center", _lag_names(k, spec), _outs(k, spec))


def _var_predict(rows: str, k: int, spec: VARSpec) -> str:
    joined = f"SELECT * FROM ({_var_rows(rows, 'test', k, spec)}) JOIN ({_var_fit(rows, k, spec)}) USING (center)"

    def restored(v: str, i: int) -> str:
        return f"lo{i} + (exp({v} + past{i}) - 1.0) * (hi{i} - lo{i}) / nullif({_top(i, k, spec)} - 1.0, 0)"

    parts = []
    for o, y in enumerate(_outs(k, spec), 1):
        ahead = f"c{o} + " + " + ".join(f"w{i}_{o} * {x}" for i, x in enumerate(_lag_names(k, spec), 1))
        parts.append(f"""SELECT center, {o - 1} AS member, ts, predicted, {y} AS actual, {restored('predicted', o)} AS restored,
          {restored(y, o)} AS restored_actual FROM (SELECT *, {ahead} AS predicted FROM ({joined}))""")
    return " UNION ALL ".join(parts)


_BY_CENTER = HOURLY.with_keys("center").with_value("values")
_DAILY_CENTER = DAILY.with_keys("center").with_value("values")
PAIR = VARSpec(look_back=2)
CENTER = VARSpec(look_back=2, horizon=2, outputs="center", scaling="member")
PRICES = VARSpec(look_back=2, horizon=2, scaling="member_plus_one")
MEMBER = VARSpec(look_back=2, scaling="member")
EV2, EV3 = sql_family_rows(EV, EV_NAMES, 2), sql_family_rows(EV, EV_NAMES, 3)
LI2 = sql_family_rows(LI, LI_NAMES, 2)


def _shown(pred):
    return pred.select("center", "member", stamp("ts").alias("ts"), r("predicted", 5).alias("predicted"), r("actual", 5).alias("actual"))


def _var_sql(rows, k, spec):
    return f"""SELECT center, member, {sql_stamp()} AS ts, {sql_r('predicted', 5)} AS predicted, {sql_r('actual', 5)} AS actual
      FROM ({_var_predict(rows, k, spec)})"""


@query("var_forecast_pair", _var_sql(EV2, 2, PAIR))
def var_forecast_pair(spark, sf_dir):
    return _shown(forecast_var(_event_families(spark, sf_dir, 2), PAIR, panel=_BY_CENTER))


@query("var_forecast_center", _var_sql(EV3, 3, CENTER))
def var_forecast_center(spark, sf_dir):
    return _shown(forecast_var(_event_families(spark, sf_dir, 3), CENTER, panel=_BY_CENTER))


@query("var_scores_events", metrics_sql(_var_predict(EV3, 3, PAIR), by="center", part="center, member"))
def var_scores_events(spark, sf_dir):
    return scores(evaluate_var(_event_families(spark, sf_dir, 3), PAIR, panel=_BY_CENTER), "center")


@query("var_scores_suppliers", metrics_sql(_var_predict(LI2, 2, MEMBER), by="center", part="center, member"))
def var_scores_suppliers(spark, sf_dir):
    return scores(evaluate_var(_supplier_families(spark, sf_dir, 2), MEMBER, panel=_DAILY_CENTER), "center")


@query("var_forecast_prices", f"""SELECT center, member, {sql_stamp()} AS ts, {sql_r('restored', 2)} AS predicted,
  {sql_r('restored_actual', 2)} AS actual FROM ({_var_predict(LI2, 2, PRICES)})""")
def var_forecast_prices(spark, sf_dir):
    pred = forecast_var(_supplier_families(spark, sf_dir, 2), PRICES, restore=True, panel=_DAILY_CENTER)
    return pred.select("center", "member", stamp("ts").alias("ts"), r("restored", 2).alias("predicted"), r("restored_actual", 2).alias("actual"))


@query("var_report", f"""SELECT center, printf('%f', mae) AS mae, printf('%f', mase) AS mase, printf('%f', hits) AS hits
  FROM ({metrics_sql(_var_predict(EV2, 2, PAIR), by="center", part="center, member", rounded=False)})""")
def var_report(spark, sf_dir):
    found = evaluate_var(_event_families(spark, sf_dir, 2), PAIR, panel=_BY_CENTER)
    path = scratch(spark, "var-report")
    write_report(M.plain_report(found, ("center",)), path)
    return spark.read.csv(path, sep="\t", header=True)


def _var_recursive_sql():
    logs = _var_logs(_side(EV2, "train"), 2, PAIR)
    train = _var_rows(EV2, "train", 2, PAIR)
    fit = sql_ridge(f"SELECT * FROM ({train}) WHERE rw <= floor(CAST(0.6 AS DOUBLE) * rws)", "center", _lag_names(2, PAIR), ["y1", "y2"])
    src = f"""SELECT *, d1 AS f0_1, d2 AS f0_2, lag(d1) OVER {_C} AS fm_1, lag(d2) OVER {_C} AS fm_2 FROM ({logs})"""
    src = f"SELECT * FROM ({src}) JOIN ({fit}) USING (center) WHERE pos >= 3"
    newest, before = "f0", "fm"
    for step in (1, 2, 3):
        cols = ", ".join(f"c{o} + w1_{o} * {newest}_1 + w2_{o} * {newest}_2 + w3_{o} * {before}_1 + w4_{o} * {before}_2 AS f{step}_{o}" for o in (1, 2))
        src = f"SELECT *, {cols} FROM ({src})"
        newest, before = f"f{step}", newest
    return " UNION ALL ".join(f"SELECT center, {sql_stamp()} AS origin, {k} AS step, {o - 1} AS member, {sql_r(f'f{k}_{o}')} AS predicted FROM ({src})"
                              for k in (1, 2, 3) for o in (1, 2))


@query("var_recursive_forecast", _var_recursive_sql())
def var_recursive(spark, sf_dir):
    train = S.take_split(index_panel(_event_families(spark, sf_dir, 2), _BY_CENTER), "train", 0.8, _BY_CENTER)
    path = var_recursive_forecast(train, var_ridge_fit(train, PAIR, _BY_CENTER), 3, PAIR, _BY_CENTER)
    return path.select("center", stamp("origin").alias("origin"), "step", "member", r("predicted").alias("predicted"))


@query("var_scores_neighborhoods")
def var_scores_neighborhoods(spark, sf_dir):
    catalog = label_catalog(spark, sf_dir)
    matrix = neighborhood_matrix(label_monthly(spark, sf_dir), edges(spark, sf_dir), catalog,
                                 catalog.withColumnRenamed("node", "center"), fill=0.0)
    panel = MONTHLY.with_keys("center").with_value("values")
    settings = {"all": VARSpec(look_back=2), "center": VARSpec(look_back=2, outputs="center")}
    return scores(evaluate_var_grid(matrix, settings, panel=panel), "center", "type")


# --- windows scored by a model, nonlinear models --------------------------------------------

def recent_mean(past):
    """A stand-in for a caller's model: the mean of the last six values."""
    return past[:, -6:].mean(axis=1)


@query("score_windows", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('predicted')} AS predicted, {sql_r('target')} AS actual FROM (
    SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS predicted,
      lead(value) OVER {_W} AS target FROM ({sql_ix(EV)})) WHERE pos >= 24 AND pos + 1 <= n - 1""")
def score_windows_query(spark, sf_dir):
    seq = S.sliding_sequences(events_hourly(spark, sf_dir), 24, 1, HOURLY).select("series_id", "ts", "past", "target")
    scored = score_windows(seq, recent_mean, keep_past=False)
    return scored.select("series_id", stamp("ts").alias("ts"), r("predicted").alias("predicted"), r("target").alias("actual"))


@query("score_panel", f"""
  SELECT series_id, {sql_stamp()} AS ts, {sql_r('predicted')} AS predicted, {sql_r('target')} AS actual FROM (
    SELECT *, avg(value) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS predicted,
      lead(value) OVER {_W} AS target FROM ({sql_ix(LI)})) WHERE pos >= 111 AND pos + 1 <= n - 1""")
def score_panel_query(spark, sf_dir):
    scored = score_panel(supplier_daily(spark, sf_dir), recent_mean, 111, 1, DAILY)
    return scored.select("series_id", stamp("ts").alias("ts"), r("predicted").alias("predicted"), r("actual").alias("actual"))


def _roll_sql():
    past = ", ".join(f"lag(value, {k}) OVER {_W} AS b{k}" for k in range(6))
    rows = f"SELECT * FROM (SELECT *, {past} FROM ({sql_ix(EV)})) WHERE pos >= 24"
    one = f"SELECT *, (b0 + b1 + b2 + b3 + b4 + b5) / 6 AS p1 FROM ({rows})"
    two = f"SELECT *, (p1 + b0 + b1 + b2 + b3 + b4) / 6 AS p2 FROM ({one})"
    three = f"SELECT *, (p2 + p1 + b0 + b1 + b2 + b3) / 6 AS p3 FROM ({two})"
    return " UNION ALL ".join(f"SELECT series_id, {sql_stamp()} AS origin, {k} AS step, {sql_r(f'p{k}')} AS predicted FROM ({three})" for k in (1, 2, 3))


@query("roll_forward", _roll_sql())
def roll_forward_query(spark, sf_dir):
    path = roll_forward(events_hourly(spark, sf_dir), recent_mean, 24, 3, HOURLY)
    return path.select("series_id", stamp("origin").alias("origin"), "step", r("predicted").alias("predicted"))


def _units_sql(rows: str, inputs: list[str], spec: NonlinearSpec, seeds) -> str:
    """The rows once per seed, with the hidden units ``h``."""
    parts = []
    for seed in seeds:
        weights, biases = hidden_layer(seed, len(inputs), spec.units)
        units = ", ".join(f"greatest(0.0::DOUBLE, {' + '.join([f'{x} * ({float(w)!r}::DOUBLE)' for x, w in zip(inputs, row)])} + ({float(b)!r}::DOUBLE)) AS h{u}"
                          for u, (row, b) in enumerate(zip(weights, biases), 1))
        parts.append(f"SELECT *, {seed} AS seed, {units} FROM ({rows})")
    return " UNION ALL ".join(parts)


def _nonlinear_sql(train: str, test: str, key: str, inputs: list[str], outs: list[str], spec: NonlinearSpec, seeds) -> str:
    """Predictions of the rows of ``test`` by models of the rows of ``train``."""
    names = [f"h{u}" for u in range(1, spec.units + 1)]
    fit = sql_ridge(_units_sql(train, inputs, spec, seeds), f"{key}, seed", names, outs, spec.alpha)
    joined = f"SELECT * FROM ({_units_sql(test, inputs, spec, seeds)}) JOIN ({fit}) USING ({key}, seed)"
    return " UNION ALL ".join(
        f"SELECT {key}, seed, {o - 1} AS member, ts, c{o} + {' + '.join(f'w{u}_{o} * h{u}' for u in range(1, spec.units + 1))} AS predicted, "
        f"{y} AS actual FROM ({joined})" for o, y in enumerate(outs, 1))


def _lag_rows(source: str, spec: NonlinearSpec) -> str:
    """Lag rows of a query that yields series and ``v``, numbered in all (``pos``, ``n``) and among lag rows (``rw``, ``rws``)."""
    k, h = spec.look_back, spec.horizon
    lags = ", ".join(f"lag(v, {j}) OVER {_W} AS l{j}" for j in range(1, k + 1))
    return f"""SELECT *, CAST(pos - {k + 1} AS BIGINT) AS rw, n - {k + 1} - {h - 1} AS rws FROM (
      SELECT *, {lags}, lead(v, {h - 1}) OVER {_W} AS y FROM ({source})) WHERE pos >= {k + 2} AND pos + {h - 1} <= n"""


_EV_DIFFS = f"SELECT series_id, ts, v, pos - 1 AS pos, n - 1 AS n FROM ({sql_scaled(sql_ix(EV))}) WHERE pos > 1"
FEW = NonlinearSpec(look_back=4, units=3)
SEEDED = NonlinearSpec(look_back=3, units=4, horizon=1)
FAMILY_UNITS = NonlinearSpec(look_back=2, units=3)
SEEDS = list(range(1, 11))
_TRAIN60 = "floor(CAST(0.6 AS DOUBLE) * rws)"


def _nonlinear_forecast_sql():
    rows, inputs = _lag_rows(_EV_DIFFS, FEW), [f"l{j}" for j in range(1, 5)]
    pred = _nonlinear_sql(f"SELECT * FROM ({rows}) WHERE rw <= {_TRAIN60}", f"SELECT * FROM ({rows}) WHERE rw > {_TRAIN60}",
                          "series_id", inputs, ["y"], FEW, (7, 8))
    return f"SELECT series_id, seed, {sql_stamp()} AS ts, {sql_r('predicted', 5)} AS predicted, {sql_r('actual', 5)} AS actual FROM ({pred})"


@query("nonlinear_forecast", _nonlinear_forecast_sql())
def nonlinear_forecast(spark, sf_dir):
    diffs = SC.scale_log_difference(events_hourly(spark, sf_dir), by=HOURLY.keys, panel=HOURLY)
    pred = nonlinear_ar(diffs, FEW, seeds=(7, 8), panel=HOURLY).filter("seed IS NOT NULL")
    return pred.select("series_id", "seed", stamp("ts").alias("ts"), r("predicted", 5).alias("predicted"), r("actual", 5).alias("actual"))


def _family_scores_sql():
    def side(part):
        diffs = ", ".join(f"lag(d{i}, {j}) OVER {_C} AS l{j}_{i}" for j in (1, 2) for i in (1, 2))
        logs = f"SELECT * EXCLUDE (pos, cnt), pos - 1 AS pos, cnt - 1 AS n FROM ({_var_logs(_side(LI2, part), 2, MEMBER)}) WHERE pos > 1"
        return f"SELECT *, pos - 3 AS rw, n - 3 AS rws FROM (SELECT *, {diffs}, d1 AS y1, d2 AS y2 FROM ({logs})) WHERE pos >= 4"
    pred = _nonlinear_sql(f"SELECT * FROM ({side('train')}) WHERE rw <= {_TRAIN60}", side("test"), "center",
                          ["l1_1", "l1_2", "l2_1", "l2_2"], ["y1", "y2"], FAMILY_UNITS, (1, 2, 3))
    return metrics_sql(pred, by="center, seed", part="center, seed, member")


@query("nonlinear_neighborhoods", _family_scores_sql())
def nonlinear_neighborhoods(spark, sf_dir):
    """Nonlinear models of every neighbourhood's lags, fitted per centre."""
    ix = index_panel(_supplier_families(spark, sf_dir, 2), _DAILY_CENTER)
    train, test = (log_difference_matrix(S.take_split(ix, part, 0.8, _DAILY_CENTER), MEMBER, _DAILY_CENTER) for part in ("train", "test"))
    models = nonlinear_fit(train, FAMILY_UNITS, (1, 2, 3), _DAILY_CENTER)
    pred = nonlinear_predict(test, models, FAMILY_UNITS, _DAILY_CENTER).filter("seed IS NOT NULL")
    found = M.forecast_metrics(pred, ["center", "seed"], 1, _DAILY_CENTER.with_keys("center", "seed", "member"))
    return scores(found, "center", "seed")


# --- ARMA grid ---------------------------------------------------------------------------

GRID = {"mu": [0.0, 0.05], "phi": [-0.3, 0.2], "theta": [-0.6, 0.1]}
SIGMAS = [0.5, 1.0, 2.0]

_GRID_SQL = f"""SELECT * FROM (SELECT unnest({GRID['mu']}::DOUBLE[]) AS mu), (SELECT unnest({GRID['phi']}::DOUBLE[]) AS phi),
  (SELECT unnest({GRID['theta']}::DOUBLE[]) AS theta)"""
_ARMA = f"""WITH RECURSIVE y AS MATERIALIZED (
    SELECT series_id, v, lag(v) OVER {_W} AS prev, row_number() OVER {_W} AS k
    FROM ({sql_scaled(EV)}) WHERE v IS NOT NULL),
  g AS MATERIALIZED ({_GRID_SQL}),
  e AS (
    SELECT series_id, CAST(1 AS BIGINT) AS k, mu, phi, theta, v - (mu + phi * mu) AS err, CAST(0 AS DOUBLE) AS ss FROM y, g WHERE k = 1
    UNION ALL
    SELECT e.series_id, y.k, mu, phi, theta, y.v - (mu + phi * y.prev + theta * e.err),
      e.ss + pow(y.v - (mu + phi * y.prev + theta * e.err), 2)
    FROM e JOIN y ON y.series_id = e.series_id AND y.k = e.k + 1),
  ss AS (SELECT series_id, mu, phi, theta, max_by(ss, k) AS ss, max(k) - 1 AS n FROM e GROUP BY series_id, mu, phi, theta)"""


def _residual_ss(spark, sf_dir):
    diffs = SC.scale_log_difference(events_hourly(spark, sf_dir), by=HOURLY.keys, panel=HOURLY)
    return arma_residual_ss(diffs, GRID, HOURLY, block_rows=256)


@query("arma_residual_ss", f"{_ARMA} SELECT series_id, mu, phi, theta, {sql_r('ss', 4)} AS ss, n FROM ss")
def residual_ss(spark, sf_dir):
    return _residual_ss(spark, sf_dir).withColumn("ss", r("ss", 4))


def _normal_sql(x, sd):
    return f"(-{x} * {x} / {2.0 * sd * sd} - {math.log(sd * math.sqrt(2 * math.pi))})"


_LP = (f"-n * ln(sigma) - n * {0.5 * math.log(2 * math.pi)} - ss / (2 * sigma * sigma) + {math.log(2.0)}"
       f" - ln(pi() * 5 * (1 + (sigma / 5) * (sigma / 5))) + {_normal_sql('theta', 2.0)} + {_normal_sql('phi', 2.0)} + {_normal_sql('mu', 10.0)}")


@query("arma_posterior", f"""{_ARMA},
  lp AS (SELECT *, {_LP} AS lp FROM ss, (SELECT unnest({SIGMAS}::DOUBLE[]) AS sigma)),
  w AS (SELECT *, exp(lp - max(lp) OVER (PARTITION BY series_id)) AS w FROM lp)
  SELECT series_id, {', '.join(f'max_by({p}, lp) AS map_{p}' for p in ('mu', 'phi', 'theta', 'sigma'))},
    {', '.join(f"{sql_r(f'sum(w * {p}) / sum(w)', 5)} AS mean_{p}" for p in ('mu', 'phi', 'theta', 'sigma'))}
  FROM w GROUP BY series_id""")
def posterior(spark, sf_dir):
    found = arma_grid_posterior(_residual_ss(spark, sf_dir), SIGMAS, HOURLY)
    names = ("mu", "phi", "theta", "sigma")
    return found.select("series_id", *[f"map_{p}" for p in names], *[r(f"mean_{p}", 5).alias(f"mean_{p}") for p in names])


# --- evaluation and reports --------------------------------------------------------------

MODELS = {"level": LEVEL2, "log": LOG2, "seasonal": SEASONAL}


def _grid_sql(rounded: bool = True) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{name}' AS type FROM ({sql_ar_scores(EV, spec, rounded)})" for name, spec in MODELS.items())


@query("evaluation_grid", _grid_sql())
def evaluation_grid(spark, sf_dir):
    return scores(evaluate_grid(events_hourly(spark, sf_dir), MODELS, panel=HOURLY), "series_id", "type")


@query("evaluation_report", f"""
  SELECT type, {', '.join(f"printf('%f+/-%f', avg({m}), stddev_pop({m})) AS {m}" for m in M.METRICS)}
  FROM ({_grid_sql(rounded=False)}) GROUP BY type""")
def evaluation_report(spark, sf_dir):
    grid = evaluate_grid(events_hourly(spark, sf_dir), MODELS, panel=HOURLY)
    path = scratch(spark, "report")
    write_report(M.metrics_report(grid, by=("type",)).select("type", *M.METRICS), path)
    return spark.read.csv(path, sep="\t", header=True)


def _seed_sql():
    def side(part):
        cut = f"SELECT series_id, ts, v, pos FROM ({_EV_DIFFS}) WHERE pos {'<=' if part == 'train' else '>'} floor(CAST(0.8 AS DOUBLE) * n)"
        return _lag_rows(f"SELECT series_id, ts, v, row_number() OVER {_W} AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM ({cut})", SEEDED)
    pred = _nonlinear_sql(f"SELECT * FROM ({side('train')}) WHERE rw <= {_TRAIN60}", side("test"), "series_id", ["l1", "l2", "l3"], ["y"],
                          SEEDED, SEEDS)
    found = metrics_sql(pred, by="series_id, seed", part="series_id, seed", rounded=False)
    shown = ", ".join(f"printf('%f+/-%f', avg({m}), stddev_pop({m})) AS {m}" for m in M.METRICS)
    return f"SELECT series_id, 'nonlinear' AS type, {shown} FROM ({found}) GROUP BY series_id"


@query("seed_report", _seed_sql())
def seed_report(spark, sf_dir):
    diffs = SC.scale_log_difference(events_hourly(spark, sf_dir), by=HOURLY.keys, panel=HOURLY)
    runs = evaluate_seeds(diffs, SEEDED, SEEDS, panel=HOURLY)
    return M.metrics_report(runs, by=("series_id", "type")).select("series_id", "type", *M.METRICS)
