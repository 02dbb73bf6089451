"""Model operators against numpy, written from the formulas."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import BLOCKS, GRID, LAYOUTS, START, by_series, panel_of, skewed
from panelcast.models.ar import ARSpec, ar_ridge_fit, ar_ridge_predict, recursive_forecast
from panelcast.models.arma import arma_grid_posterior, arma_residual_ss
from panelcast.models.nonlinear import NonlinearSpec, hidden_layer, nonlinear_ar
from panelcast.models.scoring import roll_forward, score_panel, score_windows
from panelcast.models.var import VARSpec, to_matrix, var_recursive_forecast, var_ridge_fit, var_ridge_predict
from panelcast.operators import metrics as M
from panelcast.operators import scale as SC
from panelcast.operators import series as S
from panelcast.operators.graph import neighbor_panel
from panelcast.panel import MATRIX, Panel
from panelcast.plans.datasets import train_test_lists, train_test_rows
from panelcast.plans.evaluation import evaluate_ar, evaluate_grid, evaluate_seeds, evaluate_var


def ridge(x, y, alpha=1.0):
    xm, ym = x.mean(0), y.mean(0)
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def scaled(x):
    x = np.asarray(x, float)
    return 1 + (x - x.min()) * (x.max() - 1) / (x.max() - x.min())


def differences(x, spec):
    x = np.asarray(x, float)
    if spec.log_difference:
        x = np.log(scaled(x))
        return x[1:] - x[:-1]
    return x[spec.lag:] - x[:-spec.lag]


def lag_matrix(v, p):
    return np.stack([v[p - k:len(v) - k] for k in range(1, p + 1)], 1)


def ar_numpy(train, test, spec):
    v = differences(train, spec)
    w, b = ridge(lag_matrix(v, spec.p), v[spec.p:], spec.alpha)
    u = differences(test, spec)
    ahead, y = lag_matrix(u, spec.p) @ w + b, u[spec.p:]
    error = ahead - y
    if spec.q:
        corr = np.array([error[i - spec.q:i].mean() for i in range(spec.q, len(y))])
        ahead, y = ahead[spec.q:] + corr, y[spec.q:]
    if spec.log_difference:
        return w, b, ahead, y
    start = spec.lag + spec.p + spec.q
    x = np.asarray(test, float)
    return w, b, ahead + x[start - spec.lag:-spec.lag], x[start:]


@pytest.mark.parametrize("panel", LAYOUTS)
@pytest.mark.parametrize("spec", [
    ARSpec(p=1, lag=2, q=0, log_difference=False), ARSpec(p=2, lag=3, q=2, log_difference=False, alpha=25.0),
    ARSpec(p=2, q=2, log_difference=True), ARSpec(p=5, lag=1, q=3, log_difference=False), ARSpec(p=4, q=1)])
def test_ar_matches_numpy(spark, panel, spec):
    series, hours = skewed(5)
    train = {s: x[:len(x) * 2 // 3] for s, x in series.items() if len(x) > 30}
    test = {s: x[len(x) * 2 // 3:] for s, x in series.items() if len(x) > 30}
    coef = ar_ridge_fit(panel_of(spark, train, hours), spec, panel)
    fitted = {r.series_id: r for r in coef.collect()}
    got = by_series(ar_ridge_predict(panel_of(spark, test), coef, spec, panel=panel), "predicted", "actual")
    for s in train:
        w, b, ahead, y = ar_numpy(train[s], test[s], spec)
        assert np.allclose(fitted[s].weights, w) and fitted[s].intercept == pytest.approx(b)
        assert np.allclose([g[0] for g in got[s]], ahead) and np.allclose([g[1] for g in got[s]], y)


def test_ar_recovers_its_coefficients(spark):
    rng = np.random.default_rng(0)
    v = [0.0, 0.0]
    for e in rng.normal(0, 1, 4000):
        v.append(0.5 * v[-1] - 0.3 * v[-2] + e)
    level = np.cumsum(v)
    coef = ar_ridge_fit(panel_of(spark, {"s": level}), ARSpec(p=2, lag=1, log_difference=False), GRID).first()
    assert coef.weights == pytest.approx([0.5, -0.3], abs=0.05)


def test_train_scaler(spark):
    series, _ = skewed(6)
    df = panel_of(spark, {"hot": series["hot"]})
    spec = ARSpec(p=2, q=2)
    refit, train = (evaluate_ar(df, spec, scaler=k, panel=GRID).first().mae for k in ("refit", "train"))
    x = np.asarray(series["hot"], float)
    cut = int(0.8 * len(x))
    _, _, ahead, y = ar_numpy(x[:cut], x[cut:], spec)
    assert refit == pytest.approx(np.abs(ahead - y).mean())
    assert train != pytest.approx(refit)


@pytest.mark.parametrize("panel", LAYOUTS)
@pytest.mark.parametrize("p", [1, 2, 4])
def test_recursive_forecast(spark, panel, p):
    series, _ = skewed(8)
    df = panel_of(spark, {"hot": series["hot"]})
    spec = ARSpec(p=p, lag=2, q=0, log_difference=False)
    coef = ar_ridge_fit(df, spec, panel)
    row = coef.first()
    v = differences(series["hot"], spec)
    got = {(r.origin, r.step): r.predicted for r in recursive_forecast(df, coef, 4, spec, panel).collect()}
    origins = sorted({o for o, _ in got})
    assert len(origins) == len(v) - p + 1
    for i, origin in enumerate(origins):
        state = list(v[i:i + p][::-1])
        for step in range(1, 5):
            ahead = row.intercept + float(np.dot(row.weights, state))
            assert got[origin, step] == pytest.approx(ahead)
            state = [ahead, *state][:p]


def _matrix(spark, k=3, n=120, seed=2):
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(2, 0.5, (n, k)))
    names = [f"n{i}" for i in range(k)]
    family = spark.createDataFrame([("c", m, m == "n1") for m in names], "center string, node string, is_center boolean")
    df = panel_of(spark, {m: list(x[:, i]) for i, m in enumerate(names)})
    matrix = to_matrix(neighbor_panel(df, family), family)
    return matrix, x[:, [1, 0] + list(range(2, k))]


def var_numpy(x, spec, train):
    if spec.log_difference:
        s = 1 + (x - x.min(0)) * (x.max() - 1) / (x.max(0) - x.min(0))
        x = np.log(s[1:]) - np.log(s[:-1])
    rows, targets = [], []
    for i in range(spec.look_back + 1, len(x)):
        if i + spec.horizon - 1 >= len(x):
            break
        rows.append(np.concatenate([x[i - k] for k in range(1, spec.look_back + 1)]))
        targets.append(x[i + spec.horizon - 1])
    rows, targets = np.array(rows), np.array(targets)
    if spec.outputs == "center":
        targets = targets[:, :1]
    if train:
        cut = int(spec.train_fraction * len(rows))
        rows, targets = rows[:cut], targets[:cut]
    return rows, targets


@pytest.mark.parametrize("keys", [Panel(keys=("center",), value="values", step=3600),
                                  Panel(keys=("center",), value="values", rows_per_task=30, block_rows=9)])
@pytest.mark.parametrize("spec", [VARSpec(), VARSpec(look_back=3, horizon=2), VARSpec(outputs="center"),
                                  VARSpec(log_difference=False, alpha=5.0)])
def test_var_matches_numpy(spark, keys, spec):
    matrix, x = _matrix(spark)
    coef = var_ridge_fit(matrix, spec, keys)
    w, b = ridge(*var_numpy(x, spec, True), spec.alpha)
    fitted = coef.first().coefs
    assert np.allclose([c.weights for c in fitted], w.T) and np.allclose([c.intercept for c in fitted], b)
    rows, targets = var_numpy(x, spec, False)
    got = sorted(var_ridge_predict(matrix, coef, spec, keys).collect(), key=lambda r: (r.pos, r.member))
    assert np.allclose([r.predicted for r in got], (rows @ w + b).ravel())
    assert np.allclose([r.actual for r in got], targets.ravel())


def test_pooled_var_scores(spark):
    matrix, x = _matrix(spark)
    spec = VARSpec()
    cut = int(0.8 * len(x))
    w, b = ridge(*var_numpy(x[:cut], spec, True))
    rows, y = var_numpy(x[cut:], spec, False)
    p = rows @ w + b
    mae, naive = np.abs(p - y).mean(), np.abs(y[1:] - y[:-1]).mean()
    agree = (p[1:] - p[:-1]) * (y[1:] - y[:-1]) > 0
    row = evaluate_var(matrix, spec, panel=Panel(keys=("center",), value="values", step=3600)).first()
    assert row.mae == pytest.approx(mae) and row.mase == pytest.approx(mae / naive)
    assert row.hits == pytest.approx(np.abs(p[1:][agree]).mean())


def test_matrix_drops_or_fills_incomplete_hours(spark):
    family = spark.createDataFrame([("c", "a", False), ("c", "b", True)], "center string, node string, is_center boolean")
    rows = neighbor_panel(panel_of(spark, {"a": [1, 2, 3], "b": [4, 5]}), family)
    assert sorted(r["values"] for r in to_matrix(rows, family).collect()) == [[4, 1], [5, 2]]
    assert sorted(r["values"] for r in to_matrix(rows, family, fill=0.0).collect()) == [[0, 3], [4, 1], [5, 2]]
    split = train_test_rows(to_matrix(rows, family, fill=0.0), 0.8, MATRIX).collect()
    assert sum(r.split == "train" for r in split) == 4 and sum(r.split == "test" for r in split) == 2


def arma_numpy(y, mu, phi, theta):
    e, ss = y[0] - (mu + phi * mu), 0.0
    for t in range(1, len(y)):
        e = y[t] - (mu + phi * y[t - 1] + theta * e)
        ss += e * e
    return ss


@pytest.mark.parametrize("block_rows, group", [(4096, 1024), (8, 3), (1, 5)])
def test_arma_blocks_compose(spark, block_rows, group):
    rng = np.random.default_rng(4)
    series = {"a": list(rng.normal(0, 1, 97)), "b": list(rng.normal(0, 1, 16))}
    grid = {"mu": [0.0, 0.3], "phi": [0.4], "theta": [-0.7, 0.2, 1.1]}
    got = arma_residual_ss(panel_of(spark, series), grid, GRID, block_rows, group).collect()
    assert len(got) == 12
    for r in got:
        assert r.ss == pytest.approx(arma_numpy(series[r.series_id], r.mu, r.phi, r.theta), rel=1e-8)
        assert r.n == len(series[r.series_id]) - 1


def test_arma_overflow_is_infinite(spark):
    y = list(np.random.default_rng(1).normal(0, 1, 2000))
    got = arma_residual_ss(panel_of(spark, {"s": y}), {"mu": [0.0], "phi": [0.0], "theta": [3.0]}, GRID, 256).first()
    assert math.isinf(got.ss)


def test_arma_posterior(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(0, 1, 60)
    grid = {"mu": [0.0, 0.2], "phi": [-0.5, 0.0, 0.5], "theta": [0.0, 0.4]}
    sigmas = [0.5, 1.0, 2.0]
    row = arma_grid_posterior(arma_residual_ss(panel_of(spark, {"s": y}), grid), sigmas).first()

    def normal(x, sd):
        return -x * x / (2 * sd * sd) - math.log(sd * math.sqrt(2 * math.pi))

    points = []
    for mu in grid["mu"]:
        for phi in grid["phi"]:
            for theta in grid["theta"]:
                ss = arma_numpy(y, mu, phi, theta)
                for s in sigmas:
                    lp = -59 * math.log(s * math.sqrt(2 * math.pi)) - ss / (2 * s * s)
                    lp += math.log(2 / (math.pi * 5 * (1 + (s / 5) ** 2)))
                    points.append((lp + normal(theta, 2) + normal(phi, 2) + normal(mu, 10), mu, phi, theta, s))
    best = max(points)
    assert (row.map_mu, row.map_phi, row.map_theta, row.map_sigma) == best[1:]
    w = np.exp(np.array([p[0] for p in points]) - best[0])
    for i, name in enumerate(("mu", "phi", "theta", "sigma"), 1):
        assert row[f"mean_{name}"] == pytest.approx(float((w * [p[i] for p in points]).sum() / w.sum()))


def test_score_windows(spark):
    windows = S.sliding_sequences(panel_of(spark, {"s": range(10)}), 3, 1, GRID)
    got = by_series(score_windows(windows, lambda x: x @ np.array([0.0, 1.0, 2.0])), "past", "predicted")
    assert got["s"][0] == ([0, 1, 2], 5.0) and len(got["s"]) == 6


def logistic_map(n=400):
    x = [0.3]
    for _ in range(n):
        x.append(3.7 * x[-1] * (1 - x[-1]))
    return x


def test_hidden_units_learn_a_nonlinear_rule_under_every_seed(spark):
    df = panel_of(spark, {"s": logistic_map(), "t": logistic_map(300)[::-1], "short": [0.1, 0.2, 0.3]})
    spec = NonlinearSpec(look_back=2, units=60, alpha=1e-4)
    runs = evaluate_seeds(df, spec, [1, 2], panel=GRID)
    rows = {(r.series_id, r.run): r for r in runs.collect()}
    assert set(rows) == {("s", 1), ("s", 2), ("t", 1), ("t", 2), ("short", None)}
    assert rows["s", 1].mase < 0.1 and rows["s", 2].mase < 0.1 and rows["s", 1].mae != rows["s", 2].mae
    assert rows["short", None].mae is None
    report = M.metrics_report(runs.filter("series_id = 's'"), ("series_id", "type")).first()
    maes = [rows["s", k].mae for k in (1, 2)]
    assert report.mae_avg == pytest.approx(np.mean(maes)) and report.mae_sd == pytest.approx(np.std(maes))
    assert report.mae == "%f+/-%f" % (np.mean(maes), np.std(maes))


@pytest.mark.parametrize("layout", LAYOUTS)
def test_nonlinear_models_equal_numpy(spark, layout):
    series, hours = skewed(21)
    series = {s: list(np.diff(np.log(v))) for s, v in series.items()}
    hours = {s: h[1:] for s, h in hours.items()}
    spec = NonlinearSpec(look_back=3, horizon=2, units=7, alpha=0.5)
    got = {(r.series_id, r.seed, r.pos): r for r in nonlinear_ar(panel_of(spark, series, hours), spec, (5, 9), layout).collect()}
    want = {}
    for s, v in series.items():
        places = range(4, len(v) - 1)
        x = np.array([[v[i - 1], v[i - 2], v[i - 3]] for i in places])
        y = np.array([v[i + 1] for i in places])
        stop = int(np.floor(0.6 * len(y)))
        for seed in (5, 9):
            w, b = hidden_layer(seed, 3, 7)
            h = np.maximum(x @ w.T + b, 0)
            hc, yc = h[:stop] - h[:stop].mean(0), y[:stop] - y[:stop].mean()
            beta = np.linalg.solve(hc.T @ hc + 0.5 * np.eye(7), hc.T @ yc)
            pred = h @ beta + y[:stop].mean() - h[:stop].mean(0) @ beta
            want.update({(s, seed, k + 1): (pred[k], y[k]) for k in range(stop, len(y))})
    assert set(got) == set(want)
    for key, (pred, actual) in want.items():
        assert got[key].predicted == pytest.approx(pred, abs=1e-9) and got[key].actual == pytest.approx(actual)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_score_panel_equals_stored_windows(spark, layout):
    series, hours = skewed(22)
    df = panel_of(spark, series, hours)
    model = lambda past: past @ np.arange(1.0, 12.0)
    want = by_series(score_windows(S.sliding_sequences(df, 11, 2, layout), model), "pos", "predicted", "target")
    got = by_series(score_panel(df, model, 11, 2, layout), "pos", "predicted", "actual")
    assert set(got) == set(want)
    assert all(g == pytest.approx(w) for s in want for g, w in zip(got[s], want[s])) and all(len(got[s]) == len(want[s]) for s in want)


def test_windows_with_missing_values_and_keys(spark):
    rows = [(None, START + dt.timedelta(hours=h), None if h == 3 else float(h)) for h in range(8)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    got = score_panel(df, lambda past: past.sum(1), 2, 1, BLOCKS).orderBy("pos").select("series_id", "predicted", "actual").collect()
    assert [tuple(r) for r in got] == [(None, 1.0, 2.0), (None, 3.0, None), (None, None, 4.0), (None, None, 5.0), (None, 9.0, 6.0)]
    assert score_panel(df.filter("false"), lambda past: past.sum(1), 2, 1, GRID).collect() == []


def pair_matrix(spark, seed=31, hours=60):
    rng = np.random.default_rng(seed)
    values = np.exp(rng.normal(3, 0.3, (hours, 2))).round(3)
    rows = [("c", START + dt.timedelta(hours=h), [float(a), float(b)]) for h, (a, b) in enumerate(values)]
    return values, spark.createDataFrame(rows, "center string, ts timestamp_ntz, values array<double>")


MATRICES = [GRID.with_keys("center").with_value("values"), BLOCKS.with_keys("center").with_value("values")]


@pytest.mark.parametrize("layout", MATRICES)
def test_vector_recursion_equals_a_linear_window_model(spark, layout):
    values, matrix = pair_matrix(spark)
    spec = VARSpec(look_back=3, log_difference=False, train_fraction=1.0)
    coef = var_ridge_fit(matrix, spec, layout)
    path = {(r.origin, r.step, r.member): r.predicted for r in var_recursive_forecast(matrix, coef, 4, spec, layout).collect()}
    found = coef.first()["coefs"]
    w, b = np.array([c["weights"] for c in found]), np.array([c["intercept"] for c in found])

    def linear(past):  # oldest first
        return past[:, ::-1].reshape(len(past), -1) @ w.T + b

    rolled = {(r.origin, r.step, r.member): r.predicted for r in roll_forward(matrix, linear, 3, 4, layout).collect()}
    assert len(path) == 58 * 4 * 2 and set(rolled) == set(path)
    assert all(path[k] == pytest.approx(rolled[k]) for k in path)
    past = values[:3].copy()
    for step in range(1, 5):
        ahead = w @ past[::-1].ravel() + b
        assert [path[START + dt.timedelta(hours=2), step, m] for m in (0, 1)] == pytest.approx(list(ahead))
        past = np.vstack([past[1:], ahead])


@pytest.mark.parametrize("scaling", ["joint", "member", "member_plus_one"])
@pytest.mark.parametrize("horizon", [1, 2, 3])
def test_vector_forecasts_come_back_in_prices(spark, scaling, horizon):
    values, matrix = pair_matrix(spark, 32)
    spec = VARSpec(look_back=2, horizon=horizon, scaling=scaling)
    layout = MATRICES[1]
    rows = var_ridge_predict(matrix, var_ridge_fit(matrix, spec, layout), spec, layout, restore=True).orderBy("member", "ts").collect()
    assert len(rows) == 2 * (60 - 4 - (horizon - 1))
    low, high = values.min(0), values.max(0)
    upper = {"joint": np.full(2, high.max()), "member": high, "member_plus_one": high + 1}[scaling]
    logs = np.log(1 + (values - low) * (upper - 1) / (high - low))
    for r in rows:
        at = (r.ts - START).total_seconds() / 3600 + horizon - 1
        m, at = r.member, int(at)
        assert r.restored_actual == pytest.approx(values[at, m]) and r.actual == pytest.approx(logs[at, m] - logs[at - 1, m])
        level = np.exp(r.predicted + logs[at - 1, m])
        assert r.restored == pytest.approx(low[m] + (level - 1) * (high[m] - low[m]) / (upper[m] - 1))


def test_lists_are_cut_at_one_common_hour(spark):
    series = {"a": [1.0, 2, 3, 4, 5, 6], "b": [10.0, 20, 30, 40, 50], "c": [7.0] * 6}
    hours = {"a": [0, 1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 6], "c": [0, 1, 2, 3, 4, 5]}
    lists = spark.createDataFrame([("x", "a", True), ("x", "b", False), ("y", "c", True), ("y", "a", False)], "center string, node string, is_center boolean")
    rows = train_test_lists(panel_of(spark, series, hours), lists, 0.5).collect()
    got = {(r.center, r.member, r.ts.hour): (r.value, r.split, r.pos, r.n) for r in rows}
    assert {k: v for k, v in got.items() if k[0] == "x"} == {
        ("x", m, h): (v, split, pos, 2) for m, vs in enumerate([[2, 3, 4, 5], [10, 20, 30, 40]])
        for h, v, split, pos in zip((1, 2, 3, 4), vs, ("train", "train", "test", "test"), (1, 2, 1, 2))}
    z = train_test_lists(panel_of(spark, series, hours), lists, 0.5, normalize=True, include_calendar=True)
    shown = {(r.center, r.member, r.ts.hour): (r.value, r.hour) for r in z.collect()}
    assert shown["x", 0, 4] == pytest.approx((5.0, 5.0)) and shown["y", 0, 5][0] == 0.0
    logs = train_test_lists(panel_of(spark, series, hours), lists, 0.5, log_differences=True).collect()
    assert {(r.center, r.member, r.split): r.value for r in logs if r.center == "x"} == pytest.approx(
        {("x", 0, "train"): np.log(1.5), ("x", 0, "test"): np.log(1.25), ("x", 1, "train"): np.log(2), ("x", 1, "test"): np.log(4 / 3)})


def test_identities(spark):
    series, hours = skewed(11)
    df = panel_of(spark, series, hours)
    back = S.undifference(df, S.difference(df, 5, BLOCKS), 5, BLOCKS)
    assert {s: [x for (x,) in v] for s, v in by_series(back, "value").items()} == {
        s: pytest.approx(x[5:]) for s, x in series.items()}
    stats = SC.minmax_stats(df, by=("series_id",), panel=GRID)
    diffs = SC.scale_log_difference(df, by=("series_id",), panel=GRID).withColumnRenamed("value", "predicted")
    restored = SC.inverse_log_scale(df, diffs, stats, GRID)
    joined = restored.join(df, ["series_id", "ts"]).select(F.max(F.abs(F.col("restored") - F.col("value")))).first()
    assert joined[0] < 1e-9 and restored.count() == df.count() - 3


def test_persistence_has_unit_mase(spark):
    series, _ = skewed(12)
    df = panel_of(spark, series)
    for r in M.forecast_metrics(M.persistence_forecast(df, 1, GRID), panel=GRID).collect():
        assert r.mase == pytest.approx(1.0)


def test_grid_has_every_series_and_setting(spark):
    series, _ = skewed(13)
    df = panel_of(spark, {s: x for s, x in series.items() if s != "tiny"})
    grid = evaluate_grid(df, {"a": ARSpec(p=1, lag=1, log_difference=False), "b": ARSpec(p=3)}, scalers=("refit", "train"), panel=GRID)
    rows = grid.collect()
    assert {(r.series_id, r.type, r.run) for r in rows} == {(s, t, k) for s in ("hot", "mid") for t in "ab" for k in (0, 1)}


def test_plain_report(spark):
    row = M.plain_report(spark.createDataFrame([("n", 0.5, 1.0, 0.25)], "node string, mae double, mase double, hits double")).first()
    assert tuple(row) == ("n", "0.500000", "1.000000", "0.250000")
