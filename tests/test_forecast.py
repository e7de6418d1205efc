"""Forecasters against direct NumPy computations, refitted origin by origin."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import backtest as K
from panelspark.operators import forecast as L
from panelspark.operators import split as J

SPEC = J.SplitSpec(0.7, 0.2, 0.1, 3)


def series(n=70, seed=0, level=50.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    y = level + 0.3 * t + 6 * np.sin(2 * np.pi * t / 12) + rng.normal(scale=2, size=n)
    return pd.DataFrame({"date": pd.date_range("2010-01-01", periods=n, freq="MS"), "target": y})


@pytest.fixture(scope="module")
def panel():
    return {"a": series(), "b": series(95, 1, 200.0)}


@pytest.fixture(scope="module")
def parts(spark, panel):
    rows = pd.concat([p.assign(series_id=k) for k, p in panel.items()])
    df = spark.createDataFrame(rows[["series_id", "date", "target"]])
    return J.chronological(df, SPEC).persist()


def sizes(n):
    val, test = int(n * 0.2) // 3 * 3, int(n * 0.1) // 3 * 3
    return n - val - test, val, test


def collect(df):
    pdf = df.toPandas()
    return {(r.series_id, int(r.pos)): r.yhat for r in pdf.itertuples()}


def each_origin(panel):
    for k, p in panel.items():
        y = p.target.to_numpy()
        first, val, _ = sizes(len(y))
        for origin in range(first, first + val, 3):
            yield k, y, p, origin


def test_ar_ols(parts, panel):
    got = collect(L.ar_ols(parts, SPEC, p=2, d=1, seasonal_p=1, m=12))
    for k, y, _, origin in each_origin(panel):
        z = np.diff(y[:origin])
        lags = [1, 2, 12]
        x = np.array([[1.0, *[z[t - j] for j in lags]] for t in range(12, len(z))])
        beta = np.linalg.lstsq(x, z[12:], rcond=None)[0]
        zs, level = list(z), y[origin - 1]
        for h in range(3):
            nxt = beta @ [1.0, *[zs[-j] for j in lags]]
            zs.append(nxt)
            level += nxt
            assert got[k, origin + h] == pytest.approx(level, rel=1e-5)


def test_seasonal_difference(parts, panel):
    got = collect(L.ar_ols(parts, SPEC, p=1, d=0, seasonal_d=1, m=12))
    for k, y, _, origin in each_origin(panel):
        z = y[12:origin] - y[: origin - 12]
        beta = np.linalg.lstsq(np.c_[np.ones(len(z) - 1), z[:-1]], z[1:], rcond=None)[0]
        nxt = z[-1]
        for h in range(3):
            nxt = beta @ [1.0, nxt]
            assert got[k, origin + h] == pytest.approx(y[origin + h - 12] + nxt, rel=1e-5)


def test_additive_regression(parts, panel):
    got = collect(L.additive_regression(parts, SPEC, L.Additive(hinges=2, seasons=((365.25, 2),))))

    def design(dates, pos, n_train):
        t = pos / n_train
        day = (dates - pd.Timestamp("1970-01-01")) / pd.Timedelta("1D")
        cols = [np.ones(len(t)), t, *[np.maximum(0, t - 0.8 * (j + 1) / 3) for j in range(2)]]
        for o in (1, 2):
            cols += [np.sin(2 * np.pi * o * day / 365.25), np.cos(2 * np.pi * o * day / 365.25)]
        return np.column_stack(cols)

    for k, y, p, origin in each_origin(panel):
        n_train = sizes(len(y))[0]
        x = design(p.date, np.arange(len(y)), n_train)
        beta = np.linalg.lstsq(x[:origin], y[:origin], rcond=None)[0]
        for h in range(3):
            assert got[k, origin + h] == pytest.approx(float(x[origin + h] @ beta), rel=1e-3)


def holt_winters(y, m, a, b, g):
    level, slope, ring = y[:m].mean(), (y[m : 2 * m].mean() - y[:m].mean()) / m, y[:m] - y[:m].mean()
    ring = ring.copy()
    sse = 0.0
    for t, v in enumerate(y):
        i = t % m
        e = v - level - slope - ring[i]
        sse += e * e
        new = a * (v - ring[i]) + (1 - a) * (level + slope)
        slope = b * (new - level) + (1 - b) * slope
        ring[i] = g * (v - new) + (1 - g) * ring[i]
        level = new
    return sse, level, slope, ring


@pytest.mark.parametrize("block", [7, 16, 1 << 18])
@pytest.mark.parametrize("kind", ["add", "mul"])
def test_exponential_smoothing_in_blocks(parts, panel, block, kind):
    got = collect(L.exponential_smoothing(parts, SPEC, trend=kind, seasonal=kind, m=12, block=block))
    for k, y, _, origin in each_origin(panel):
        hist = np.log(y[:origin]) if kind == "mul" else y[:origin]
        _, level, slope, ring = min((holt_winters(hist, 12, a, b, g) for a, b, g in L.GRID), key=lambda r: r[0])
        for h in range(3):
            value = level + (h + 1) * slope + ring[(origin + h) % 12]
            assert got[k, origin + h] == pytest.approx(np.exp(value) if kind == "mul" else value, rel=1e-6)


def test_multiplicative_needs_positive(spark):
    p = series().assign(series_id="x")
    p.loc[5, "target"] = 0.0
    parts = J.chronological(spark.createDataFrame(p[["series_id", "date", "target"]]), SPEC)
    with pytest.raises(Exception, match="positive target"):
        L.exponential_smoothing(parts, SPEC, trend="mul", seasonal=None, m=1).collect()
    with pytest.raises(ValueError):
        L.exponential_smoothing(parts, SPEC, m=1)


def test_elastic_net(parts, panel):
    alpha, l1 = 0.3, 0.6
    got = collect(L.elastic_net(parts, SPEC, lags=(1, 12), windows=(3,), alpha=alpha, l1_ratio=l1))

    def row(y, t, month):
        a = 2 * np.pi * month / 12
        return [y[t - 1], y[t - 12], np.mean(y[t - 3 : t]), np.sin(a), np.cos(a)]

    for k, y, p, origin in each_origin(panel):
        x = np.array([row(y, t, p.date[t].month) for t in range(12, origin)])
        v = y[12:origin]
        xc, vc = x - x.mean(0), v - v.mean()
        w, n = np.zeros(5), len(v)
        for _ in range(3000):
            for j in range(5):
                rho = xc[:, j] @ (vc - xc @ w + xc[:, j] * w[j])
                w[j] = np.sign(rho) * max(abs(rho) - alpha * l1 * n, 0) / (xc[:, j] @ xc[:, j] + alpha * (1 - l1) * n)
        bias, hist = v.mean() - x.mean(0) @ w, list(y[:origin])
        for h in range(3):
            value = bias + np.dot(w, row(np.array([*hist, 0.0]), len(hist), p.date[origin + h].month))
            hist.append(value)
            assert got[k, origin + h] == pytest.approx(value, rel=1e-4)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("cell_rows", [20_000, 13])
def test_nearest_neighbours(spark, p, cell_rows):
    rng = np.random.default_rng(2)
    crowd = np.r_[rng.normal(size=(150, 4)) * 0.01, rng.normal(size=(120, 4)), np.zeros((5, 4))]
    train = [("hot", i, [float(v) for v in x], float(i % 7)) for i, x in enumerate(crowd)] + [("few", i, [float(i)] * 4, 1.0) for i in range(3)]
    queries = [("hot", 1000 + i, [float(v) for v in x]) for i, x in enumerate(np.r_[rng.normal(size=(20, 4)), np.zeros((1, 4))])] + [("few", 2000, [0.4] * 4)]
    t = spark.createDataFrame(train, "series_id string, id bigint, x array<double>, value double")
    q = spark.createDataFrame(queries, "series_id string, query_id bigint, x array<double>")
    found = L.nearest(t, q, 5, p, cell_rows=cell_rows).persist()
    got = {}
    for r in found.collect():
        got.setdefault((r.series_id, r.query_id), []).append((r["rank"], r.id))
    for key, qid, x in queries:
        mine = [(float((np.abs(np.array(v) - np.array(x)) ** p).sum() ** (1 / p)), i, val) for k, i, v, val in train if k == key]
        want = sorted(mine)[:5]
        assert [i for _, i in sorted(got[key, qid])] == [i for _, i, _ in want]
    yhat = {r.query_id: r.yhat for r in L.knn_regression(found, "distance").collect()}
    assert yhat[1020] == pytest.approx(np.mean([i % 7 for i in range(270, 275)]))


def test_future_rows_change_nothing(spark, panel):
    """Altering rows from an origin on leaves the forecasts of that origin as they were."""
    p = panel["a"].assign(series_id="a")
    first, val, _ = sizes(len(p))
    origin = first + 6
    changed = p.copy()
    changed.loc[origin:, "target"] *= 10
    both = []
    for frame in (p, changed):
        parts = J.chronological(spark.createDataFrame(frame[["series_id", "date", "target"]]), SPEC)
        out = {}
        for model, kw in {"ar_ols": {}, "exponential_smoothing": {}, "additive_regression": {"shape": L.Additive()}, "elastic_net": {}, "seasonal_naive": {"period": 12}}.items():
            got = L.forecast(model, parts, SPEC, **kw).filter(F.col("origin") <= origin)
            out[model] = {(r.origin, r.step): r.yhat for r in got.collect()}
        both.append(out)
    for model in both[0]:
        assert both[0][model] == pytest.approx(both[1][model]), model


def test_short_lags_refused(parts):
    with pytest.raises(ValueError):
        L.tree_forecast(parts, SPEC, lags=(1, 12))
    with pytest.raises(ValueError):
        L.tree_forecast(parts, SPEC, lags=(2,))
    with pytest.raises(ValueError):
        L.forecast("oracle", parts, SPEC)


def test_every_validation_row_is_forecast_once(parts):
    got = K.seasonal_naive(parts, SPEC, 12)
    problems = K.alignment(J.search_rows(parts).filter("split = 'validation'"), got).collect()
    assert all(r.missing == r.surplus == r.repeated == 0 for r in problems)


def test_incomplete_forecasts_have_no_metrics_and_never_win(spark):
    from panelspark.operators.metrics import forecast_metrics, per_origin, winner

    nan, inf = float("nan"), float("inf")
    cases = {"whole": [1.5, 2.5, 90.0], "null": [1.1, None, None], "nan": [1.0, 2.0, nan], "infinite": [1.0, inf, 100.0]}
    rows = [(m, 0, s, y, v) for m, values in cases.items() for s, (y, v) in enumerate(zip([1.0, 2.0, 100.0], values), start=1)]
    predictions = spark.createDataFrame(rows, "series_id string, origin long, step long, y double, yhat double")
    scale = spark.createDataFrame([(m, 2.0) for m in cases], "series_id string, scale double")
    scored = {r.series_id: r for r in forecast_metrics(predictions, scale).collect()}
    assert scored["whole"].mae == pytest.approx(11.0 / 3) and scored["whole"].mase == pytest.approx(11.0 / 6)
    for m in ("null", "nan", "infinite"):
        assert scored[m].n_predictions == 3
        assert all(getattr(scored[m], c) is None for c in ("mse", "rmse", "mae", "r2", "mape", "mase"))
    assert {r.series_id: r.mase is None for r in per_origin(predictions, scale).collect()} == {m: m != "whole" for m in cases}
    trials = spark.createDataFrame([("run", k, m, scored[m].mase) for k, m in enumerate(cases)], "run_id string, step long, model string, mase double")
    assert winner(trials).first().best_model == "whole"


def test_boxcox_power_is_found_beyond_two(spark):
    from panelspark.operators.preprocess import fit_boxcox

    rng = np.random.default_rng(3)
    powered = {"far": 3.7, "near": 0.5, "below": -3.0}
    rows = []
    for name, power in powered.items():
        normal = 30.0 + rng.normal(size=4000) if power > 0 else 0.2 + 0.01 * rng.normal(size=4000)
        rows += [(name, i, float(v ** (1.0 / power))) for i, v in enumerate(normal * (40.0 if name == "far" else 1.0))]
    rows += [("constant", i, 5.0) for i in range(40)]
    found = {r.series_id: r.power for r in fit_boxcox(spark.createDataFrame(rows, "series_id string, pos long, target double")).collect()}
    assert found["constant"] == 0.0

    def likelihood(x, power):
        z = np.log(x) if abs(power) < 1e-12 else x**power / power
        return (power - 1.0) * np.log(x).sum() - len(x) / 2.0 * np.log(z.var())

    for name in powered:
        x = np.array([v for key, _, v in rows if key == name])
        grid = np.arange(-15.0, 15.0, 0.01)
        best = max(grid, key=lambda p: likelihood(x, p))
        assert found[name] == pytest.approx(best, abs=0.02)


def test_autoregression_without_lags_is_a_drift(spark):
    from panelspark.operators.forecast import ar_ols
    from panelspark.operators.split import SplitSpec, chronological

    days = [("s", f"20{20 + i // 12:02d}-{i % 12 + 1:02d}-01", float(i * i % 17)) for i in range(120)]
    panel = spark.createDataFrame(days, "series_id string, date string, target double").selectExpr("series_id", "to_date(date) AS date", "target")
    spec = SplitSpec(0.7, 0.2, 0.1, 3)
    got = ar_ols(chronological(panel, spec), spec, p=0, d=1).orderBy("pos").collect()
    y = [v for _, _, v in days]
    for r in got:
        drift = (y[r.origin - 1] - y[0]) / (r.origin - 1)
        assert r.yhat == pytest.approx(y[r.origin - 1] + r.step * drift, abs=1e-5)


@pytest.mark.parametrize("partition", ["validation", "test"])
def test_knn_forecasts_feed_its_lags(parts, panel, partition):
    got = collect(L.knn_forecast(parts, SPEC, lags=(1, 2, 12), k=4, weights="distance", partition=partition))
    lags, n_seen = (1, 2, 12), 0
    for name, p in panel.items():
        y = p.target.to_numpy()
        first, val, test = sizes(len(y))
        first, count = (first, val) if partition == "validation" else (first + val, test)
        for origin in range(first, first + count, 3):
            x = np.array([[y[t - v] for v in lags] for t in range(12, origin)])
            line = list(y[:origin])  # all rows before the origin, those of validation too when the test part is forecast
            for step in range(3):
                d = np.sqrt(((x - np.array([line[-v] for v in lags])) ** 2).sum(axis=1))
                near = np.lexsort((np.arange(len(d)), d))[:4]
                line.append(float((y[12 + near] / d[near]).sum() / (1 / d[near]).sum()))
                assert got[name, origin + step] == pytest.approx(line[-1], rel=1e-9)
                n_seen += 1
    assert n_seen == len(got)


def test_nearest_rows_before_a_limit(spark):
    draw = np.random.default_rng(11)
    x = draw.normal(size=(400, 3))
    train = spark.createDataFrame([("s", k, v.tolist(), float(k)) for k, v in enumerate(x)], "series_id string, id bigint, x array<double>, value double")
    asked = [(7, 390), (8, 60), (9, 2), (10, 0)]
    held = L.Neighbours(train, pivots=6, cell_rows=50)
    queries = spark.createDataFrame([("s", q, x[q].tolist(), b) for q, b in asked], "series_id string, query_id bigint, x array<double>, before bigint")
    got = {}
    for r in held.search(queries, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    for q, b in asked:
        d = np.sqrt(((x[:b] - x[q]) ** 2).sum(axis=1))
        assert [i for _, i in sorted(got.get(q, []))] == np.lexsort((np.arange(b), d))[:5].tolist()
