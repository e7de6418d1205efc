"""Candidate tables against NumPy fits on each history; tables that differ by series; candidates that can't be fitted."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import metrics as V
from panelspark.operators import split as J
from panelspark.operators import tournament as T

SPEC = J.SplitSpec(0.6, 0.2, 0.2, 3)


@pytest.fixture(scope="module")
def panel():
    draw = np.random.default_rng(5)
    t = np.arange(70)
    return {"a": 1e6 + 3 * t + draw.normal(size=70).cumsum(), "b": 5 + np.sin(t / 3) + draw.normal(scale=0.1, size=70), "flat": np.full(64, 2.0)}


@pytest.fixture(scope="module")
def parts(spark, panel):
    rows = pd.concat([pd.DataFrame({"series_id": k, "date": pd.date_range("2010-01-01", periods=len(v), freq="D"), "target": v}) for k, v in panel.items()])
    return J.chronological(spark.createDataFrame(rows).withColumn("date", F.to_date("date")), SPEC).persist()


def sizes(n):
    val, test = int(n * 0.2) // 3 * 3, int(n * 0.2) // 3 * 3
    return n - val - test, val, test


def least_squares(y, p, d):
    w = np.diff(y, d) if d else y
    x = np.array([[1.0, *[w[t - k] for k in range(1, p + 1)]] for t in range(p, len(w))])
    x0 = x - x.mean(axis=0)
    slope = np.linalg.lstsq(x0[:, 1:], w[p:] - w[p:].mean(), rcond=1e-10)[0]
    return np.array([w[p:].mean() - slope @ x[:, 1:].mean(axis=0), *slope])


def recursed(y, beta, p, d):
    y = list(y)
    for _ in range(3):
        w = np.diff(y, d) if d else np.array(y)
        step = beta[0] + sum(b * w[-k] for k, b in enumerate(beta[1:], start=1))
        for j in range(1, d + 1):
            step += np.diff(y, j - 1)[-1] if j > 1 else y[-1]
        y.append(step)
    return y[-3:]


def test_autoregressions_of_all_orders(parts, panel):
    orders = [(1, 0), (2, 0), (3, 1), (1, 2)]
    table = T.candidate_table(parts, [(k, "ar", {"p": p, "d": d}) for k, (p, d) in enumerate(orders)])
    for partition in ("validation", "test"):
        fits = T.fit_candidates(parts, table, SPEC, partition)
        got = {(r.series_id, r.candidate_id, r.origin, r.step): r.yhat for r in T.predict_candidates(fits, parts, SPEC, partition).collect()}
        used = {(r.series_id, r.candidate_id, r.origin): r.n_used for r in fits.collect()}
        for name in ("a", "b"):
            y = panel[name]
            train, val, test = sizes(len(y))
            first, count = (train, val) if partition == "validation" else (train + val, test)
            for origin in range(first, first + count, 3):
                for k, (p, d) in enumerate(orders):
                    want = recursed(y[:origin], least_squares(y[:origin], p, d), p, d)
                    assert [got[name, k, origin, s] for s in (1, 2, 3)] == pytest.approx(want, rel=1e-5), (name, p, d, origin)
                    assert used[name, k, origin] == origin - p - d


def test_a_series_that_does_not_vary(parts):
    table = T.candidate_table(parts, [(1, "ar", {"p": 1, "d": 1}), (2, "trend", {}), (3, "mean", {}), (4, "simple_smoothing", {"alpha": 0.5})])
    rows = T.predict_candidates(T.fit_candidates(parts, table, SPEC), parts, SPEC).filter("series_id = 'flat'").collect()
    assert len(rows) == 4 * 12 and all(r.yhat == pytest.approx(2.0) for r in rows)


def test_candidates_of_their_own_and_candidates_that_cannot_be_fitted(spark, parts):
    entries = [("a", 1, "trend", {}), ("a", 2, "seasonal_naive", {"m": 60.0}), ("b", 7, "simple_smoothing", {}), ("b", 8, "simple_smoothing", {"alpha": 0.2})]
    table = spark.createDataFrame(entries, "series_id string, candidate_id bigint, model string, settings map<string, double>")
    fits = {(r.series_id, r.candidate_id, r.origin): r for r in T.fit_candidates(parts, table, SPEC).collect()}
    assert {k[:2] for k in fits} == {("a", 1), ("a", 2), ("b", 7), ("b", 8)}
    assert all(r.finite == (k[1] in (1, 8)) for k, r in fits.items())  # neither 60 rows of history nor a weight are there
    scale = V.mase_scale(parts.filter("split = 'train'"), 1)
    scores = {(r.series_id, r.candidate_id): r for r in T.candidate_scores(parts, table, SPEC, scale).collect()}
    assert scores["a", 2].mase is None and scores["b", 7].mase is None and scores["a", 1].mase > 0
    done = {r.series_id: r for r in T.evaluated(parts, table, SPEC, scale).collect()}
    assert (done["a"].candidate_id, done["b"].candidate_id, done["flat"].candidate_id) == (1, 8, None)
    assert done["a"].n_test == done["b"].n_test == 12 and done["flat"].n_test is None
    with pytest.raises(ValueError):
        T.candidate_table(parts, [(1, "oracle", {})])


def test_test_rows_of_an_origin_do_not_matter(spark, parts, panel):
    table = T.candidate_table(parts, [(1, "ar", {"p": 2, "d": 1}), (2, "mean", {}), (3, "simple_smoothing", {"alpha": 0.5})])
    changed = parts.withColumn("target", F.when(F.col("pos") >= F.col("n_train") + 6, F.col("target") * -3).otherwise(F.col("target")))
    rows = lambda df: sorted((r.series_id, r.candidate_id, r.origin, r.step, round(r.yhat, 5)) for r in T.predict_candidates(T.fit_candidates(df, table, SPEC), df, SPEC).filter(F.col("origin") <= 52).filter("series_id <> 'flat'").collect())
    first = {k: sizes(len(v))[0] for k, v in panel.items()}
    seen = [r for r in rows(parts) if r[2] <= first[r[0]] + 6]
    assert seen and set(seen) <= set(rows(changed))
