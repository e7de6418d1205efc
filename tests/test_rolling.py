"""Chains refitted at every origin against NumPy fits on copies of each history."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import rolling as R
from panelspark.operators import split as J
from panelspark.operators.preprocess import Step

SPEC = J.SplitSpec(0.6, 0.3, 0.1, 3)
LOG = [Step("log_transform"), Step("standard_scaler", scope="target")]
FULL = [Step("replace_outliers"), Step("boxcox_transform"), Step("standard_scaler", scope="target")]
LIMITS = [Step("replace_outliers"), Step("log_transform"), Step("minmax_scaler", scope="target")]


def values():
    draw = np.random.default_rng(3)
    a = np.exp(draw.normal(scale=0.3, size=90)) * 20
    a[[7, 60, 66]] *= 60  # the largest two change at an origin
    b = draw.normal(10, 4, size=75)
    b[58] = -6.0  # a new minimum, and with it a new shift
    c = np.full(60, 3.0)
    c[50:] = 4.0
    return {"a": a, "b": b, "c": c}


@pytest.fixture(scope="module")
def panel():
    return values()


def to_parts(spark, panel):
    rows = pd.concat([pd.DataFrame({"series_id": k, "date": pd.date_range("2010-01-01", periods=len(v), freq="D"), "target": v}) for k, v in panel.items()])
    return J.chronological(spark.createDataFrame(rows).withColumn("date", F.to_date("date")), SPEC)


@pytest.fixture(scope="module")
def parts(spark, panel):
    return to_parts(spark, panel).persist()


def marks_of(y):
    center = np.median(y)
    mad = 1.4826 * np.median(np.abs(y - center))
    scale = mad if mad > R.EPS else R.EPS * max(1, abs(center)) * 16
    far = [i for i in sorted(range(len(y)), key=lambda i: (-y[i], i))[:2] if (y[i] - center) / scale > 8 and len(y) >= 3]
    out = y.copy()
    for i in far:
        out[i] = np.median([y[j] for j in range(max(0, i - 3), min(len(y), i + 4)) if j not in far])
    return sorted(far), out


def fit(y, steps):
    chain = R.Chain.of(steps)
    far, y = marks_of(y) if chain.outliers else ([], y)
    shift, power = 0.0, 0.0
    if chain.transform == "boxcox":
        shift = 1 - y.min() if y.min() <= 0 else 0.0
        odds = []
        for p in R.POWERS:
            v = np.var(chain.forward(y, shift, p))
            odds.append(round((p - 1) * np.log(y + shift).sum() - len(y) / 2 * np.log(v), 9))
        power = min(R.POWERS, key=lambda p: (-odds[R.POWERS.index(p)], abs(p)))
    z = chain.forward(y, shift, power)
    offset, divisor = {"standard_scaler": (z.mean(), z.std()), "minmax_scaler": (z.min(), z.max() - z.min())}[chain.scaler]
    return far, y, shift, power, offset, divisor if abs(divisor) >= 1e-12 else 1.0


def origins(y, partition="validation"):
    val, test = int(len(y) * 0.3) // 3 * 3, int(len(y) * 0.1) // 3 * 3
    first = len(y) - val - test if partition == "validation" else len(y) - test
    return range(first, first + (val if partition == "validation" else test), 3)


@pytest.mark.parametrize("steps", [LOG, LIMITS, FULL], ids=["log", "limits", "full"])
def test_chain_numbers(spark, parts, panel, steps):
    some = parts if steps is FULL else parts.filter("series_id <> 'b'")
    some = some.filter("series_id <> 'c'") if steps is FULL else some  # a constant history has no likelihood
    got = {(r.series_id, r.origin): r for r in R.chain_numbers(some, steps, SPEC, tile=32).collect()}
    names = {k for k, _ in got}
    assert set(got) == {(k, o) for k in names for o in origins(panel[k])} and len(names) == 2
    for (k, o), r in got.items():
        far, y, shift, power, offset, divisor = fit(panel[k][:o].copy(), steps)
        assert [m.pos for m in r.marks] == far and [m.new for m in r.marks] == pytest.approx([y[i] for i in far])
        if steps is FULL:
            assert (r.shift, r.power) == (pytest.approx(shift), power)
        assert r.offset == pytest.approx(offset, rel=1e-9) and r.divisor == pytest.approx(divisor, rel=1e-7)
    if steps is FULL:
        assert len({r.shift for (k, _), r in got.items() if k == "b"}) == 2 and len({tuple(m.pos for m in r.marks) for (k, _), r in got.items() if k == "a"}) == 3


def expected(y, o, steps, model):
    _, y, shift, power, offset, divisor = fit(y[:o].copy(), steps)
    chain = R.Chain.of(steps)
    z = (chain.forward(y, shift, power) - offset) / divisor
    if model == "seasonal_naive":
        guess = np.array([z[o - 12 + s % 12] for s in range(3)])
    elif model == "mean":
        guess = np.full(3, z.mean())
    else:
        w = np.diff(z)
        beta = np.linalg.lstsq(np.array([[1.0, w[t - 1], w[t - 2]] for t in range(2, len(w))]), w[2:], rcond=None)[0]
        level, w, guess = z[-1], list(w), []
        for _ in range(3):
            w.append(beta @ [1.0, w[-1], w[-2]])
            level += w[-1]
            guess.append(level)
        guess = np.array(guess)
    return chain.backward(guess * divisor + offset, shift, power)


@pytest.mark.parametrize("steps,model,partition", [(LOG, "ar", "validation"), (FULL, "ar", "validation"), (FULL, "seasonal_naive", "test"), (LIMITS, "mean", "test")])
def test_chain_forecast(parts, panel, steps, model, partition):
    some = parts.filter("series_id in ('a', 'b')") if steps is FULL else parts.filter("series_id = 'a'")
    got = {(r.series_id, r.origin, r.step): r.yhat for r in R.chain_forecast(some, steps, SPEC, model, partition, p=2, powers=R.POWERS, tile=32).collect()}
    names = {k for k, *_ in got}
    assert set(got) == {(k, o, s) for k in names for o in origins(panel[k], partition) for s in (1, 2, 3)}
    for k in names:
        for o in origins(panel[k], partition):
            assert [got[k, o, s] for s in (1, 2, 3)] == pytest.approx(expected(panel[k], o, steps, model), rel=2e-5), (k, o)


def test_rows_from_an_origin_on_change_nothing_before_it(spark, panel):
    changed = {k: v.copy() for k, v in panel.items() if k == "a"}
    at = origins(panel["a"])[3]
    changed["a"][at:] = changed["a"][at:][::-1] * 1000
    one = R.chain_forecast(to_parts(spark, {"a": panel["a"]}), FULL, SPEC, p=2).filter(F.col("origin") <= at)
    two = R.chain_forecast(to_parts(spark, changed), FULL, SPEC, p=2).filter(F.col("origin") <= at)
    rows = lambda df: sorted((r.origin, r.step, round(r.yhat, 9)) for r in df.collect())
    assert rows(one) == rows(two) and len(rows(one)) == 12


def test_chains_that_make_no_sense():
    for steps in ([Step("standard_scaler")], [Step("log_transform"), Step("replace_outliers")], [Step("log_transform"), Step("boxcox_transform")], [Step("lag_features", lags=(1,))]):
        with pytest.raises(ValueError):
            R.Chain.of(steps)
