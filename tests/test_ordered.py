"""Block-wise ordered computations against pandas, with one key holding most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators.ordered import attach, framed, running, with_position
from panelspark.operators.quantiles import ACCURACY, exact_median


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    parts = []
    for key, n in (("hot", 700), ("a", 40), ("b", 3), ("c", 1)):
        day = np.sort(rng.choice(4000, n, replace=False))
        y = rng.normal(size=n).round(3)
        y[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"k": key, "date": pd.Timestamp("2000-01-01") + pd.to_timedelta(day, "D"), "y": y}))
    return pd.concat(parts, ignore_index=True)


def _frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("y", F.when(~F.isnan("y"), F.col("y"))).repartition(7)


def test_positions(spark, rows):
    got = with_position(_frame(spark, rows), "k", "date").toPandas().sort_values(["k", "date"]).reset_index(drop=True)
    want = rows.sort_values(["k", "date"]).reset_index(drop=True)
    assert (got.pos == want.groupby("k").cumcount()).all()
    assert (got.n == want.groupby("k").k.transform("size")).all()


@pytest.mark.parametrize("block", [5, 64, 1 << 16])
def test_bounded_frames(spark, rows, block):
    df = with_position(_frame(spark, rows), "k", "date")
    cols = {
        "lag3": lambda w: F.lag("y", 3).over(w),
        "lead2": lambda w: F.lead("y", 2).over(w),
        "sum4": lambda w: F.sum("y").over(w.rowsBetween(-4, -1)),
    }
    got = framed(df, "k", cols, back=4, ahead=2, block=block).toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    want = rows.sort_values(["k", "date"]).reset_index(drop=True)
    g = want.groupby("k").y
    assert len(got) == len(want)
    np.testing.assert_allclose(got.lag3.astype(float), g.shift(3))
    np.testing.assert_allclose(got.lead2.astype(float), g.shift(-2))
    total = want.groupby("k").y.transform(lambda s: s.shift(1).rolling(4, min_periods=1).sum())
    np.testing.assert_allclose(got.sum4.astype(float), total)


@pytest.mark.parametrize("block", [5, 64, 1 << 16])
def test_running_values(spark, rows, block):
    df = with_position(_frame(spark, rows), "k", "date")
    cols = {
        "low": ("min", F.col("y"), True),
        "high_before": ("max", F.col("y"), False),
        "total": ("sum", F.col("y"), True),
        "last": ("last", F.col("y"), True),
        "after": ("next", F.col("y"), False),
    }
    got = running(df, "k", cols, block=block).toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    want = rows.sort_values(["k", "date"]).reset_index(drop=True)
    g = want.groupby("k").y
    np.testing.assert_allclose(got.low.astype(float), g.transform(lambda s: s.cummin().ffill()))
    np.testing.assert_allclose(got.high_before.astype(float), g.transform(lambda s: s.cummax().ffill().shift(1)))
    np.testing.assert_allclose(got["last"].astype(float), g.ffill())
    np.testing.assert_allclose(got.after.astype(float), g.transform(lambda s: s.bfill().shift(-1)))
    np.testing.assert_allclose(got.total.astype(float), g.transform(lambda s: s.cumsum().ffill()))


def test_attach_keeps_rows(spark, rows):
    df = _frame(spark, rows)
    per_key = df.groupBy("k").agg(F.count(F.lit(1)).alias("c")).filter("k != 'b'")
    assert attach(df, per_key, "k", "date").count() == (rows.k != "b").sum()
    assert attach(df, per_key, "k", "date", how="left").count() == len(rows)


@pytest.mark.parametrize("n", [1, 2, 7, ACCURACY // 8 - 1, ACCURACY // 8 + 2, 30_001])
def test_exact_median(spark, n):
    rng = np.random.default_rng(n)
    heavy = rng.choice([0.0, 1.0, 1.0, 1.0, 5.0], n) if n % 2 else rng.normal(size=n)
    pdf = pd.DataFrame({"k": "x", "v": heavy})
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["one"], "v": [3.5]})])
    df = spark.createDataFrame(pdf).repartition(5)
    got = {r.k: r.median for r in exact_median(df, "k", F.col("v")).collect()}
    assert got == {"x": float(np.median(heavy)), "one": 3.5}
    upper = {r.k: r.median for r in exact_median(df, "k", F.col("v"), upper=True).collect()}
    assert upper["x"] == float(np.sort(heavy)[n // 2])
