"""Edge rules on hand-made series: short, constant, spiked, tied, and calendars of every kind."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import diagnostics as D
from panelspark.operators import metrics as V
from panelspark.operators import resample as R
from panelspark.operators import split as J
from panelspark.sources import tables as T

SPEC = J.SplitSpec(0.7, 0.2, 0.1, 3)


def _panel(spark, series):
    rows = [(k, d.to_pydatetime(), None if v is None else float(v)) for k, (dates, values) in series.items() for d, v in zip(dates, values)]
    return spark.createDataFrame(rows, "series_id string, date timestamp, target double")


def test_strict_frequencies(spark):
    freqs = ["D", "3D", "W-WED", "2W-SUN", "h", "6h", "15min", "MS", "ME", "QS-JAN", "QS-FEB", "QE-DEC", "YS-JAN", "YE-DEC", "B"]
    series = {f: (pd.date_range("2015-01-01", periods=30, freq=f), range(30)) for f in freqs}
    rng = np.random.default_rng(0)
    gaps = pd.date_range("2015-01-01", periods=60, freq="D")[np.sort(rng.choice(60, 53, replace=False))]
    series["gaps"] = (gaps, range(53))
    series["two"] = (pd.date_range("2015-01-01", periods=2, freq="D"), range(2))
    got = {r.series_id: r.freq for r in D.frequency_scores(_panel(spark, series)).collect()}
    for f in freqs:
        assert got[f] == pd.infer_freq(series[f][0]), f
    assert got["gaps"] == "D"
    assert got["two"] == "unknown"


def test_short_and_constant_series(spark):
    dates = pd.date_range("2020-01-01", periods=40, freq="D")
    series = {"four": (dates[:4], [1, 2, 3, 4]), "flat": (dates, [7] * 40), "brief": (dates[:36], range(36)), "one": (dates[:1], [3])}
    panel = _panel(spark, series)
    stats = {r.series_id: r for r in D.base_stats(panel).collect()}
    assert stats["four"].std == 0.0 and stats["four"].trend_strength == 0.0
    assert stats["flat"].volatility_cv == 0.0 and stats["flat"].trend_strength == 0.0
    assert {r.series_id: r.stationary for r in D.data_summary(panel).collect()}["one"] is None
    parts = J.chronological(panel, J.SplitSpec(0.7, 0.2, 0.1, 1, 5))
    scale = {r.series_id: r.scale for r in V.mase_scale(parts.filter("split = 'train'"), 1).collect()}
    assert scale["flat"] is None
    reasons = {r.series_id: r.rejected for r in J.size_table(panel, SPEC).collect()}
    assert reasons == {"four": "no_complete_window", "flat": None, "brief": "training_too_short", "one": "fewer_than_three_observations"}


def test_two_largest_spikes_are_replaced(spark):
    dates = pd.date_range("2020-01-01", periods=60, freq="D")
    y = 10 + np.sin(np.arange(60))
    y[[5, 20, 40]] = [500, 900, 700]
    y[[19, 21]] = [11, 12]
    train = _panel(spark, {"s": (dates, y)})
    train = D.positioned(train).withColumn("n_train", F.col("n"))
    fixes = {r.pos: r.replacement for r in D.outlier_replacements(train).collect()}
    assert set(fixes) == {20, 40}
    assert fixes[20] == pytest.approx(np.median([y[17], y[18], y[19], y[21], y[22], y[23]]))
    assert D.replace_outliers(train).count() == 60
    flat = D.positioned(_panel(spark, {"f": (dates, [5.0] * 59 + [6.0])})).withColumn("n_train", F.col("n"))
    assert [r.pos for r in D.outlier_replacements(flat).collect()] == [59]


def test_interpolation_edges(spark):
    dates = pd.date_range("2020-01-01", periods=6, freq="D")
    got = R.interpolate(_panel(spark, {"s": (dates, [None, 1.0, None, None, 4.0, None])})).orderBy("date").collect()
    assert [r.target for r in got] == [1, 1, 2, 3, 4, 4]


def test_contract_problems(spark):
    rows = [("a", 0, 1.0, "2020-01-01"), ("a", 1, 2.0, "2020-01-03"), ("a", 2, 3.0, "2020-01-02"), ("b", 0, None, "2020-01-01"), ("c", 0, 1.0, "2020-01-01"), ("c", 1, 1.0, "2020-01-01"), ("d", 0, 1.0, None), ("e", 0, 1.0, "2020-01-01")]
    df = spark.createDataFrame(rows, "series_id string, arrival bigint, target double, date string").withColumn("date", F.to_date("date"))
    got = {r.series_id: r.verdict for r in J.partition_problems(df).collect()}
    assert got == {"a": "not chronological", "b": "missing targets", "c": "duplicate timestamps", "d": "invalid timestamps", "e": "ok"}


def test_winner_ties_go_to_the_earliest(spark):
    rows = [("r", 1, "x", 2.0), ("r", 2, "y", 1.0), ("r", 3, "z", 1.0), ("r", 4, "w", None), ("r", 5, "v", float("nan"))]
    best = V.winner(spark.createDataFrame(rows, "run_id string, step bigint, model string, mase double")).collect()[0]
    assert (best.best_step, best.best_model, best.best_mase) == (2, "y", 1.0)


def test_column_roles(spark):
    assert T.normalized_names([" Date", "DATE", "OT", "date "]) == ["date", "date_1", "ot", "date_2"]
    raw = spark.createDataFrame([("2020-01-01", "1.5", 3, 9), ("bad", "2", 3, 9), ("202002", "x", 3, 9), ("202003.0", "4", 3, 9)], "ds string, value string, d0 int, `Unnamed: 0` int")
    got = sorted((str(r.date)[:10], r.target) for r in T.as_series(raw).collect())
    assert got == [("2020-01-01", 1.5), ("2020-03-01", 4.0)]
    assert T.excluded_numeric_columns(raw) == ["d0"]
    with pytest.raises(ValueError):
        T.as_series(raw.drop("value"))
    with pytest.raises(ValueError):
        T.require_raw_series(spark.createDataFrame([(1.0, 2.0)], "target double, d0 double"))
    assert T.is_derived_feature("rolling_std_2") and not T.is_derived_feature("rolling_std_1") and not T.is_derived_feature("lag_0")


def test_entry_runs():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
