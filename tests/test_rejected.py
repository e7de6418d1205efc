"""A series that can't be split stays in the results, with its reason."""

import datetime

import pytest

from panelspark.operators import split as J
from panelspark.plans import load


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("short"))
    month = lambda k: datetime.date(2000 + k // 12, 1 + k % 12, 1)
    rows = [(name, month(k), 100.0 + 7 * (k % 12) + k) for name, n in (("long", 80), ("short", 20), ("tiny", 2)) for k in range(n)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate date, o_totalprice double").write.parquet(f"{path}/orders.parquet")
    return path


@pytest.mark.parametrize("name", ["ar_seasonal_backtest", "smoothing_additive_backtest", "knn_backtest", "boxcox_round_trip", "mase_reference_detected"])
def test_rejected_series_are_in_the_results(spark, folder, name):
    got = {r.series_id: r.asDict() for r in load().QUERIES[name](spark, folder).collect()}
    assert {k: r["rejected"] for k, r in got.items()} == {"long": None, "short": "no_complete_window", "tiny": "fewer_than_three_observations"}
    if name.endswith("_backtest"):
        assert got["long"]["n_predictions"] == 15 and got["long"]["mae"] is not None
        assert got["short"]["n_predictions"] == 0 and got["short"]["mae"] is None and got["short"]["mase"] is None and got["short"]["model"] == got["long"]["model"]


def test_rows_of_a_series_and_a_null_key(spark):
    dates = [(datetime.date(2020, 1, 1) + datetime.timedelta(k), 1.0) for k in range(80)]
    panel = spark.createDataFrame([(None, *d) for d in dates] + [("b", *d) for d in dates[:5]], "series_id string, date date, target double")
    results = spark.createDataFrame([(None, 1), (None, 2)], "series_id string, x int")
    got = J.accounted(results, panel, J.SplitSpec(0.7, 0.2, 0.1, 3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 1, None), (None, 2, None), ("b", None, "no_complete_window")], key=str)
