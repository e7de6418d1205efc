"""Appends that a repeated job doesn't double."""

import pytest
from pyspark.sql import functions as F

from panelspark.sources import results as W

KIND = "run_id string, batch_id long, arrival long, event_type string, timestamp string, iteration long, influence_mode string, payload string"


def event(run, batch, arrival, name="fit", payload="{}"):
    return (run, batch, arrival, name, "2024-01-01T00:00:00", arrival, "fuzzy", payload)


def trace(spark, path):
    return sorted((r["run_id"] or "", r["event_no"], r["arrival"], r["event_type"]) for r in W.stored(spark, path).collect())


def test_events_are_there_once_and_numbers_go_on(spark, tmp_path):
    path = str(tmp_path / "trace")
    first = spark.createDataFrame([event("a", 0, 5), event("a", 0, 7), event("b", 0, 1)], KIND)
    second = spark.createDataFrame([event("a", 1, 9), event("a", 1, 9, "stop"), event("c", 1, 2)], KIND)
    for batch in (first, first.unionByName(second), second, first):
        W.append_events(batch, path)
    assert trace(spark, path) == [("a", 1, 5, "fit"), ("a", 2, 7, "fit"), ("a", 3, 9, "fit"), ("b", 1, 1, "fit"), ("c", 1, 2, "fit")]


def test_numbers_follow_the_last_one_not_the_count(spark):
    old = W.events(spark.createDataFrame([event("a", 0, k) for k in range(5)], KIND)).filter("event_no in (2, 5)")
    new = W.events(spark.createDataFrame([event("a", 1, 8)], KIND), old)
    assert [r["event_id"] for r in new.collect()] == ["search-event-6"]


def test_a_part_that_was_written_is_filled_up(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([("a", k, float(k)) for k in range(9)] + [(None, None, 1.0)] * 3, "run string, step long, value double")
    assert W.stored(spark, path) is None
    for part in (rows.filter("step < 4"), rows, rows, rows.limit(0)):
        W.append_once(part, path, ["run", "step"])
    assert W.stored(spark, path).count() == 10
    W.append_once(rows.select("run").distinct(), str(tmp_path / "runs"), ["run"])
    assert W.stored(spark, str(tmp_path / "runs")).count() == 2


def test_held_out_fields_are_refused(spark, tmp_path):
    new = spark.createDataFrame([event("a", 0, 1, payload='{"test_metrics": 1}')], KIND)
    with pytest.raises(Exception, match="held-out"):
        W.append_events(new, str(tmp_path / "trace"))
    with pytest.raises(Exception, match="without run_id"):
        W.append_events(spark.createDataFrame([event(None, 0, 1)], KIND), str(tmp_path / "trace"))
    assert W.stored(spark, str(tmp_path / "trace")) is None or W.stored(spark, str(tmp_path / "trace")).agg(F.count(F.lit(1))).first()[0] == 0
