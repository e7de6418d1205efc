"""Runs of ordinary length take one shuffle; long ones give the same rows piece by piece."""

from pyspark.sql import functions as F

from panelspark.functions import text as X
from panelspark.operators import dynamics as Y
from panelspark.operators import ledger as L
from panelspark.operators.ordered import numbered
from panelspark.plans import q_fusion
from panelspark.plans.panels import table
from panelspark.sources import results as W


def ledger(spark):
    rows = [(r, s, float((s * 7 + r) % 11) + 1.0, ["ETS", "KNN"][s % 2], "%d" % (s % 3), s % 2 == 0) for r, n in ((1, 9), (2, 3), (3, 1)) for s in range(1, n + 1)]
    return spark.createDataFrame([*rows, (None, 1, 2.0, "ETS", "0", True), (2, None, 2.0, "ETS", "0", True)], "run_id long, step long, mase double, model string, hyperparameters string, uses_log boolean")


def shuffles(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_long_runs_give_the_rows_of_short_ones(spark):
    rows = ledger(spark)
    short, mixed = (sorted(map(tuple, numbered(rows, "run_id", "step", most=m).collect())) for m in (100, 2))
    assert short == mixed and len(short) == 13
    assert [r[-2:] for r in short if r[0] == 2] == [(1, 4), (2, 4), (3, 4)]
    short, mixed = (sorted(map(tuple, L.with_gains(rows, most=m, before="b").collect()), key=str) for m in (100, 2))
    assert short == mixed and len(short) == 13


def test_gains_take_one_shuffle(spark):
    assert shuffles(L.with_gains(ledger(spark)))[1] == 1


def test_a_ledger_isnt_copied_per_salt_to_see_whether_a_run_may_stop(spark):
    settings = spark.createDataFrame([(1, True, True), (2, False, True), (4, True, True)], "run_id long, log_recommended boolean, log_supported boolean")
    out = L.stop_eligibility(ledger(spark).filter("step is not null"), settings)
    assert "Generate" not in shuffles(out)[0]
    # run 1: 1.0 at step 3 (KNN), tried at 1, 3, 5, 7, 9 in all three forms, never with a log
    found = {r.run_id: (r.valid_trainings, r.best_model, r.best_trials, r.distinct_hyperparameters, r.blockers) for r in out.collect()}
    rows = [r for r in ledger(spark).collect() if r.run_id == 1]
    best = min(rows, key=lambda r: (r.mase, r.step)).model
    mine = [r for r in rows if r.model == best]
    assert found[1][:4] == (9, best, len(mine), len({r.hyperparameters for r in mine}))
    assert found[4] == (0, None, 0, 0, "minimum_valid_trainings_not_reached")


def test_short_runs_are_judged_in_one_shuffle_as_long_ones_are_by_groups(spark):
    rows = ledger(spark).filter("step is not null").unionByName(ledger(spark).filter("run_id = 2").selectExpr("run_id", "step + 10 AS step", "mase", "'Naive' AS model", "cast(null AS string) AS hyperparameters", "cast(null AS boolean) AS uses_log"))
    settings = spark.createDataFrame([(1, True, True), (2, True, True), (3, False, True), (4, True, True)], "run_id long, log_recommended boolean, log_supported boolean")
    judged = lambda **more: L.stop_eligibility(rows, settings, **more)
    groups, short, mixed = (sorted(map(tuple, judged(**more).collect()), key=str) for more in ({}, {"counted": rows}, {"counted": rows, "most": 4}))
    assert groups == short == mixed and len(groups) == 4
    plan, count = shuffles(judged(counted=rows))
    assert "SortAggregate" not in plan and count < shuffles(judged())[1]


def test_tail_of_a_run(spark):
    rows = spark.createDataFrame([(1, i, m) for i, m in enumerate("ABABBB")] + [(2, 0, "A"), (2, 1, "A"), (3, 0, "A"), (3, 1, "B")], "run_id long, step long, model string")
    assert {tuple(r) for r in L.tail_refinements(rows).collect()} == {(1, "B", 3), (2, "A", 1), (3, "B", 0)}


def test_signals_are_resolved_per_run(spark):
    fields = "run_id long, model string, family string, step long, seasonal string, yearly boolean, difference_order int, steps array<string>, lags array<int>"
    rows = [(r, "ETS", "Statistical", 1, "add", False, 0, ["lag_features"], [1, 5]) for r in (1, 2, 3)]
    runs = spark.createDataFrame([(1, 5, 12), (2, None, None), (3, None, 1)], "run_id long, suggested_lag int, seasonal_periods int")
    out = Y.resolved_signals(spark.createDataFrame(rows, fields), runs)
    assert {tuple(r) for r in out.collect()} == {(1, "seasonality"), (1, "autocorrelation"), (3, "seasonality"), (3, "autocorrelation")}
    assert "_salt" not in shuffles(out)[0]


def test_unseen_rows_take_one_shuffle(spark):
    new = spark.createDataFrame([(1, 1, "b"), (1, 1, "a"), (None, 2, "c"), (None, 3, "d")], "run_id long, step int, x string")
    have = spark.createDataFrame([("z", None, 2)], "x string, run_id long, step int")
    out = W.unseen(new, have, ["run_id", "step"])
    assert out.dtypes == new.dtypes
    assert "Exists" not in shuffles(out)[0] and "LeftAnti" not in shuffles(out)[0] and shuffles(out)[1] == 1
    assert {tuple(r) for r in out.collect()} == {(1, 1, "a"), (None, 3, "d")}


def test_parts_are_gathered_before_they_are_averaged(spark):
    plan = q_fusion._control_inputs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" not in plan[plan.rindex("Exchange hashpartitioning") :]
    assert table(spark, "/root/testdata/sf0.001", "lineitem").select("l_partkey").distinct().count() == q_fusion._control_inputs(spark, "/root/testdata/sf0.001").count()


def test_clauses_without_claims_are_kept(spark):
    texts = ["The time series is short; sales grew", "sampling looks  irregular and DATA are fine", "database is short, ; , numerical  data has many NA", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in rows.select(X.sanitize(F.col("t"))[0], X.unclaimed(X.clauses(F.col("t")))).collect()]
    assert got == [(w, w) for w in ["sales grew", "DATA are fine", "database is short", "", None]]
