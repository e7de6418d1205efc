"""The tasks that write a folder per run follow the number of runs."""

import datetime

from panelspark.plans import q_candidates


def test_tasks_follow_the_runs(spark, tmp_path, monkeypatch):
    rows = [(k, k % 7, k % 40, 1 + k % 3, float(2 + k % 5), 100.0 + k, 0.01 * (k % 6), 0.02, "ARN"[k % 3], "FO"[k % 2], datetime.date(1996, 1, 1)) for k in range(400)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate date"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(q_candidates, "RUNS_PER_TASK", 2, raising=False)
    seen, write = [], q_candidates.W.write_runs
    monkeypatch.setattr(q_candidates.W, "write_runs", lambda df, *a: seen.append(df.rdd.getNumPartitions()) or write(df, *a))
    found = q_candidates.run_summaries_written(spark, str(tmp_path)).collect()
    assert seen == [20]
    assert sorted(r["run_id"] for r in found) == sorted(f"run_{k}_x" for k in range(40))
