"""The toxicity network is fitted in a task: neither texts nor the fit take the driver's memory."""

from __future__ import annotations

from pyspark import TaskContext

from panelspark.llm import toxicity


def test_fit_leaves_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "you moron go away" if k % 3 == 0 else "a calm remark on rain") for k in range(120)] + [(500, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(120)], "doc_id long, toxic int")

    fit = toxicity.fit

    def in_a_task(*args):
        assert TaskContext.get() is not None, "fitted in the driver"
        return fit(*args)

    monkeypatch.setattr(toxicity, "fit", in_a_task)
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert len(found) == 121
    assert all(found[k]["predicted"] == int(k % 3 == 0) for k in range(120))
    assert found[500]["score"] == 0
