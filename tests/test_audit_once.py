"""The audit of exact copies makes the facts once."""

import datetime

from panelspark.operators import documents as C


def test_facts_are_made_once(spark):
    day = datetime.date(2024, 1, 1)
    rows = [("a", 1, day, "x rose; y fell"), ("a", 2, day, "X rose | z held; z held"), ("b", 3, day, "x rose"), ("b", 4, day, ";")]
    docs = spark.createDataFrame(rows, "series_id string, doc_id long, date date, facts string")
    audit = C.compression_audit(docs)
    assert audit._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1
    found = {r["series_id"]: r for r in audit.collect()}
    assert [found["a"][c] for c in ("documents_input", "documents_with_evidence", "facts_input", "unique_facts", "exact_duplicates_removed", "near_duplicates_removed")] == [2, 2, 5, 3, 2, 0]
    assert [found["b"][c] for c in ("documents_input", "documents_with_evidence", "facts_input", "unique_facts", "exact_duplicates_removed", "near_duplicates_removed")] == [2, 1, 1, 1, 0, 0]
