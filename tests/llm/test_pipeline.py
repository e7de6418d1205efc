"""The pipeline's stages on small tables: what goes, what stays, and columns that are left alone."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    passage = " ".join(f"bench{i}" for i in range(15))
    shared = " ".join(f"long{i}" for i in range(20))
    rows = [(k, f"doc {k} " + " ".join(f"t{k}x{i}" for i in range(30)), "en", "s", 1) for k in range(40)]
    rows += [(100, rows[3][1], "en", "s", 1), (101, rows[4][1] + " tail", "en", "s", 1), (102, "before " + passage + " after", "en", "s", 1), (103, shared + " first", None, "s", 1), (104, "second " + shared, "en", None, None), (105, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    near = kept["near_duplicates"](spark, docs, folder)
    assert near.columns == docs.columns
    gone = {d for d, _, group in brute.jaccard_groups([(r.doc_id, r.text) for r in docs.collect()]) if d != group}
    assert gone == {100, 101, 104} and {r.doc_id for r in docs.collect()} - {r.doc_id for r in near.collect()} == gone
    cut = kept["repeated_spans"](spark, docs, folder)
    assert cut.columns == docs.columns
    got = {r.doc_id: r for r in cut.collect()}
    assert 100 not in got and got[105].text is None
    removed = {r[0]: r[2] for r in brute.repeated_spans([(r.doc_id, r.text) for r in docs.collect()])}
    assert all(len(got[d].text.encode()) == len(r.text.encode()) - removed[d] for d, r in ((r.doc_id, r) for r in docs.collect()) if d in got and r.text)
    clean = kept["decontamination"](spark, docs, folder)
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in clean.collect()} == {102}
    assert kept["toxicity"](spark, docs, folder).count() == docs.count()


def test_texts_are_dealt_once_where_more_columns_go_along(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(held, ("false", "-1")):
            spark.conf.set(k, v)
        plan = corpus_pipeline.cut_repeats(spark, docs, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in plan


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert {r.doc_id for r in out.collect()} == {*range(40), 103, 105}


ODD = "doc_id long, text string, _gone int, _kept string, _row long, _id long, d string, g string, row_hash long, rest string, doc string, c0 int, no_text int, span_doc int"


def _odd(spark, rows):
    return spark.createDataFrame([(d, t, 1, "k", 2, 3, "d", "g", 4, "r", "x", 5, 6, 7) for d, t in rows], ODD)


def test_rows_without_id_repeated_rows_and_clashing_names(spark, folder):
    passage = "so " + " ".join(f"bench{i}" for i in range(15))
    clean = " ".join(f"clean{i}" for i in range(12))
    rows = [(None, passage), (None, clean), (1, passage), (1, clean + " again"), (2, clean + " more"), (2, clean + " more"), (3, None), (None, None), (4, "")]
    docs = _odd(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=key)
    got = stages["decontamination"](spark, docs, folder)
    assert got.columns == docs.columns and texts(got) == sorted((r for r in rows if r[1] != passage), key=key)
    near = stages["near_duplicates"](spark, docs, folder)
    assert near.columns == docs.columns and texts(near) == sorted((r for r in rows if r[0] != 2), key=key)
    cut = stages["repeated_spans"](spark, docs, folder)
    assert cut.columns == docs.columns and {(r._gone, r.c0, r.no_text, r.rest) for r in cut.collect()} == {(1, 5, 6, "r")}
    plain = [(d, n - k) for d, n, k, *_ in brute.repeated_spans(rows)]
    left = [(d, len((t or "").encode())) for d, t in texts(cut)]
    order = lambda x: sorted(x, key=lambda r: (r[0] is not None, r))
    assert order(left) == order((d, n) for (d, n), (_, t) in zip(plain, rows) if n or not t)
    toxic = stages["toxicity"](spark, docs, folder)
    assert toxic.columns == docs.columns and toxic.count() == len(rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_toxic_rows_go_by_their_own_text(spark, tmp_path):
    rows = [(k, ("vile scum " if k % 3 == 0 else "kind words ") * 6 + f"t{k}") for k in range(300)]
    labels = [(k, int(k % 3 == 0)) for k in range(300)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = [(None, "vile scum " * 6), (None, "kind words " * 6), (1000, "vile scum " * 6), (1000, "kind words " * 6), (1001, "kind words " * 6), (1001, "kind words " * 6)]
    got = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows + odd, "doc_id long, text string"), str(tmp_path))
    kept = [(r.doc_id, r.text) for r in got.filter("doc_id is null or doc_id >= 1000").collect()]
    assert sorted(kept, key=str) == sorted((r for r in odd if "vile" not in r[1]), key=str)
