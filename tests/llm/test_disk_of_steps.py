"""Strings travel only where bytes beyond the anchor agree, and a written table leaves no shuffle files behind."""

from __future__ import annotations

import random
import time

import numpy as np

from panelspark.llm import storage, suffixes
from panelspark.llm.blocks import unsix


def _said(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = suffixes._shared(suffixes._anchors(docs, 4), 4).collect()
    return {r["doc"]: unsix(r["keys"]) & np.uint64(3) for r in found}


def _made(draw, n):
    return "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))


def test_shared_anchors_alone_are_not_sent(spark):
    draw = random.Random(5)
    common = [_made(draw, suffixes.ANCHOR) for _ in range(200)]
    # every document has the same short strings, but between other bytes
    texts = ["".join(_made(draw, 60) + c for c in common) for _ in range(6)]
    assert _said(spark, texts) == {}


def test_shared_windows_are_sent(spark):
    draw = random.Random(6)
    common = [_made(draw, suffixes.SPAN) for _ in range(40)]
    texts = ["".join(_made(draw, 60) + c for c in common) for _ in range(2)]
    said = _said(spark, texts)
    # all 40 windows are found, each by a stretch that other bytes follow
    assert all(int((said[k] == suffixes.SENT).sum()) >= 38 for k in (0, 1))
    rows = suffixes.repeated_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed"] >= 40 * suffixes.SPAN for r in rows} == {0: False, 1: True}


def test_written_leaves_no_shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        every = files.getAllFiles()
        return {n for n in (every.apply(k).getName() for k in range(every.size())) if n.startswith("shuffle_")}

    before = held()
    out = storage.written(spark.range(5000).selectExpr("id % 7 AS k", "id").repartition(5, "k"))
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert out.count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
