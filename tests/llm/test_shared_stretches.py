"""What is said of a document's stretches comes in one row per document, and common prefixes don't depend on the order of their ranges."""

from __future__ import annotations

import random

import numpy as np

from panelspark.llm import suffixes


def test_one_row_per_document(spark):
    draw = random.Random(3)
    passages = [" ".join(draw.choice("abcdefgh") * 3 for _ in range(60)) for _ in range(6)]
    docs = spark.createDataFrame([(k, " ".join(draw.sample(passages, 4))) for k in range(30)], "doc_id long, text string")
    found = suffixes._shared(suffixes._anchors(docs, 8), 8).collect()
    assert len({r["doc"] for r in found}) == len(found) > 20
    assert all(len(r["keys"]) and len(r["keys"]) % 6 == 0 for r in found)


def test_smallest_of_ranges_in_any_order():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 60, 500).astype(np.uint8)
    low = draw.integers(0, 480, 200)
    high = low + draw.integers(1, 19, 200)
    assert suffixes._smallest(values, low, high).tolist() == [int(values[a:b].min()) + 1 for a, b in zip(low, high)]
