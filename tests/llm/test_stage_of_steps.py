"""The pipeline's stage repeated_spans writes what becomes of the stretches before it deals texts and strings."""

from __future__ import annotations

import random

import corpus_pipeline
from panelspark.llm import suffixes


def test_cut_repeats_writes_its_steps(spark, monkeypatch):
    draw = random.Random(7)
    passage = " ".join(draw.choice(["price", "supply", "energy", "output", "region", "growth"]) + str(draw.randint(0, 99)) for _ in range(30))
    made = lambda n: "".join(draw.choice("abcdefghijklmnop ") for _ in range(n))
    texts = [made(90) + passage + made(90) for _ in range(4)]
    steps = []
    write = suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df: steps.append(df.columns) or write(df))
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, texts[0], "y"), (9, None, "z")], "doc_id long, text string, source string")
    out = {(r["doc_id"], r["source"]): r["text"] for r in corpus_pipeline.cut_repeats(spark, docs, "").collect()}
    assert steps == [["doc", "keys"]]
    assert out[0, "x"] == out[None, "y"] == texts[0] and out[9, "z"] is None
    # what is equal to a longer stretch by chance may go along, never less than the passage
    assert all(passage not in out[k, "x"] and len(out[k, "x"]) <= 180 and out[k, "x"].startswith(texts[k][:60]) for k in (1, 2, 3))
