"""What a toxicity score means doesn't depend on how many labelled documents the fit leaves out."""

from __future__ import annotations

import random

import numpy as np
import pytest

from panelspark.llm import toxicity


def test_caps_leave_the_threshold(spark, monkeypatch):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for k in range(3000):
        said = [draw.choice(words) for _ in range(draw.randrange(5, 30))]
        if rude := draw.random() < 0.2:
            said[draw.randrange(len(said))] = "moron"
        rows.append((k, " ".join(said)))
        marks.append((k, int(rude and draw.random() < 0.35)))  # most rude documents aren't labelled toxic
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    share = np.mean([t for _, t in marks])
    means, predicted = [], []
    for most in (2500, 150):
        monkeypatch.setattr(toxicity, "FIT_TOXIC", most)
        monkeypatch.setattr(toxicity, "FIT_CLEAN", most)
        found = toxicity.toxicity_scores(docs, labels).toPandas()
        means.append(found["score"].mean())
        predicted.append(found["predicted"].mean())
    assert means == pytest.approx([share, share], abs=0.04)
    assert abs(predicted[0] - predicted[1]) < 0.03


def test_calibration_counts_rows_by_weight():
    draw = np.random.default_rng(6)
    x = draw.standard_normal(400)
    y = (draw.random(400) < 1 / (1 + np.exp(2 - 2 * x))).astype(float)
    whole = toxicity.calibrated(np.concatenate((x, np.repeat(x[y == 0], 6))), np.concatenate((y, np.zeros(6 * int((y == 0).sum())))), np.ones(400 + 6 * int((y == 0).sum())))
    assert toxicity.calibrated(x, y, np.where(y > 0, 1.0, 7.0)) == pytest.approx(whole, abs=1e-6)


def test_half_a_window_lies_whole_in_one():
    size, half = 500, toxicity.WINDOW // 2
    first, owner = toxicity.windows_of(np.repeat([0, 1], [size, 30]), 2)
    first = first[owner == 0]
    assert all(((first <= at) & (at + half <= first + toxicity.WINDOW)).any() for at in range(size - half + 1))
