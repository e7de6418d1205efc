"""Trees refitted per origin against plain trees grown on copies of each history."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelspark.operators import boosting as B
from panelspark.operators import split as J

SPEC = J.SplitSpec(0.6, 0.3, 0.1, 3)
SMALL = B.Trees(lags=(1, 2, 7), month=True, rounds=6, depth=2, bins=16, patience=2)


def values():
    draw = np.random.default_rng(11)
    a = np.sin(np.arange(90) * 2 * np.pi / 7) * 5 + draw.normal(scale=0.5, size=90)
    b = draw.normal(size=60)  # nothing to learn
    return {"a": a, "b": b, "flat": np.full(50, 3.0)}


def to_parts(spark, panel):
    rows = pd.concat([pd.DataFrame({"series_id": k, "date": pd.date_range("2010-01-01", periods=len(v), freq="D"), "target": v}) for k, v in panel.items()])
    return J.chronological(spark.createDataFrame(rows).withColumn("date", F.to_date("date")), SPEC)


@pytest.fixture(scope="module")
def parts(spark):
    return to_parts(spark, values()).cache()


def plain_tree(rows, shape, node, level, out):
    """Rows are (features, residual); nested dicts, grown depth first."""
    n, g = len(rows), sum(r for _, r in rows)
    best = None
    if level < shape.depth:
        for f in range(shape.n_features):
            for b in range(shape.bins - 1):
                left = [r for x, r in rows if x[f] <= b]
                if min(len(left), n - len(left)) < shape.least:
                    continue
                gl = sum(left)
                gain = gl**2 / (len(left) + shape.ridge) + (g - gl) ** 2 / (n - len(left) + shape.ridge) - g**2 / (n + shape.ridge)
                if best is None or gain > best[0]:
                    best = (gain, f, b)
        if best is not None and best[0] <= 1e-9 * (1 + g**2 / (n + shape.ridge)):
            best = None
    if best is None:
        return {"value": shape.rate * g / (n + shape.ridge)}
    _, f, b = best
    sides = [[r for r in rows if r[0][f] <= b], [r for r in rows if r[0][f] > b]]
    return {"f": f, "b": b, "sides": [plain_tree(s, shape, 2 * node + 1 + i, level + 1, out) for i, s in enumerate(sides)]}


def read_tree(tree, x):
    while "f" in tree:
        tree = tree["sides"][int(x[tree["f"]] > tree["b"])]
    return tree["value"]


def plain_forecast(y, months, first, origin, shape, horizon):
    """Boosting on a copy of the rows before ``origin``; forecasts and the number of rounds kept."""
    known = y[:first]
    centre, spread = known.mean(), known.std() or 1.0
    ranked = np.sort(known)
    edges = sorted({ranked[max(math.ceil(i / shape.bins * first) - 1, 0)] for i in range(1, shape.bins)})

    def features(past, month):
        return [sum(e < past[-v] for e in edges) for v in shape.lags] + [month - 1]

    reach = max(shape.lags)
    x = {p: features(y[:p], months[p]) for p in range(reach, origin)}
    q = {p: int(np.rint((y[p] - centre) / spread * B.UNIT)) for p in x}
    m = origin - reach
    held = 0 if m < 7 else min(max(5, math.ceil(m * 0.2)), m - 1)
    fit, rest = [p for p in x if p < origin - held], [p for p in x if p >= origin - held]
    trees = [{"value": sum(q[p] for p in fit) / len(fit)}]

    def said(v, upto):
        return sum(read_tree(t, v) for t in trees[:upto])

    losses = []
    for _ in range(shape.rounds + 1):
        left = {p: q[p] - int(np.rint(said(x[p], len(trees)))) for p in x}
        losses.append(sum(int(np.rint(left[p] / B.COARSE)) ** 2 for p in rest))
        best = int(np.argmin(losses)) + 1
        if len(trees) - best >= shape.patience or len(trees) > shape.rounds:
            break
        trees.append(plain_tree([(x[p], left[p]) for p in fit], shape, 0, 0, None))
    best = int(np.argmin(losses)) + 1
    past, out = list(y[:origin]), []
    for p in range(origin, origin + horizon):
        past.append(centre + spread * said(features(past, months[p]), best) / B.UNIT)
        out.append(past[-1])
    return out, best - 1


def test_equal_to_plain_boosting_at_every_origin_and_block_size(spark, parts):
    found = B.boosted_forecast(parts, SPEC, SMALL).toPandas().sort_values(["series_id", "pos"])
    small = B.boosted_forecast(parts, SPEC, SMALL, block=13).toPandas().sort_values(["series_id", "pos"])
    assert found.yhat.tolist() == small.yhat.tolist()
    fits = B.tree_fits(B.fit_trees(parts, SPEC, SMALL), SMALL).toPandas().set_index(["series_id", "origin"])
    sizes = parts.select("series_id", "n_train").distinct().toPandas().set_index("series_id").n_train
    for series, y in values().items():
        months = pd.date_range("2010-01-01", periods=len(y), freq="D").month
        mine = found[found.series_id == series]
        for origin, rows in mine.groupby("origin"):
            want, rounds = plain_forecast(y, months, sizes[series], origin, SMALL, 3)
            assert fits.loc[(series, origin), "rounds"] == rounds
            np.testing.assert_allclose(rows.yhat, want, rtol=1e-9)
    assert not found.duplicated(["series_id", "pos"]).any()
    # noise stops early, the weekly wave is learned
    assert fits.loc["b"].rounds.max() < SMALL.rounds
    wave = found[found.series_id == "a"]
    assert (wave.y - wave.yhat).abs().mean() < 0.5 * (wave.y - wave.y.mean()).abs().mean()
    assert (found[found.series_id == "flat"].yhat == 3.0).all()


def test_rows_from_an_origin_on_change_nothing_before(spark, parts):
    before = B.boosted_forecast(parts, SPEC, SMALL).toPandas()
    origin = int(before[before.series_id == "a"].origin.max())
    changed = parts.withColumn("target", F.when((F.col("series_id") == "a") & (F.col("pos") >= origin), 1e6).otherwise(F.col("target")))
    after = B.boosted_forecast(changed, SPEC, SMALL).toPandas()
    both = before.merge(after, on=["series_id", "origin", "step"])
    assert len(both) == len(before) and (both.yhat_x == both.yhat_y).all()


def test_the_test_partition_is_fitted_on_validation_rows_too(spark, parts):
    first = parts.filter("split = 'test'").groupBy("series_id").agg(F.min("pos").alias("p"))
    changed = parts.join(first, "series_id").withColumn("target", F.when((F.col("split") == "validation") & (F.col("pos") < F.col("p") - 9), F.col("target") + 50).otherwise(F.col("target"))).drop("p")
    a, b = (B.boosted_forecast(p, SPEC, SMALL, "test").filter("series_id = 'a'").toPandas().sort_values("pos").yhat.to_numpy() for p in (parts, changed))
    assert len(a) and not np.allclose(a, b)


def test_forest_members_differ_and_missing_rows_are_defined(spark, parts):
    shape = B.forest(lags=(1, 2, 7), members=5, depth=3)
    holed = parts.withColumn("target", F.when((F.col("series_id") == "b") & (F.col("pos") == 10), F.lit(None)).otherwise(F.col("target")))
    models = B.fit_trees(holed, SPEC, shape)
    fits = B.tree_fits(models, shape).toPandas()
    assert fits.held_from.isna().all() and (fits.rounds == 1).all() and fits.groupby(["series_id", "origin"]).size().eq(5).all()
    found, again = (B.boosted_forecast(holed, SPEC, shape, block=b).toPandas().sort_values(["series_id", "pos"]) for b in (B.BLOCK_ROWS, 11))
    assert found.yhat.tolist() == again.yhat.tolist() and found.yhat.notna().all()
    row = models.filter("series_id = 'a'").first()
    value = np.frombuffer(row.value, np.float64).reshape(len(row.kept), -1, shape.n_nodes)
    assert not np.array_equal(value[0], value[1])
    wave = found[found.series_id == "a"]
    assert (wave.y - wave.yhat).abs().mean() < 0.5 * (wave.y - wave.y.mean()).abs().mean()


def test_no_rows_and_histories_without_lags(spark, parts):
    assert B.boosted_forecast(parts.filter("false"), SPEC, SMALL).count() == 0
    far = B.Trees(lags=(80,), rounds=2, patience=0)
    found = B.boosted_forecast(parts.filter("series_id = 'b'"), SPEC, far).toPandas()
    assert len(found) and found.yhat.isna().all()
