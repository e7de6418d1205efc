"""Order statistics of prefixes against NumPy, with tiles far smaller than the series."""

import numpy as np
import pandas as pd
import pytest

from panelspark.operators import prefix as X


def test_wavelet():
    draw = np.random.default_rng(0)
    for m in (1, 2, 7, 64, 100):
        line = draw.permutation(m)
        held = X.Wavelet(line)
        places = draw.integers(1, m + 1, 50)
        k = np.array([draw.integers(0, p) for p in places])
        assert held.smallest(places, k).tolist() == [int(np.sort(line[:p])[j]) for p, j in zip(places, k)]


@pytest.fixture(scope="module")
def panel():
    draw = np.random.default_rng(1)
    return {
        "long": draw.normal(size=130), "ties": draw.integers(0, 3, 90).astype(float), "same": np.full(40, 2.5), "short": np.array([3.0, 1.0]), "one": np.array([7.0]), "up": np.arange(64.0) ** 2,
    }


@pytest.mark.parametrize("tile", [16, 1 << 16])
def test_medians_of_prefixes(spark, panel, tile):
    rows = pd.concat([pd.DataFrame({"series_id": k, "pos": np.arange(len(v)), "target": v}) for k, v in panel.items()])
    held = X.Prefixes(spark.createDataFrame(rows).repartition(5), tile=tile)
    wanted = [(k, n) for k, v in panel.items() for n in {1, 2, 3, 16, 17, 31, 32, 33, 40, 63, 64, 89, 90, 129, 130} if n <= len(v)]
    got = {(r.series_id, r.n): (r.center, r.mad) for r in held.medians(spark.createDataFrame(wanted, "series_id string, n bigint")).collect()}
    assert set(got) == set(wanted)
    for (k, n), (center, mad) in got.items():
        v = panel[k][:n]
        assert center == np.median(v) and mad == pytest.approx(np.median(np.abs(v - np.median(v))), abs=1e-15), (k, n)
