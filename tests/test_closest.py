"""Nearest rows: only those that rounding can't tell apart from the k-th are compared by differences."""

import numpy as np

from panelspark.operators import forecast


def test_few_rows_are_compared_by_differences(monkeypatch):
    draw = np.random.default_rng(5)
    rows, queries, ids = draw.standard_normal((3000, 16)) + 1e3, draw.standard_normal((20, 16)) + 1e3, draw.permutation(3000)
    rows[::50] = rows[0]  # ties, by id
    exact, seen = forecast._distances, []
    monkeypatch.setattr(forecast, "_distances", lambda a, b, p: seen.append(len(b)) or exact(a, b, p))
    for query in [*queries, rows[0]]:
        d = exact(query[None, :], rows, 2)[0]
        want = np.lexsort((ids, d))[:5]
        place, found = forecast._closest(query, rows, ids, 5, 2)
        assert place.tolist() == want.tolist() and found.tolist() == d[want].tolist()
    assert max(seen) < 100
