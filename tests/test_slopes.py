"""The median slope against all slopes, and inversions against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from cyclonet.operators import slopes
from cyclonet.operators import statistics as st


def listed(x, y):
    i, j = np.triu_indices(len(x), 1)
    i, j = i[x[i] != x[j]], j[x[i] != x[j]]
    s = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    return (s[(len(s) - 1) // 2] * 0.5 + s[len(s) // 2] * 0.5, len(s)) if len(s) else (np.nan, 0)


@pytest.mark.parametrize("n", [1, 2, 3, 8, 33, 64])
def test_inversions(n):
    r = np.random.default_rng(n).permutation(n)
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if r[i] > r[j]}
    assert slopes.inversions(r) == len(want)
    assert set(zip(*map(np.ndarray.tolist, slopes.inversions(r, listed=True)), strict=True)) == want


@pytest.mark.parametrize("candidates", [0.5, 4])
def test_median_slope(monkeypatch, candidates):
    monkeypatch.setattr(slopes, "CANDIDATES", candidates)
    rng = np.random.default_rng(7)
    for t in range(120):
        n = int(rng.integers(1, 90))
        x = [rng.normal(size=n) * 10.0 ** rng.integers(-6, 7), rng.integers(0, 15, n) * 1.0, np.arange(n) + 1.7e9][t % 3]
        y = [rng.normal(size=n), rng.integers(0, 4, n) * 1.0, np.full(n, 3.0)][rng.integers(0, 3)]
        got, want = slopes.median_slope(x, y), listed(x, y)
        assert got[1] == want[1] and np.isclose(got[0], want[0], rtol=1e-14, atol=1e-300, equal_nan=True)


def test_large_group_is_exact():
    rng = np.random.default_rng(1)
    x = rng.normal(size=3000)
    y = 2 * x + rng.standard_t(2, size=3000)
    assert slopes.median_slope(x, y) == listed(x, y)


def test_groups(spark):
    rows = [("a", float(i), float(i * i)) for i in range(30)] + [("a", None, 1.0), ("a", 3.0, float("nan")), ("b", 1.0, 2.0), ("b", 1.0, 5.0), ("c", None, None), (None, 0.0, 1.0), (None, 2.0, 5.0)]
    got = {r.g: (r.slope, r.pairs) for r in st.theil_sen(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    assert got == {"a": (29.0, 435), "b": (None, 0), "c": (None, 0), None: (2.0, 1)}
