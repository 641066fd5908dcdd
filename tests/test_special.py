"""Tail probabilities against numerical integration, closed forms and the edges."""

from __future__ import annotations

import math

import numpy as np
import pytest

from cyclonet.functions import special
from cyclonet.operators import statistics as st


def quadrature(f, a, b, n=400_000):
    """Gauss-Legendre in pieces."""
    x, w = np.polynomial.legendre.leggauss(64)
    edges = np.linspace(a, b, n // 64)
    half = (edges[1:] - edges[:-1]) / 2
    points = (edges[1:] + edges[:-1])[:, None] / 2 + half[:, None] * x
    return float((f(points) * w * half[:, None]).sum())


@pytest.mark.parametrize("a,b,x", [(1.0, 1.0, 0.3), (2.5, 3.5, 0.2), (14.0, 1.5, 0.9), (40.0, 60.0, 0.41), (3.0, 20.0, 0.5), (500.0, 2.0, 0.99)])
def test_beta_by_integration(a, b, x):
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    want = quadrature(lambda t: front * t ** (a - 1) * (1 - t) ** (b - 1), 0, x)
    assert special.beta_share(a, b, x) == pytest.approx(want, abs=1e-9)
    assert special.beta_share(b, a, 1 - x) == pytest.approx(1 - want, abs=1e-9)


@pytest.mark.parametrize("dof", [1, 2, 3, 7, 28, 101, 5000])
def test_student_tails_by_integration(dof):
    front = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(dof * math.pi)
    for t in (0.1, 1.0, 2.5, 4.0):
        inside = quadrature(lambda u: front * (1 + u * u / dof) ** (-(dof + 1) / 2), 0, t)
        assert special.beta_share(dof / 2, 0.5, dof / (dof + t * t)) == pytest.approx(1 - 2 * inside, abs=1e-9)


@pytest.mark.parametrize("a,x", [(1.0, 2.0), (2.0, 0.5), (2.0, 9.0), (7.5, 7.0), (50.0, 70.0), (50.0, 30.0), (400.0, 401.5)])
def test_gamma_by_integration(a, x):
    below = quadrature(lambda t: np.exp((a - 1) * np.log(np.maximum(t, 1e-300)) - t - math.lgamma(a)), 0, x)
    assert special.gamma_tail(a, x) == pytest.approx(1 - below, abs=1e-9)


def test_edges_and_small_tails():
    assert special.beta_share([2.0, 2.0], 0.5, [0.0, 1.0]).tolist() == [0.0, 1.0]
    assert special.gamma_tail([3.0], [0.0]).tolist() == [1.0]
    assert special.gamma_tail(1.0, 700.0) == pytest.approx(math.exp(-700), rel=1e-9)
    assert special.beta_share(14.0, 0.5, 1e-12) == pytest.approx(1e-168 * math.exp(math.lgamma(14.5) - math.lgamma(14) - math.lgamma(0.5)) / 14, rel=1e-9)


def test_p_of_correlations(spark):
    rows = [("a", 5, 0.9), ("b", 2, 0.5), ("c", 30, None), ("d", 30, 1.0), ("e", 30, -0.3), ("f", 4, 0.0)]
    got = {r["k"]: r["p"] for r in st.with_p(spark.createDataFrame(rows, "k string, n long, rho double")).collect()}
    assert got["b"] is None and got["c"] is None and got["d"] == 0.0 and got["f"] == pytest.approx(1.0)
    assert got["a"] == pytest.approx(0.0373860734, abs=1e-9)  # t = 3.576, 3 degrees
    assert 0.1 < got["e"] < 0.11


def test_p_of_tables(spark):
    flat = spark.createDataFrame([(a, b) for a in "xy" for b in "pqr" for _ in range(20)], "a string, b string")
    assert [tuple(r) for r in st.chi2(flat, "a", "b").select("dof", "p").collect()] == [(2, 1.0)]
    (r,) = st.chi2(spark.createDataFrame([("x", "p")] * 12 + [("y", "q")] * 9 + [("x", "q")] * 5, "a string, b string"), "a", "b").collect()
    assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["chi2"] / 2)), abs=1e-12)
    (r,) = st.chi2(flat.filter("a = 'x'"), "a", "b").collect()
    assert r["dof"] == 0 and r["p"] is None
