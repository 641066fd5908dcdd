"""Tail probabilities: regularised incomplete beta and gamma functions over whole columns of results."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, STEPS, TOLERANCE = 1e-300, 10_000, 1e-16

_log_gamma = np.frompyfunc(math.lgamma, 1, 1)


def log_gamma(x: np.ndarray) -> np.ndarray:
    return np.asarray(_log_gamma(np.asarray(x, float)), float)


def _fraction(first: np.ndarray, terms) -> np.ndarray:
    """b0 + a1 / (b1 + a2 / (b2 + ...)) by Lentz's method; terms(k) gives a_k and b_k. All places go on until each is done."""
    f = np.where(first == 0, TINY, first)
    c, d = f.copy(), np.zeros_like(f)
    for k in range(1, STEPS):
        a, b = terms(k)
        d = b + a * d
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + a / c
        c = np.where(np.abs(c) < TINY, TINY, c)
        f = f * c * d
        if not (np.abs(c * d - 1) > TOLERANCE * 4).any():
            break
    return f


def beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """I_x(a, b), the beta distribution's share below x, for a, b > 0; outside [0, 1] the nearer end."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)  # the fraction converges fast below the mean
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = (z > 0) & (z < 1)
    safe = np.where(inner, z, 0.5)

    def terms(k: int) -> tuple[np.ndarray, np.ndarray]:
        if k == 1:
            return np.ones_like(safe), np.ones_like(safe)
        m = (k - 1) // 2
        if k % 2 == 0:
            return -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1)), np.ones_like(safe)
        return m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), np.ones_like(safe)

    front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    share = np.where(inner, front * _fraction(np.zeros_like(safe), terms), np.where(z >= 1, 1.0, 0.0))
    return np.where(swap, 1 - share, share)


def gamma_tail(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Q(a, x), the gamma distribution's share above x, for a > 0: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    low = x < a + 1
    front = np.exp(a * np.log(np.where(x > 0, x, 1.0)) - x - log_gamma(a))
    term = 1 / a
    total = term.copy()
    for k in range(1, STEPS):
        term = term * np.where(low, x, 0.0) / (a + k)
        total = total + term
        if not (term > total * TOLERANCE).any():
            break
    far = np.where(low, a + 2, x)

    def terms(k: int) -> tuple[np.ndarray, np.ndarray]:
        return (np.ones_like(far) if k == 1 else -(k - 1) * (k - 1 - a)), far + 2 * k - 1 - a

    upper = front * _fraction(np.zeros_like(far), terms)
    return np.where(x <= 0, 1.0, np.where(low, 1 - front * total, upper))


def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    r, n = r.to_numpy(float), n.to_numpy(float)
    ok = np.isfinite(r) & (n > 2)
    # t^2 = (n - 2) r^2 / (1 - r^2), and the two tails of Student's t beyond it are I_{1 - r^2}((n - 2) / 2, 1 / 2).
    p = beta_share(np.where(ok, n - 2, 1.0) / 2, 0.5, 1 - np.where(ok, r, 0.0) ** 2)
    return pd.Series(np.where(ok, p, np.nan)).where(ok, None)


def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    x, dof = x.to_numpy(float), dof.to_numpy(float)
    ok = np.isfinite(x) & (dof > 0)
    return pd.Series(gamma_tail(np.where(ok, dof, 1.0) / 2, np.where(ok, x, 0.0) / 2)).where(ok, None)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by Student's t with n - 2 degrees; null where r is or n is 2 at most."""
    return F.pandas_udf(_correlation_p, "double")(r, n.cast("double"))


def chi2_p(statistic: Column, dof: Column) -> Column:
    """P(chi-square with dof degrees > statistic); null without a degree of freedom."""
    return F.pandas_udf(_chi2_p, "double")(statistic, dof.cast("double"))
