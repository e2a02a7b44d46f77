"""Tail probabilities for the trend statistics, one value per series.

The kernels work on whole Arrow batches; a series never holds more points than
there are periods, so the arrays handed over are short.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TINY = 1e-300


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz's scheme)."""
    guard = lambda v: np.where(np.abs(v) < TINY, TINY, v)
    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


_lgamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0.0, 1.0)
    inside = (x > 0) & (x < 1)
    safe = np.where(inside, x, 0.5)
    front = np.exp(
        _lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(safe) + b * np.log1p(-safe)
    )
    low = safe < (a + 1.0) / (a + b + 2.0)
    value = np.where(
        low,
        front * _beta_fraction(a, b, safe) / a,
        1.0 - front * _beta_fraction(b, a, 1.0 - safe) / b,
    )
    return np.where(inside, value, np.where(x <= 0, 0.0, 1.0))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) with df degrees of freedom."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    x = np.where(np.isinf(t), 0.0, df / (df + np.where(np.isinf(t), 0.0, t) ** 2))
    return incomplete_beta(df / 2.0, np.full_like(df, 0.5), x)


@F.pandas_udf(DoubleType())
def p_slope(r2: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a least-squares slope from r squared and the number of points."""
    out = np.full(len(r2), np.nan)
    ok = r2.notna().to_numpy() & (n.to_numpy() >= 3)
    if ok.any():
        r = np.minimum(r2.to_numpy(float)[ok], 1.0)
        df = n.to_numpy(float)[ok] - 2.0
        # df / (df + t^2) simplifies to 1 - r^2
        out[ok] = incomplete_beta(df / 2.0, np.full_like(df, 0.5), 1.0 - r)
    return pd.Series(out).astype("Float64").mask(np.isnan(out))


def kendall_exact(n: int, discordant: int) -> float:
    """Two-sided exact p without ties: distribution of inversions of n items."""
    total = n * (n - 1) // 2
    c = min(discordant, total - discordant)
    if 2 * c == total:
        return 1.0
    prob = np.zeros(c + 1)
    prob[0] = 1.0
    for size in range(2, n + 1):
        # adding one item adds 0 .. size-1 inversions, each equally likely
        acc = np.concatenate([[0.0], np.cumsum(prob)])
        k = np.arange(c + 1)
        prob = (acc[k + 1] - acc[np.maximum(k + 1 - size, 0)]) / size
    return float(min(1.0, 2.0 * prob.sum()))


def kendall_normal(score: float, n: int, x_ties: np.ndarray, y_ties: np.ndarray) -> float:
    """Two-sided p from the tie-corrected normal approximation."""
    sums = lambda t: [
        float((t * (t - 1)).sum()) / 2, float((t * (t - 1) * (t - 2)).sum()), float((t * (t - 1) * (2 * t + 5)).sum())]
    return kendall_p_of_sums(score, n, sums(x_ties), sums(y_ties))


def kendall_p_of_sums(score: float, n: int, x: Sequence[float], y: Sequence[float]) -> float:
    """The same from sums over the sizes t of ties of either side: t(t-1)/2, t(t-1)(t-2), t(t-1)(2t+5)."""
    m = n * (n - 1.0)
    if not m:
        return math.nan
    var = (m * (2 * n + 5) - x[2] - y[2]) / 18 + 2 * x[0] * y[0] / m
    if n > 2:
        var += x[1] * y[1] / (9 * m * (n - 2))
    if var <= 0:
        return math.nan
    return math.erfc(abs(score) / math.sqrt(var) / math.sqrt(2))
