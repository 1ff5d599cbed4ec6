"""Upper tail probabilities, Arrow-batched, applied to one row per tested group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_tail(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(X > x) for whole-number degrees of freedom, by the finite series."""
    out = np.full(len(x), np.nan)
    for k in np.unique(df[~np.isnan(df)]).astype(int):
        rows = (df == k) & ~np.isnan(x)
        half = np.maximum(x[rows], 0.0) / 2.0
        if k % 2 == 0:
            base, start, steps = np.exp(-half), 0.0, k // 2
        else:
            base = np.array([math.erfc(math.sqrt(h)) for h in half])
            start, steps = 0.5, (k - 1) // 2
        total = base if k % 2 else np.zeros_like(half)
        for step in range(steps):
            power = start + step
            total = total + np.exp(-half) * half**power / math.gamma(power + 1.0)
        out[rows] = np.minimum(total, 1.0)
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz).

    It needs some multiple of the root of the larger parameter steps; one that has not settled by
    then raises.
    """
    tiny = 1e-300
    most = 400 + int(10 * math.sqrt(max(a.max(initial=0), b.max(initial=0))))
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, most):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            change = c * d
            value = value * change
        if np.all(np.abs(change - 1.0) < 1e-14):
            return value
    if len(x):
        raise ArithmeticError("the continued fraction of a tail probability did not settle")
    return value


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the beta function; for large parameters without the difference of huge logarithms."""
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    small, large = np.minimum(a, b), np.maximum(a, b)
    plain = log_gamma(large + small) - log_gamma(large)
    series = small * np.log(large) + small * (small - 1.0) / (2.0 * large)
    return log_gamma(small) - np.where((large > 1e6) & (small < 1e2), series, plain)


def beta_cdf(
    a: np.ndarray, b: np.ndarray, x: np.ndarray, rest: np.ndarray | None = None
) -> np.ndarray:
    """Regularised incomplete beta function; `rest` is 1 - x where that is known more exactly."""
    rest = 1.0 - x if rest is None else rest
    value = np.where(x <= 0.0, 0.0, 1.0)
    inside = (x > 0.0) & (rest > 0.0)
    a, b, x, rest = (v[inside] for v in (a, b, x, rest))
    log_x = np.where(x < 0.5, np.log(x), np.log1p(-rest))
    log_rest = np.where(rest < 0.5, np.log(rest), np.log1p(-x))
    front = np.exp(a * log_x + b * log_rest - _log_beta(a, b))
    # each point goes to the fraction that settles there
    low = x < (a + 1.0) / (a + b + 2.0)
    found = np.empty_like(x)
    found[low] = front[low] * _beta_fraction(a[low], b[low], x[low]) / a[low]
    found[~low] = 1.0 - front[~low] * _beta_fraction(b[~low], a[~low], rest[~low]) / b[~low]
    value[inside] = found
    return value


def t_two_sided(rho: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of a correlation over n pairs, n - 2 degrees of freedom."""
    out = np.full(len(rho), np.nan)
    rows = ~np.isnan(rho) & (n > 2)
    r, free = np.clip(np.abs(rho[rows]), 0.0, 1.0), n[rows] - 2.0
    if len(r):
        out[rows] = beta_cdf(free / 2.0, np.full_like(free, 0.5), 1.0 - r * r, r * r)
    return out


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype(object).where(~np.isnan(values), None)


@F.pandas_udf(DoubleType())
def chi2_tail_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(chi2_tail(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_two_sided_udf(rho: pd.Series, n: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(rho.to_numpy(float), n.to_numpy(float)))
