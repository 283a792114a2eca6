"""Quantiles of beta and beta-binomial distributions, over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Terms of the continued fraction, and steps of the inversion, at most.
TERMS, STEPS = 2000, 200
_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _log_gamma(a) + _log_gamma(b) - _log_gamma(a + b)


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised: the chance of a value up to x. By the continued fraction, from the side on which it is short."""
    x, a, b = (np.atleast_1d(np.asarray(v, float)) for v in np.broadcast_arrays(x, a, b))
    turn = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turn, 1 - x, x), np.where(turn, b, a), np.where(turn, a, b)
    with np.errstate(divide="ignore"):
        front = np.where(x > 0, np.exp(a * np.log(x) + b * np.log1p(-x) - log_beta(a, b)) / a, 0.0)
    tiny = 1e-300
    # Numerators d1, d2, ... of 1 / (1 + d1 / (1 + d2 / ...)), by quotients of neighbouring convergents.
    up, down = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    down = 1 / np.where(np.abs(down) < tiny, tiny, down)
    value = down.copy()
    for m in range(1, TERMS):
        change = np.ones_like(x)
        for d in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            down, up = 1 + d * down, 1 + d / up
            down, up = 1 / np.where(np.abs(down) < tiny, tiny, down), np.where(np.abs(up) < tiny, tiny, up)
            change = change * down * up
        value = value * change
        if (np.abs(change - 1) < 1e-15).all():
            break
    out = front * value
    return np.where(turn, 1 - out, out)


def beta_quantile(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x at which the chance is p: Newton steps inside a bracket that halves where a step leaves it. NaN unless
    0 <= p <= 1 and both parameters are positive."""
    p, a, b = (np.array(np.atleast_1d(v), float) for v in np.broadcast_arrays(p, a, b))
    good = (p >= 0) & (p <= 1) & (a > 0) & (b > 0)
    q, s, t = np.where(good, p, 0.5), np.where(good, a, 1.0), np.where(good, b, 1.0)
    low, high, x, norm = np.zeros_like(q), np.ones_like(q), s / (s + t), log_beta(s, t)
    for _ in range(STEPS):
        off = incomplete_beta(x, s, t) - q
        low, high = np.where(off < 0, x, low), np.where(off > 0, x, high)
        with np.errstate(all="ignore"):
            step = x - off / np.exp((s - 1) * np.log(x) + (t - 1) * np.log1p(-x) - norm)
        inside = (step > low) & (step < high)
        new = np.where(off == 0, x, np.where(inside, step, (low + high) / 2))
        if (np.abs(new - x) <= 1e-16 + 1e-15 * x).all():
            break
        x = new
    x = np.where(q == 0, 0.0, np.where(q == 1, 1.0, x))
    return np.where(good, x, np.nan)


def beta_binomial_quantile(p: float, n: int, a: float, b: float) -> int:
    """Smallest number of events in n rows whose chance of at most so many is p or more."""
    k = np.arange(n + 1)
    log = math.lgamma(n + 1) - _log_gamma(k + 1.0) - _log_gamma(n - k + 1.0) + log_beta(k + a, n - k + b) - log_beta(np.array(a), np.array(b))
    return int(min(n, np.searchsorted(np.cumsum(np.exp(log)), p)))


@F.pandas_udf(DoubleType())
def beta_ppf(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(beta_quantile(p.to_numpy(float), a.to_numpy(float), b.to_numpy(float))) if len(p) else pd.Series([], dtype=float)


@F.pandas_udf(LongType())
def beta_binomial_ppf(p: pd.Series, n: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([beta_binomial_quantile(*x) for x in zip(p, n, a, b, strict=True)], dtype="int64")
