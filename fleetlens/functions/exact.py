"""Exact intervals for rates, as vectorised functions over aggregated counts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

BOUNDS = StructType().add("lower", DoubleType()).add("upper", DoubleType())


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, taken until it stands: about as many terms as the
    root of the larger count."""
    swap = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(np.maximum(x, tiny)) + b * np.log1p(-np.minimum(x, 1 - 1e-16))) / a
    c, d = np.ones_like(x), 1 / np.where(np.abs(1 - (a + b) * x / (a + 1)) < tiny, tiny, 1 - (a + b) * x / (a + 1))
    value = d.copy()
    for m in range(1, 300 + 20 * math.isqrt(int(np.nan_to_num(np.maximum(a, b)).max(initial=0)))):
        last = value.copy()
        for part in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + part * d) < tiny, tiny, 1 + part * d)
            c = np.where(np.abs(1 + part / c) < tiny, tiny, 1 + part / c)
            value *= d * c
        if np.all(np.abs(value - last) <= 1e-16 * np.abs(last)):
            break
    share = front * value
    return np.where(swap, 1 - share, share)


#: Terms of a sum that are taken at once.
BLOCK = 64


def poisson_tail(mean: np.ndarray, k: np.ndarray) -> np.ndarray:
    """P(X <= k) for Poisson counts: from k down where the mean is larger, else from k + 1 up and taken from 1.

    Terms shrink from the first on and are added until they no longer count: about ten times the root of k of them.
    """
    down, step = mean > k, np.arange(BLOCK)
    at, safe = np.maximum(np.where(down, k, k + 1), 0), np.maximum(mean, 1e-300)
    gamma = np.vectorize(math.lgamma, otypes=[float])
    term = np.where(down & (k < 0), 0.0, np.exp(at * np.log(safe) - mean - gamma(at + 1)))
    total = term.copy()
    while np.any(term > 1e-17 * total):
        here = at[:, None] + np.where(down[:, None], -step, step)
        ratio = np.where(down[:, None], np.maximum(here, 0) / safe[:, None], safe[:, None] / (np.maximum(here, 0) + 1))
        block = term[:, None] * np.cumprod(ratio, axis=1)
        total, term, at = total + block.sum(axis=1), block[:, -1], at + np.where(down, -BLOCK, BLOCK)
    return np.clip(np.where(down, total, 1 - total), 0.0, 1.0)


def _solve(rises, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Where a rising condition becomes true, by bisection."""
    for _ in range(70):
        mid = (low + high) / 2
        up = rises(mid)
        low, high = np.where(up, low, mid), np.where(up, mid, high)
    return (low + high) / 2


@F.pandas_udf(BOUNDS)
def clopper_pearson(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
    """95 % interval of a share; null without trials."""
    k, n = successes.to_numpy(float), trials.to_numpy(float)
    zero, one = np.zeros_like(k), np.ones_like(k)
    safe = np.maximum(n, 1)
    low = _solve(lambda p: beta_share(p, np.maximum(k, 1e-9), safe - k + 1) >= 0.025, zero, one)
    high = _solve(lambda p: beta_share(p, k + 1, np.maximum(safe - k, 1e-9)) >= 0.975, zero, one)
    low, high = np.where(k <= 0, 0.0, low), np.where(k >= n, 1.0, high)
    return pd.DataFrame({"lower": np.where(n > 0, low, np.nan), "upper": np.where(n > 0, high, np.nan)})


@F.pandas_udf(BOUNDS)
def poisson_interval(count: pd.Series, exposure: pd.Series) -> pd.DataFrame:
    """95 % interval of a rate per unit of exposure; null without exposure."""
    k, t = count.to_numpy(float), exposure.to_numpy(float)
    top = k + 10 * np.sqrt(k + 1) + 20
    low = np.where(k > 0, _solve(lambda m: 1 - poisson_tail(m, k - 1) >= 0.025, np.zeros_like(k), top), 0.0)
    high = _solve(lambda m: poisson_tail(m, k) <= 0.025, np.zeros_like(k), top)
    with np.errstate(divide="ignore", invalid="ignore"):
        return pd.DataFrame({"lower": np.where(t > 0, low / t, np.nan), "upper": np.where(t > 0, high / t, np.nan)})
