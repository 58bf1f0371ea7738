"""Tail probabilities as Arrow pandas UDFs. They run on grouped (small) rows, never on raw rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVAL = T.StructType([T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())])

_lgamma_each = np.frompyfunc(math.lgamma, 1, 1)


def _lgamma(values) -> np.ndarray:
    return np.asarray(_lgamma_each(values), dtype=float)


def beta_cdf(a, b, x) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b), vectorised (modified Lentz continued fraction)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    inside = (z > 0.0) & (z < 1.0)
    safe = np.where(inside, z, 0.5)
    log_front = (
        _lgamma(p + q)
        - _lgamma(p)
        - _lgamma(q)
        + p * np.log(safe)
        + q * np.log1p(-safe)
    )
    tiny = 1e-300
    c = np.ones_like(p)
    d = 1.0 - (p + q) * safe / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for step in (
            m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    value = np.exp(log_front) * h / p
    value = np.where(z <= 0.0, 0.0, np.where(z >= 1.0, 1.0, value))
    return np.where(flip, 1.0 - value, value)


def _solve(a, b, level) -> np.ndarray:
    """x with I_x(a, b) = level, by bisection."""
    low, high = np.zeros_like(a), np.ones_like(a)
    for _ in range(60):
        mid = (low + high) / 2
        below = beta_cdf(a, b, mid) < level
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


def exact_interval(events: np.ndarray, trials: np.ndarray, alpha: float = 0.05):
    x, n = np.asarray(events, float), np.asarray(trials, float)
    lower = np.where(x <= 0, 0.0, _solve(np.maximum(x, 0.5), n - x + 1, alpha / 2))
    upper = np.where(x >= n, 1.0, _solve(x + 1, np.maximum(n - x, 0.5), 1 - alpha / 2))
    return lower, upper


@F.pandas_udf(INTERVAL)
def clopper_pearson(events: pd.Series, trials: pd.Series) -> pd.DataFrame:
    lower, upper = exact_interval(events.to_numpy(), trials.to_numpy())
    return pd.DataFrame({"lower": lower, "upper": upper})


@F.pandas_udf(T.DoubleType())
def binomial_tail(events: pd.Series, trials: pd.Series, p: pd.Series) -> pd.Series:
    """P(Binomial(trials, p) >= events)."""
    x, n = events.to_numpy(dtype=float), trials.to_numpy(dtype=float)
    value = beta_cdf(np.maximum(x, 0.5), np.maximum(n - x + 1, 0.5), p.to_numpy(dtype=float))
    return pd.Series(np.where(x <= 0, 1.0, np.where(x > n, 0.0, value)))


def two_sided(events: int, trials: int, p: float) -> float:
    """Exact two-sided binomial p-value: the chance of all counts that are no likelier than ``events``.

    The chances fall on both sides of the mode, so the far tail starts where a bisection finds it.
    """
    def weight(k):
        return math.lgamma(trials + 1) - math.lgamma(k + 1) - math.lgamma(trials - k + 1) + k * math.log(p) + (trials - k) * math.log1p(-p)

    def upper(k):
        return 1.0 if k <= 0 else 0.0 if k > trials else float(beta_cdf(k, trials - k + 1, p))

    limit, mode = weight(events) + 1e-7, min(trials, int((trials + 1) * p))
    if limit >= weight(mode):  # the mode itself, or its equal neighbour
        return 1.0
    if events > mode:  # greatest count below the mode that is no likelier, or -1
        low, high = -1, mode
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if weight(mid) <= limit else (low, mid)
        return min(1.0, upper(events) + 1.0 - upper(low + 1))
    low, high = mode, trials + 1  # least count above the mode that is no likelier
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if weight(mid) <= limit else (mid, high)
    return min(1.0, upper(high) + 1.0 - upper(events + 1))


@F.pandas_udf(T.DoubleType())
def binomial_two_sided(events: pd.Series, trials: pd.Series, p: pd.Series) -> pd.Series:
    """Two-sided exact binomial p-values of grouped rows; null where a value is missing or ``p`` is 0 or 1."""
    rows = zip(events.astype(float), trials.astype(float), p.astype(float))
    return pd.Series([two_sided(int(x), int(n), q) if not math.isnan(x + n + q) and 0 < q < 1 else None for x, n, q in rows], dtype=float)


@F.pandas_udf(T.DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    """Upper tail of the standard normal."""
    return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2.0))).astype(float)
