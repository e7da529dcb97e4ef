"""The regularised incomplete beta function, which Spark lacks, over Arrow batches."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TERMS = 300
TINY = 1e-300


def _fraction(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    def guard(v):
        return np.where(np.abs(v) < TINY, TINY, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    value = d.copy()
    for m in range(1, TERMS):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / guard(1.0 + step * d)
            c = guard(1.0 + step / c)
            change = c * d
            value = value * change
        if np.all((np.abs(change - 1.0) < 1e-15) | np.isnan(change)):
            return value
    if np.any(np.abs(change - 1.0) > 1e-10):
        raise ArithmeticError("the continued fraction doesn't converge")
    return value


def _log_gamma_ratio(a: float, b: float) -> float:
    """ln(gamma(a + b) / gamma(a)); a series where the difference of two large values loses digits."""
    if a < 1e5:
        return math.lgamma(a + b) - math.lgamma(a)
    # Stirling's series of both, with the large terms taken together
    return (b * math.log(a) + (a + b - 0.5) * math.log1p(b / a) - b
            + (1 / (a + b) - 1 / a) / 12 - (1 / (a + b) ** 3 - 1 / a ** 3) / 360)


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray) -> np.ndarray:
    """I_x(a, b) element by element; NaN stays NaN."""
    lead = np.array([_log_gamma_ratio(v, b) - math.lgamma(b) for v in a])
    with np.errstate(all="ignore"):
        inner = np.clip(x, TINY, 1 - 1e-16)
        front = np.exp(lead + a * np.log(inner) + b * np.log1p(-inner))
        low = x < (a + 1) / (a + b + 2)
        direct = front * _fraction(a, b, np.where(low, inner, 0.5)) / a
        swapped = 1.0 - front * _fraction(np.full_like(a, b), a, np.where(low, 0.5, 1 - inner)) / b
        value = np.where(low, direct, swapped)
        value = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))
    return np.where(np.isnan(x), np.nan, value)


@F.pandas_udf(T.DoubleType())
def correlation_p_value(r: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation coefficient; none at r = ±1 or without a coefficient."""
    degrees = df.to_numpy(dtype=float)
    squared = r.to_numpy(dtype=float) ** 2
    ok = ~np.isnan(squared) & (squared < 1.0) & (degrees > 0)
    x = np.where(ok, 1.0 - squared, 0.5)
    p = incomplete_beta(np.where(ok, degrees, 2.0) / 2.0, 0.5, x)
    return pd.Series(p).where(pd.Series(ok), None)
