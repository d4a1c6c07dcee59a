"""Probability functions that neither Spark nor NumPy offers, for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_two_sided(z: np.ndarray) -> np.ndarray:
    """Two-sided normal tail probability of |z|, at most 1."""
    return np.minimum(1.0, np.array([math.erfc(v / math.sqrt(2.0)) for v in np.asarray(z, dtype=float)]))


def student_two_sided(t: float, dof: float) -> float:
    """Two-sided tail of Student's t through the regularised incomplete beta function."""
    if not math.isfinite(t):
        return 0.0
    return betainc(dof / 2.0, 0.5, dof / (dof + t * t))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - betainc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Continued fraction 1/(1+ e1/(1+ e2/(1+ ..))), evaluated from the far end.
    value = 1.0
    for k in range(200, 0, -1):
        m = k // 2
        if k % 2:
            e = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            e = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        value = 1.0 + e / value
    return front / value


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of a 2x2 table: all tables at most as likely as the given one.

    Probabilities are followed from the mode outwards until they vanish in double precision, so the
    work grows with the standard deviation, not with the number of rows.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    mode = min(max(int((row + 1) * (col + 1) / (n + 2)), lo), hi)

    def log_pmf(k):
        lg = math.lgamma
        return (lg(row + 1) - lg(k + 1) - lg(row - k + 1) + lg(n - row + 1) - lg(col - k + 1)
                - lg(n - row - col + k + 1) - lg(n + 1) + lg(col + 1) + lg(n - col + 1))

    spread = int(40 * math.sqrt(max(1.0, n / 4))) + 1
    k = np.arange(max(lo, mode - spread), min(hi, mode + spread) + 1, dtype=float)
    step = np.log((row - k[:-1]) * (col - k[:-1])) - np.log((k[:-1] + 1) * (n - row - col + k[:-1] + 1))
    logs = np.concatenate([[0.0], np.cumsum(step)])
    logs -= logs[int(mode - k[0])]
    weights = np.exp(logs)
    weights /= weights.sum()
    here = int(a - k[0])
    seen = weights[here] if 0 <= here < len(weights) else 0.0
    return float(min(1.0, weights[weights <= seen * (1 + 1e-7)].sum()))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy()))


@F.pandas_udf(T.DoubleType())
def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(int(w), int(x), int(y), int(z)) for w, x, y, z in zip(a, b, c, d)], dtype=float)
