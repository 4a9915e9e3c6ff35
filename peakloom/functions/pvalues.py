"""Two-sided p-values that Spark SQL has no function for, as Arrow UDFs over one row per compound."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for coefficient in (even, odd):
            d = 1.0 + coefficient * d
            c = 1.0 + coefficient / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return front * value / a


@pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for Student's t with real degrees of freedom; null in, null out."""

    def one(tv, dv):
        if tv is None or dv is None or np.isnan(tv) or np.isnan(dv) or dv <= 0:
            return None
        return _beta_tail(dv / 2.0, 0.5, dv / (dv + tv * tv)) if math.isfinite(tv) else 0.0

    return pd.Series([one(a, b) for a, b in zip(t, df)], dtype="float64")


#: Largest product of both sizes with an exact tail; it bounds the buffer of a row to 16 MB.
EXACT_PRODUCT = 4_000_000


def _exact_u_tail(n1: int, n2: int, u: float) -> float:
    """P(U >= u) without ties: counts of partitions of U by the product of Gaussian binomial factors.

    U is symmetric, so the tail is summed at the low end, where counts are small and nothing cancels.
    """
    small, large = min(n1, n2), max(n1, n2)
    counts = np.zeros(small * large - int(math.ceil(u)) + 1)
    counts[0] = 1.0
    for i in range(1, small + 1):
        up, down = large + i, i
        if up < len(counts):
            counts[up:] = counts[up:] - counts[: len(counts) - up]
        for start in range(down):
            counts[start::down] = np.cumsum(counts[start::down])
    return float(counts.sum() / math.comb(n1 + n2, small))


def _exact_counts_ok(n1: int, n2: int) -> bool:
    return min(n1, n2) <= 8 and n1 * n2 <= EXACT_PRODUCT


@pandas_udf(DoubleType())
def mann_whitney_p(u1: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Two-sided Mann-Whitney p: exact when one side has at most 8 values, the product of both sizes is at most
    ``EXACT_PRODUCT`` and nothing ties, else normal.

    ``ties`` is the sum of t^3 - t over tied values. The normal branch has tie and continuity correction.
    """

    def one(u, a, b, tie):
        if u is None or np.isnan(u):
            return None
        a, b = int(a), int(b)
        top = max(u, a * b - u)
        if tie == 0 and _exact_counts_ok(a, b):
            return min(1.0, 2.0 * _exact_u_tail(a, b, top))
        n = a + b
        spread = a * b / 12.0 * ((n + 1) - tie / (n * (n - 1)))
        if spread <= 0:
            return None
        z = (top - a * b / 2.0 - 0.5) / math.sqrt(spread)
        return min(1.0, math.erfc(z / math.sqrt(2.0)))

    return pd.Series([one(*row) for row in zip(u1, n1, n2, ties)], dtype="float64")
