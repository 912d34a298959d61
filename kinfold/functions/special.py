"""Small vectorised special functions used inside Pandas UDFs on result rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete-beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1 - x) / b


def student_t_two_sided(rho: pd.Series, n: pd.Series) -> pd.Series:
    """p-value of a correlation coefficient ``rho`` over ``n`` points."""
    def one(r, m):
        if r is None or np.isnan(r) or m < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        dof = m - 2
        return incomplete_beta(dof / 2, 0.5, 1 - r * r)

    return pd.Series([one(r, m) for r, m in zip(rho, n)], dtype="float64")


def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.abs().map(lambda v: math.erfc(v / math.sqrt(2)))
