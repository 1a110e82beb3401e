"""Tail probabilities for test statistics.

The Kolmogorov series is a column expression. The others finish one number per test result, so
they run as vectorised functions on tables with one row per test, never on readings.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get these few functions with the job, so the library need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def kolmogorov_p(d: Column, n1: Column, n2: Column, terms: int = 20) -> Column:
    """Asymptotic two-sided p-value of a two-sample KS statistic."""
    lam2 = d * d * (n1 * n2) / (n1 + n2)
    series = F.lit(0.0)
    for k in range(1, terms + 1):
        series = series + F.lit((-1.0) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam2)
    # The alternating series only settles away from 0; below that the p-value is 1.
    return F.when(lam2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2.0)))


def _normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def _student_two_sided(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def _chi_square_upper(x: float, df: float) -> float:
    """Upper regularised gamma Q(df/2, x/2): series below, continued fraction above."""
    if df <= 0 or x <= 0:
        return 1.0
    a, z = df / 2.0, x / 2.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1.0
            term *= z / k
            total += term
        return max(0.0, 1.0 - front * total)
    b = z + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        num = -i * (i - a)
        b += 2.0
        d = 1.0 / (num * d + b)
        c = b + num / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return front * h


@F.pandas_udf(T.DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(_normal_two_sided, na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def student_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else _student_two_sided(a, b) for a, b in zip(t, df)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [None if pd.isna(a) or pd.isna(b) else _chi_square_upper(a, b) for a, b in zip(x, df)],
        dtype="float64",
    )
