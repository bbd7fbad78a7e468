"""Tail probabilities of test statistics.

These run on one row per test, after aggregation; they are the only Python
functions in the library.  The Student tail is integrated, by one rule for all degrees
of freedom.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Sent to the workers as code, so that they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Coefficients of 1/a, 1/a^3, ... in log(gamma(a + 1/2) / gamma(a)) - log(a) / 2.
_RATIO = (-1 / 8, 1 / 192, -1 / 640, 17 / 14336, -31 / 18432, 691 / 180224)
#: Gauss-Legendre rule of a panel, and panels of the tail.
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(24)
_PANELS = 24


def log_gamma_ratio(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)) without the difference of two large numbers: the
    series holds from 20 on, and recurrence leads there."""
    shift = 0.0
    while a < 20.0:
        shift += math.log(a / (a + 0.5))
        a += 1.0
    return shift + 0.5 * math.log(a) + sum(c / a ** (2 * i + 1) for i, c in enumerate(_RATIO))


def _integral(function, low: float, high: float, panels: int) -> float:
    edges = np.linspace(low, high, panels + 1)
    half = (edges[1:] - edges[:-1]) / 2
    points = (edges[:-1] + half)[:, None] + half[:, None] * _NODES
    return float((function(points) @ _WEIGHTS) @ half)


def student_two_sided(t: float, df: float) -> float:
    """Both tails of Student's t beyond ``t``, by the same integrals at every number
    of degrees of freedom.

    Up to 1 the middle is integrated and taken from 1.  Beyond, the exponent of the density is
    taken as the variable (z squared), in which tails of all weights fall alike.
    """
    if t != t or df != df or df <= 0:
        return float("nan")
    t = abs(t)
    if math.isinf(t):
        return 0.0
    log_scale = log_gamma_ratio(df / 2.0) - 0.5 * math.log(df * math.pi)
    power = (df + 1.0) / 2.0
    if t <= 1.0:
        middle = _integral(lambda s: np.exp(-power * np.log1p(s * s / df)), 0.0, t, 4)
        return max(0.0, 1.0 - 2.0 * math.exp(log_scale) * middle)

    def along(z):
        grown = np.exp(z * z / power)
        # s squared, where the density has fallen by exp(-z squared) from t.
        square = t * t * grown + df * np.expm1(z * z / power)
        return np.exp(-z * z) * (1.0 + square / df) * z / np.sqrt(square)

    far = math.sqrt(45.0 * (df + 1.0) / df)
    tail = _integral(along, 0.0, far, _PANELS) * df / power
    return 2.0 * math.exp(log_scale - power * math.log1p(t * t / df)) * tail


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


@pandas_udf(DoubleType())
def student_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    known = t.notna() & df.notna() & (df > 0)
    return pd.Series(
        [student_two_sided(a, b) if ok else None for a, b, ok in zip(t, df, known)], dtype="float64"
    )


@pandas_udf(DoubleType())
def normal_upper_p(z: pd.Series) -> pd.Series:
    return pd.Series([normal_upper(a) if ok else None for a, ok in zip(z, z.notna())], dtype="float64")
