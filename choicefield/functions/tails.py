"""Upper tails of the chi-square and Student t laws as Arrow-batched UDFs.

Both laws need the incomplete gamma / beta function, which has no closed form
for general degrees of freedom. They are applied to small statistic tables
(one row per test), never to the data rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPS = 1e-16
_TINY = 1e-300


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - scale * total)
    b = x + 1 - a
    c = 1 / _TINY
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"incomplete gamma did not settle at a={a}, x={x}")
    return scale * h


def _log_gamma_step(a: float, b: float) -> float:
    """ln Gamma(a + b) - ln Gamma(a) without the loss of digits that the difference has for a large a."""
    if a < 50:
        return math.lgamma(a + b) - math.lgamma(a)
    rest = lambda x: 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return (a + b - 0.5) * math.log1p(b / a) + b * (math.log(a) - 1) + rest(a + b) - rest(a)


def incomplete_beta(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction; ``y`` is 1 - x where it is known exactly."""
    y = 1 - x if y is None else y
    if x <= 0 or y <= 0:
        return float(y <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, y, x)
    step = _log_gamma_step(a, b) - math.lgamma(b) if a >= b else _log_gamma_step(b, a) - math.lgamma(a)
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(step + a * log_x + b * log_y) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or _TINY)
            c = 1 + num / c or _TINY
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    else:
        raise ArithmeticError(f"incomplete beta did not settle at a={a}, b={b}, x={x}")
    return front * h


LARGE_DF = 1e6


def t_tail(t: float, df: float) -> float:
    """Two-sided p-value. Above a million degrees of freedom the continued fraction loses digits; the normal value of
    Hill's expansion is exact there to about 1e-12."""
    if df <= LARGE_DF:
        return incomplete_beta(df / 2, 0.5, df / (df + t * t), t * t / (df + t * t))
    a = df - 0.5
    y = a * math.log1p(t * t / df)
    return math.erfc(math.sqrt(y / 2) * (1 + (y + 3) / (48 * a * a)))


def _pairwise(fn, left: pd.Series, right: pd.Series) -> pd.Series:
    ok = left.notna() & right.notna() & np.isfinite(left) & (right > 0)
    return pd.Series([fn(x, d) if good else None for x, d, good in zip(left, right, ok)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _pairwise(lambda v, d: upper_gamma(d / 2, v / 2), x, df)


@F.pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _pairwise(t_tail, t, df)
