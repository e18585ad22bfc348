"""Tail probabilities for test statistics.

They are applied to result rows - one per test - never to order lines.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Beyond this many degrees of freedom log-gamma differences lose digits, and the expansion of the
# incomplete beta function for one large parameter, whose error falls with its square, is exact.
_LARGE_DF = 1.0e6


def _log_beta(a: float, b: float) -> float:
    small, large = min(a, b), max(a, b)
    if large < 1.0e5:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)
    # Stirling: log(gamma(large + small) / gamma(large)) without cancellation.
    rise = small * math.log(large) + small * (small - 1) / (2 * large)
    return math.lgamma(small) - rise


def _beta_fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function by Lentz's method."""
    tiny = 1.0e-300
    c = 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 100_000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1.0e-15:
            return value
    raise ArithmeticError(f"no convergence of the beta fraction at x={x}, a={a}, b={b}")


def incomplete_beta(x: float, complement: float, a: float, b: float) -> float:
    """Regularised incomplete beta at ``x``, given ``complement`` = 1 - x unrounded."""
    if x <= 0.0:
        return 0.0
    if complement <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log(complement) - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return min(1.0, front * _beta_fraction(x, a, b) / a)
    return max(0.0, 1.0 - front * _beta_fraction(complement, b, a) / b)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function, by its series or its continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    # Lentz's method for the fraction with terms x + 2k + 1 - a and -k (k - a).
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    value, k, step = d, 0.0, 0.0
    while abs(step - 1.0) > 1e-16 * 4:
        k += 1.0
        b += 2.0
        part = -k * (k - a)
        d = 1.0 / (b + part * d or 1e-300)
        c = b + part / c or 1e-300
        step = c * d
        value *= step
    return front * value


def student_t_two_sided(t: float | None, df: float | None) -> float | None:
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return None
    if math.isinf(t):
        return 0.0
    square = t * t
    if df > _LARGE_DF:
        return math.erfc(math.sqrt((df / 2.0 - 0.25) * math.log1p(square / df)))
    return incomplete_beta(df / (df + square), square / (df + square), df / 2.0, 0.5)


def f_upper(f: float | None, d1: float | None, d2: float | None) -> float | None:
    if f is None or d1 is None or d2 is None or math.isnan(f) or math.isnan(d1) or math.isnan(d2):
        return None
    if d1 <= 0 or d2 <= 0:
        return None
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    scaled = d1 * f
    if d2 > _LARGE_DF and d1 < d2 * 1e-3:
        half = d1 / 2.0
        return gamma_upper(half, (d2 / 2.0 + (half - 1.0) / 2.0) * math.log1p(scaled / d2))
    return incomplete_beta(d2 / (d2 + scaled), scaled / (d2 + scaled), d2 / 2.0, d1 / 2.0)


def _each(rule, *columns: pd.Series) -> pd.Series:
    values = [rule(*map(float, row)) for row in zip(*columns)]
    return pd.Series(values, dtype="object").astype("Float64")


@F.pandas_udf(T.DoubleType())
def _t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(student_t_two_sided, t.astype("float64"), df.astype("float64"))


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(f_upper, f.astype("float64"), d1.astype("float64"), d2.astype("float64"))


def t_p_value(t: Column, df: Column) -> Column:
    """Two-sided probability of a Student-t statistic."""
    return _t_tail(t.cast("double"), df.cast("double"))


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    """Upper-tail probability of an F statistic."""
    return _f_tail(f.cast("double"), d1.cast("double"), d2.cast("double"))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    """What a p-value says about the null hypothesis; null for an undefined test."""
    return F.when(p < alpha, F.lit("reject")).when(p.isNotNull(), F.lit("fail to reject"))
