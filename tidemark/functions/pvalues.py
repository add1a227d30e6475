"""Tail probabilities for result tables of one row per test.

Series and continued fractions from the usual handbooks, wrapped as Pandas
UDFs. They run on aggregated rows only. The Kolmogorov tail is a plain column.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # Lentz evaluation of the continued fraction.
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + step * d or tiny)
        c = 1.0 + step / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        total = term = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1.0 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1.0 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def _columns(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series)], dtype="float64")


def _tail(fn, *columns: Column | str) -> Column:
    """Apply a scalar tail function to the rows of a result table."""

    def two(x: pd.Series, a: pd.Series) -> pd.Series:
        return _columns(fn, x, a)

    def three(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _columns(fn, x, a, b)

    return F.pandas_udf(two if len(columns) == 2 else three, "double")(*columns)


def t_p(t: Column | str, df: Column | str) -> Column:
    return _tail(t_two_sided, t, df)


def f_p(f: Column | str, d1: Column | str, d2: Column | str) -> Column:
    return _tail(f_tail, f, d1, d2)


def chi2_p(x: Column | str, df: Column | str) -> Column:
    return _tail(chi2_tail, x, df)


def ks_p(statistic: Column, n1: Column, n2: Column) -> Column:
    """Limit distribution of the two-sample Kolmogorov-Smirnov statistic."""
    root = F.sqrt(n1 * n2 / (n1 + n2).cast("double"))
    lam = statistic * root
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(101)),
        lambda k: F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    # Below 0.2 the tail is 1 to double precision and the series converges slowly.
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), total)))
