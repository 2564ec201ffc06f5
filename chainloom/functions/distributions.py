"""Distribution functions that SQL lacks, for rows that are already aggregated."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi_square_even(x: Column, df: int) -> Column:
    """Upper tail of chi-square for even degrees of freedom: a finite sum, so it stays an expression."""
    h = x / 2
    terms = [F.pow(h, F.lit(float(j))) / math.factorial(j) for j in range(df // 2)]
    return F.exp(-h) * sum(terms[1:], terms[0])


def _tail(x: float, df: int) -> float:
    if df < 1 or x is None or math.isnan(x):
        return math.nan
    h = x / 2
    if df % 2 == 0:
        return math.exp(-h) * sum(h**j / math.factorial(j) for j in range(df // 2))
    return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (j + 0.5) / math.gamma(j + 1.5) for j in range((df - 1) // 2))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of chi-square; NaN without a degree of freedom."""
    return pd.Series([_tail(a, int(b)) for a, b in zip(x, df)])


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + step * d) or 1e-300)
        c = (1 + step / c) or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def _t_quantile(p: float, df: float) -> float:
    if not df >= 1:
        return math.nan
    lo, hi = 0.0, 1e4
    for _ in range(100):
        t = (lo + hi) / 2
        lo, hi = (t, hi) if 1 - _beta(df / 2, 0.5, df / (df + t * t)) / 2 < p else (lo, t)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """Student's t quantile for p above one half."""
    return pd.Series([_t_quantile(a, b) for a, b in zip(p, df)])
