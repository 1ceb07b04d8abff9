"""Tails of the usual distributions, vectorised in numpy, and as pandas functions for columns.

Incomplete beta and gamma functions are summed as continued fractions and series (Lentz's method), to about 1e-12.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])
_erfc = np.vectorize(math.erfc, otypes=[float])


def _beta_fraction(a, b, x, rounds=400):
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, rounds):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            h = h * d * c
    return h


def beta_inc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    inner = np.clip(x, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    low = x < (a + 1) / (a + b + 2)
    with np.errstate(all="ignore"):
        value = np.where(low, front * _beta_fraction(a, b, inner) / a, 1 - front * _beta_fraction(b, a, 1 - inner) / b)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, value))


def gamma_upper(a, x):
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0.0))
    safe = np.maximum(x, 1e-300)
    front = np.exp(-safe + a * np.log(safe) - _lgamma(a))
    term = total = 1 / a
    for n in range(1, 600):
        term = term * safe / (a + n)
        total = total + term
    b = safe + 1 - a
    c, d = np.full_like(safe, 1 / _TINY), 1 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for n in range(1, 600):
        an = -n * (n - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * d * c
    return np.where(x <= 0, 1.0, np.where(x < a + 1, 1 - front * total, front * h))


def t_two_sided(t, df):
    """Two-sided p of a t statistic."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f, df1, df2):
    """Upper tail of F."""
    f, df1, df2 = (np.asarray(v, float) for v in (f, df1, df2))
    return beta_inc(df2 / 2, df1 / 2, df2 / (df2 + df1 * np.maximum(f, 0.0)))


def chi2_upper(x, df):
    """Upper tail of chi-square."""
    return gamma_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_two_sided(z):
    """Two-sided p of a z statistic."""
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2))


def binomial_upper(k, n, p=0.5):
    """P(X >= k) of n trials."""
    k, n = np.asarray(k, float), np.asarray(n, float)
    return np.where(k <= 0, 1.0, beta_inc(np.maximum(k, 1e-9), n - k + 1, p))


def recomputed(test, stat, df1, df2, two_sided=True):
    """p of a reported statistic of kind t, z, F, chi2 or r (r with df1 = n - 2); NaN for other kinds."""
    test = np.asarray(test, object)
    stat, df1, df2 = (np.asarray(v, float) for v in (stat, df1, df2))
    one = np.where(np.isnan(df1), 1.0, df1)
    r = np.clip(stat, -1 + 1e-15, 1 - 1e-15)
    with np.errstate(all="ignore"):
        two = np.select(
            [test == "t", test == "z", test == "r", test == "F", test == "chi2"],
            [t_two_sided(stat, one), normal_two_sided(stat), t_two_sided(r * np.sqrt(one / (1 - r * r)), one), f_upper(stat, one, np.where(np.isnan(df2), 1.0, df2)), chi2_upper(stat, one)],
            np.nan,
        )
    return np.where(np.isin(test, ["F", "chi2"]) | two_sided, two, two / 2)


def _nullable(p: np.ndarray, *given: pd.Series) -> pd.Series:
    out = pd.Series(p)
    for s in given:
        out[s.isna().to_numpy()] = np.nan
    return out


@F.pandas_udf(T.DoubleType())
def _t_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(t.fillna(0.0), df.fillna(1.0)), t, df)


@F.pandas_udf(T.DoubleType())
def _chi2_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(chi2_upper(x.fillna(0.0), df.fillna(1.0)), x, df)


@F.pandas_udf(T.DoubleType())
def _z_udf(z: pd.Series) -> pd.Series:
    return _nullable(normal_two_sided(z.fillna(0.0)), z)


@F.pandas_udf(T.DoubleType())
def _reported_udf(test: pd.Series, stat: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _nullable(recomputed(test, stat.fillna(0.0), df1, df2), stat)


def t_p(t: Column, df: Column) -> Column:
    """Two-sided p of a column of t statistics."""
    return _t_udf(t.cast("double"), df.cast("double"))


def chi2_p(x: Column, df: Column) -> Column:
    """Upper tail of a column of chi-squares."""
    return _chi2_udf(x.cast("double"), df.cast("double"))


def z_p(z: Column) -> Column:
    """Two-sided p of a column of z statistics."""
    return _z_udf(z.cast("double"))


def reported_p(test: Column, stat: Column, df1: Column, df2: Column) -> Column:
    """p recomputed from reported statistics."""
    return _reported_udf(test, stat.cast("double"), df1.cast("double"), df2.cast("double"))
