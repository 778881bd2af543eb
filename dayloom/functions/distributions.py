"""Tail probabilities as vectorised pandas UDFs (one row per fitted model)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

# Response-surface coefficients for the unit-root statistic of
# one variable with a constant (MacKinnon 1994), lowest power first.
TAU_MAX = 2.74
TAU_MIN = -18.83
TAU_SPLIT = -1.61
TAU_SMALL_P = (2.1659, 1.4412, 0.038269)
TAU_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)

# Terms after which a value that has not settled is given up as NaN.
_MAX_TERMS = 100_000
_TINY = 1e-300


def _each(function, values: np.ndarray) -> np.ndarray:
    """A scalar function of an array; once for each distinct value, of which
    degrees of freedom have few."""
    distinct, place = np.unique(values, return_inverse=True)
    return np.array([function(v) for v in distinct.tolist()], dtype=float)[place].reshape(values.shape)


def _lgamma(values: np.ndarray) -> np.ndarray:
    return _each(math.lgamma, values)


def _erfc(values: np.ndarray) -> np.ndarray:
    return _each(math.erfc, values)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function, evaluated forwards
    for all rows that have not settled yet; NaN where it does not."""
    out = np.full(x.shape, np.nan)
    left = np.arange(len(x))
    ratio = 1.0 - (a + b) * x / (a + 1.0)
    den = 1.0 / np.where(np.abs(ratio) < _TINY, _TINY, ratio)
    num = np.ones_like(x)
    value = den.copy()
    for m in range(1, _MAX_TERMS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            den = 1.0 + term * den
            num = 1.0 + term / num
            den = 1.0 / np.where(np.abs(den) < _TINY, _TINY, den)
            num = np.where(np.abs(num) < _TINY, _TINY, num)
            step = den * num
            value = value * step
        settled = np.abs(step - 1.0) < 1e-15
        if settled.any():
            out[left[settled]] = value[settled]
            left, a, b, x = (v[~settled] for v in (left, a, b, x))
            den, num, value = den[~settled], num[~settled], value[~settled]
            if not len(left):
                break
    return out


def f_upper_tail(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """P(F > f) for an F(d1, d2) variable; NaN where the inputs are not valid."""
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    out = np.full(f.shape, np.nan)
    out[(f <= 0) & (d1 > 0) & (d2 > 0)] = 1.0
    ok = (f > 0) & np.isfinite(f) & (d1 > 0) & (d2 > 0)
    if not ok.any():
        return out
    a, b = d2[ok] / 2.0, d1[ok] / 2.0
    x = d2[ok] / (d2[ok] + d1[ok] * f[ok])
    y = d1[ok] * f[ok] / (d2[ok] + d1[ok] * f[ok])
    # The fraction settles quickly only below the mean, so mirror above it.
    mirror = x > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(mirror, b, a), np.where(mirror, a, b)
    u, v = np.where(mirror, y, x), np.where(mirror, x, y)
    with np.errstate(divide="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(u) + q * np.log(v))
    tail = np.clip(front * _beta_fraction(p, q, u) / p, 0.0, 1.0)
    out[ok] = np.where(mirror, 1.0 - tail, tail)
    return out


def unit_root_tail(tau: np.ndarray) -> np.ndarray:
    """Approximate p-value of a unit-root statistic (constant, one variable)."""
    tau = np.asarray(tau, dtype=float)
    small = np.polynomial.polynomial.polyval(tau, TAU_SMALL_P)
    large = np.polynomial.polynomial.polyval(tau, TAU_LARGE_P)
    p = 0.5 * _erfc(-np.where(tau <= TAU_SPLIT, small, large) / math.sqrt(2.0))
    p = np.where(tau > TAU_MAX, 1.0, np.where(tau < TAU_MIN, 0.0, p))
    return np.where(np.isnan(tau), np.nan, p)


def _to_nulls(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype(object).where(~np.isnan(values), None)


def _f_udf():
    @F.pandas_udf(DoubleType())
    def tail(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
        return _to_nulls(f_upper_tail(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))

    return tail


def _tau_udf():
    @F.pandas_udf(DoubleType())
    def tail(tau: pd.Series) -> pd.Series:
        return _to_nulls(unit_root_tail(tau.to_numpy(float)))

    return tail


def f_pvalue(f: Column, d1: Column, d2: Column) -> Column:
    return _f_udf()(f.cast("double"), d1.cast("double"), d2.cast("double"))


def with_f_pvalue(df: DataFrame, f: str, d1: str, d2: str, out: str = "p_value") -> DataFrame:
    """Add the upper-tail F probability to a table of test statistics."""
    return df.withColumn(out, f_pvalue(F.col(f), F.col(d1), F.col(d2)))


def with_mackinnon_pvalue(df: DataFrame, tau: str, out: str = "p_value") -> DataFrame:
    """Add the approximate unit-root p-value to a table of statistics."""
    return df.withColumn(out, _tau_udf()(F.col(tau).cast("double")))
