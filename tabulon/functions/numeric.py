"""Numeric functions: missing in, missing out; a result outside the domain is missing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.missing import col


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def div(x, y) -> Column:
    """Division by zero is missing."""
    return F.try_divide(col(x).cast("double"), col(y).cast("double"))


def power(x, y) -> Column:
    return finite(F.pow(col(x).cast("double"), col(y).cast("double")))


def trunc_int(x) -> Column:
    """Towards zero."""
    x = col(x).cast("double")
    return F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)).cast("double")


def round_to(x, unit=1.0) -> Column:
    """To the nearest multiple of the unit, halves away from zero."""
    x = col(x).cast("double")
    q = F.try_divide(x, col(unit).cast("double"))
    return F.round(q) * col(unit)


def sqrt(x) -> Column:
    x = col(x).cast("double")
    return F.when(x >= 0, F.sqrt(x))


def ln(x) -> Column:
    x = col(x).cast("double")
    return F.when(x > 0, F.log(x))


def log10(x) -> Column:
    x = col(x).cast("double")
    return F.when(x > 0, F.log10(x))


def asin(x) -> Column:
    x = col(x).cast("double")
    return F.when(x.between(-1, 1), F.asin(x))


def acos(x) -> Column:
    x = col(x).cast("double")
    return F.when(x.between(-1, 1), F.acos(x))


def mod(x, y) -> Column:
    """Remainder with the sign of the dividend; by zero it is missing."""
    return F.try_mod(col(x).cast("double"), col(y).cast("double"))


exp, sin, cos, tan, sinh, cosh, tanh, atan, atan2, floor, ceil, sign = F.exp, F.sin, F.cos, F.tan, F.sinh, F.cosh, F.tanh, F.atan, F.atan2, F.floor, F.ceil, F.signum


def runiform(seed: int) -> Column:
    """Uniform on [0, 1); reproducible for a seed and a partitioning, not a fixed sequence."""
    return F.rand(seed)


def rnormal(seed: int, mean=0.0, sd=1.0) -> Column:
    return F.randn(seed) * col(sd) + col(mean)


# --- distributions -----------------------------------------------------------------


def normalden(x, mean=0.0, sd=1.0) -> Column:
    z = (col(x) - col(mean)) / col(sd)
    return F.exp(-z * z / 2) / (col(sd) * math.sqrt(2 * math.pi))


def lnnormalden(x, mean=0.0, sd=1.0) -> Column:
    z = (col(x) - col(mean)) / col(sd)
    return -z * z / 2 - F.log(col(sd)) - 0.5 * math.log(2 * math.pi)


# Coefficients of the Lanczos approximation of the gamma function (g = 7).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]

# The functions below take numbers or arrays, so a batch is one call.


def ln_gamma(x):
    """Logarithm of the gamma function of positive numbers."""
    x = np.asarray(x, float)
    z = np.where(x < 0.5, x + 1, x) - 1
    s = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], 1))
    t = z + 7.5
    with np.errstate(divide="ignore", invalid="ignore"):
        return 0.5 * math.log(2 * math.pi) + (z + 0.5) * np.log(t) - t + np.log(s) - np.where(x < 0.5, np.log(x), 0.0)


@np.errstate(all="ignore")
def gamma_pq(a, x) -> tuple[np.ndarray, np.ndarray]:
    """Regularized lower and upper incomplete gamma functions, each without loss where it is small."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    front = np.exp(-x + a * np.log(x) - ln_gamma(a))
    low = x < a + 1
    t = s = 1 / np.where(low, a, 1.0)
    k = np.where(low, a, 1.0)
    xs = np.where(low, x, 0.0)
    for _ in range(10_000):
        k = k + 1
        t = t * xs / k
        s = s + t
        if not np.any(np.abs(t) > np.abs(s) * 1e-16):
            break
    b = np.where(low, 1.0, x) + 1 - np.where(low, 1.0, a)
    c, d = np.full(x.shape, 1e300), 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - np.where(low, 1.0, a))
        b = b + 2
        d = an * d + b
        d = 1 / np.where(d == 0, 1e-300, d)
        c = b + an / c
        c = np.where(c == 0, 1e-300, c)
        h = h * d * c
        if not np.any(np.abs(d * c - 1) > 1e-15):
            break
    p = np.where(low, s * front, 1 - front * h)
    q = np.where(low, 1 - s * front, front * h)
    zero = x <= 0
    return np.where(zero, 0.0, p), np.where(zero, 1.0, q)


def phi(z):
    """Normal distribution function."""
    z = np.asarray(z, float)
    tail = 0.5 * gamma_pq(0.5, z * z / 2)[1]
    return np.where(z < 0, tail, 1 - tail)


@np.errstate(all="ignore")
def ln_phi(z):
    z = np.asarray(z, float)
    far = np.where(z < -5, z, -6.0)  # asymptotic series of the tail
    s = t = np.ones_like(far)
    grows = np.zeros(far.shape, bool)
    for k in range(1, 12):
        t = t * -(2 * k - 1) / (far * far)
        grows = grows | (np.abs(t) > np.abs(s))
        s = np.where(grows, s, s + t)
    tail = -far * far / 2 - np.log(-far) - 0.5 * math.log(2 * math.pi) + np.log(s)
    return np.where(z < -5, tail, np.log(phi(z)))


@np.errstate(all="ignore")
def beta_inc(a, b, x):
    """Regularized incomplete beta function by its continued fraction, on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    turn = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    inside = (y > 0) & (y < 1)
    y = np.where(inside, y, 0.5)
    front = np.exp(ln_gamma(p + q) - ln_gamma(p) - ln_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    f, c, d = np.ones_like(y), np.ones_like(y), np.zeros_like(y)
    for i in range(1000):
        m = i // 2
        if i == 0:
            v = np.ones_like(y)
        elif i % 2 == 0:
            v = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            v = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        d = 1 + v * d
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = 1 + v / c
        f = f * c * d
        if i > 1 and not np.any(np.abs(1 - c * d) > 1e-15):
            break
    r = front * (f - 1)
    r = np.where(inside, r, np.where(np.where(turn, 1 - x, x) >= 1, 1.0, 0.0))
    return np.where(turn, 1 - r, r)


def t_tail(df, t):
    t, df = np.asarray(t, float), np.asarray(df, float)
    p = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, p, 1 - p)


def f_tail(d1, d2, f):
    d1, d2, f = (np.asarray(v, float) for v in (d1, d2, f))
    return np.where(f <= 0, 1.0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(f, 0))))


def chi2_cdf(df, x):
    return gamma_pq(np.asarray(df, float) / 2, np.asarray(x, float) / 2)[0]


def chi2_tail(df, x):
    return gamma_pq(np.asarray(df, float) / 2, np.asarray(x, float) / 2)[1]


def inv_t_tail(df, p):
    """t with upper tail p, by bisection; equal arguments are solved once."""
    df, p = np.broadcast_arrays(np.asarray(df, float), np.asarray(p, float))
    pairs, at = np.unique(np.stack([df.ravel(), p.ravel()]), axis=1, return_inverse=True)
    n, q = pairs
    ok = (q > 0) & (q < 1) & (n > 0)
    lo, hi = np.full(len(q), -1.0), np.full(len(q), 1.0)
    for _ in range(1000):
        far, near = ok & (t_tail(n, hi) > q), ok & (t_tail(n, lo) < q)
        if not (far.any() or near.any()):
            break
        hi, lo = np.where(far, hi * 2, hi), np.where(near, lo * 2, lo)
    for _ in range(200):
        mid = (lo + hi) / 2
        above = t_tail(n, mid) > q
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
        if np.all(hi - lo <= 1e-15 * np.maximum(1, np.abs(hi))):
            break
    return np.where(ok, (lo + hi) / 2, np.nan)[at.ravel()].reshape(df.shape)


def inv_phi(p):
    """Normal quantile: bisection to a start, then Newton steps on the logarithm of the tail."""
    p = np.asarray(p, float)
    ok = (p > 0) & (p < 1)
    q = np.where(ok, np.minimum(p, 1 - p), 0.25)
    lo, hi = np.full(q.shape, -40.0), np.zeros(q.shape)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = ln_phi(mid) < np.log(q)
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    z = (lo + hi) / 2
    return np.where(ok, np.where(p < 0.5, z, -z), np.nan)


def _masked(f, *batch: pd.Series) -> pd.Series:
    """f of a batch; missing where an argument is."""
    a = [s.to_numpy(float, na_value=np.nan) for s in batch]
    gone = np.logical_or.reduce([np.isnan(v) for v in a])
    return pd.Series(np.where(gone, np.nan, f(*(np.where(gone, 0.5, v) for v in a))))


def _udf1(f):
    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        return _masked(f, x)

    return lambda x: finite(run(col(x).cast("double")))


def _udf2(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return _masked(f, a, b)

    return lambda a, b: finite(run(col(a).cast("double"), col(b).cast("double")))


def _udf3(f):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return _masked(f, a, b, c)

    return lambda a, b, c: finite(run(*(col(v).cast("double") for v in (a, b, c))))


def normal(x) -> Column:
    """Normal distribution function."""
    return _udf1(phi)(x)


def lnnormal(x) -> Column:
    return _udf1(ln_phi)(x)


def invnormal(p) -> Column:
    return _udf1(inv_phi)(p)


def ttail(df, t) -> Column:
    return _udf2(t_tail)(df, t)


def invttail(df, p) -> Column:
    return _udf2(inv_t_tail)(df, p)


def chi2(df, x) -> Column:
    return _udf2(chi2_cdf)(df, x)


def chi2tail(df, x) -> Column:
    return _udf2(chi2_tail)(df, x)


def ftail(d1, d2, f) -> Column:
    return _udf3(f_tail)(d1, d2, f)


def fcdf(d1, d2, f) -> Column:
    return _udf3(lambda a, b, v: 1 - f_tail(a, b, v))(d1, d2, f)
