"""Exact limits of counts and proportions, and chi-square tails: numpy on distinct values, joined back."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function, by series or continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.zeros(a.shape)
    pos = x > 0
    front[pos] = np.exp(a[pos] * np.log(x[pos]) - x[pos] - _lgamma(a[pos])) if pos.any() else 0
    low = pos & (x < a + 1)
    if low.any():
        term = 1 / a[low]
        total, k = term.copy(), a[low].copy()
        for _ in range(100_000):
            k += 1
            term *= x[low] / k
            total += term
            if (term < total * 1e-16).all():
                break
        out[low] = total * front[low]
    high = pos & ~low
    if high.any():
        ah, xh = a[high], x[high]
        b = xh + 1 - ah
        c = np.full(b.shape, 1e300)
        d = 1 / b
        h, done = d.copy(), np.zeros(b.shape, bool)
        for i in range(1, 100_000):
            an = -i * (i - ah)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + an / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            step = d * c
            h *= step
            done |= np.abs(step - 1) < 1e-15  # each once: rounding may lift it again
            if done.all():
                break
        out[high] = 1 - front[high] * h
    return np.clip(out, 0, 1)


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function, by continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inner = np.clip(y, 1e-300, 1 - 1e-16)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(inner) + q * np.log1p(-inner)) / p
    tiny = 1e-300
    c, d = np.ones(p.shape), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h, done = d.copy(), np.zeros(p.shape, bool)
    for m in range(1, 10_000):
        for an in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        done |= np.abs(d * c - 1) < 1e-15
        if done.all():
            break
    i = np.where(y <= 0, 0, np.where(y >= 1, 1, front * h))
    return np.clip(np.where(swap, 1 - i, i), 0, 1)


def _inverted(cdf: Callable[..., np.ndarray], log_density: Callable[..., np.ndarray], target: float, start: np.ndarray, top: np.ndarray, *of: np.ndarray) -> np.ndarray:
    """Where increasing functions with parameters `of` take a value between 0 and top: Newton steps from a near start, halving where one leaves the bracket."""
    low, high = np.zeros(start.shape), np.array(top, float)
    at = np.where((start > low) & (start < high), start, high / 2)
    open_ = np.arange(len(at))
    for _ in range(200):
        m, some = at[open_], [x[open_] for x in of]
        p = cdf(*some, m)
        below = p < target
        low[open_], high[open_] = np.where(below, m, low[open_]), np.where(below, high[open_], m)
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            new = m + (target - p) / np.exp(log_density(*some, m))
        inside = (new == m) | ((new > low[open_]) & (new < high[open_]))
        at[open_] = np.where(inside, new, (low[open_] + high[open_]) / 2)
        moved = np.abs(at[open_] - m) > 1e-13 * np.maximum(1, np.abs(m))
        open_ = open_[moved]
        if not len(open_):
            break
    return at


def _by_size(limits: Callable[..., tuple[np.ndarray, np.ndarray]], *of: np.ndarray, rows: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Limits, values of like size together: the steps that a value needs grow with the root of its size."""
    order = np.argsort(of[-1], kind="stable")
    lower, upper = np.empty(len(order)), np.empty(len(order))
    for k in range(0, len(order), rows):
        own = order[k : k + rows]
        lower[own], upper[own] = limits(*(x[own] for x in of))
    return lower, upper


def poisson_limits(count: np.ndarray, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact limits of Poisson counts; the lower is 0 for 0."""
    tail = (1 - confidence) / 2
    z = NormalDist().inv_cdf(1 - tail)
    log_density = lambda a, m: (a - 1) * np.log(m) - m - _lgamma(a)
    near = lambda a, z: a * (1 - 1 / (9 * a) + z / (3 * np.sqrt(a))) ** 3

    def limits(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        top = x + 1 + (6 * z + 1) * np.sqrt(x + 1) + 10 * z + 10
        lower = np.zeros(x.shape)
        some = x > 0
        if some.any():
            lower[some] = _inverted(gamma_p, log_density, tail, near(x[some], -z), top[some], x[some])
        return lower, _inverted(gamma_p, log_density, 1 - tail, near(x + 1, z), top, x + 1)

    return _by_size(limits, np.asarray(count, float))


def binomial_limits(successes: np.ndarray, trials: np.ndarray, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """Exact limits of proportions (0 to 1)."""
    tail = (1 - confidence) / 2
    z = NormalDist().inv_cdf(1 - tail)
    log_density = lambda a, b, p: (a - 1) * np.log(p) + (b - 1) * np.log1p(-p) + _lgamma(a + b) - _lgamma(a) - _lgamma(b)

    def side(a: np.ndarray, b: np.ndarray, target: float, z: float) -> np.ndarray:
        near = a / (a + b) + z * np.sqrt(a * b / (a + b + 1)) / (a + b)
        return _inverted(beta_i, log_density, target, near, np.ones(a.shape), a, b)

    def limits(k: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = np.zeros(k.shape), np.ones(k.shape)
        lo, hi = k > 0, k < n
        if lo.any():
            lower[lo] = side(k[lo], n[lo] - k[lo] + 1, tail, -z)
        if hi.any():
            upper[hi] = side(k[hi] + 1, n[hi] - k[hi], 1 - tail, z)
        return lower, upper

    return _by_size(limits, np.asarray(successes, float), np.asarray(trials, float))


def poisson_limits_of(count: Column, confidence: float = 0.95) -> Column:
    """(lower, upper) of a rounded count, in the row; a batch computes each distinct count once. Null for negative or missing counts."""

    @F.pandas_udf("lower double, upper double")
    def limits(k: pd.Series) -> pd.DataFrame:
        which, distinct = pd.factorize(k.where(k >= 0))
        lo, hi = (np.append(x, np.nan)[which] for x in poisson_limits(np.asarray(distinct, float), confidence))
        return pd.DataFrame({"lower": lo, "upper": hi})

    return limits(F.bround(count, 0))


def with_poisson_limits(df: DataFrame, count: str, lower: str = "lower", upper: str = "upper", scale: Column | None = None, confidence: float = 0.95) -> DataFrame:
    """Adds the exact limits of a rounded count, times scale (R3); null for negative or missing counts."""
    by = F.lit(1.0) if scale is None else scale
    return df.withColumn("__l_", poisson_limits_of(F.col(count), confidence)).withColumns({lower: F.col("__l_.lower") * by, upper: F.col("__l_.upper") * by}).drop("__l_")


def binomial_limits_of(numerator: Column, denominator: Column, confidence: float = 0.95) -> Column:
    """(lower, upper) of a percentage, in the row; a batch computes each distinct pair once. Null without a denominator."""

    @F.pandas_udf("lower double, upper double")
    def limits(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        ok = (k.notna() & (n > 0)).to_numpy()
        out = np.full((2, len(k)), np.nan)
        if ok.any():
            pairs, which = np.unique(np.stack([k[ok].to_numpy(float), n[ok].to_numpy(float)]), axis=1, return_inverse=True)
            out[:, ok] = np.stack(binomial_limits(pairs[0], pairs[1], confidence))[:, which.reshape(-1)] * 100
        return pd.DataFrame({"lower": out[0], "upper": out[1]})

    n = F.bround(denominator, 0)
    return limits(F.greatest(F.least(F.bround(numerator, 0), n), F.lit(0.0)), n)


def with_binomial_limits(df: DataFrame, numerator: str, denominator: str, lower: str = "lower", upper: str = "upper", confidence: float = 0.95) -> DataFrame:
    """Adds exact limits of a percentage (R4); the numerator is kept within the denominator, null without one."""
    return df.withColumn("__l_", binomial_limits_of(F.col(numerator), F.col(denominator), confidence)).withColumns({lower: F.col("__l_.lower"), upper: F.col("__l_.upper")}).drop("__l_")


@F.pandas_udf(DoubleType())
def chi_square_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    """P(X > statistic) of a chi-square variable."""
    ok = statistic.notna() & (df > 0)
    out = np.full(len(statistic), np.nan)
    if ok.any():
        out[ok] = 1 - gamma_p(df[ok].to_numpy(float) / 2, statistic[ok].to_numpy(float) / 2)
    return pd.Series(out).where(ok, None)


#: The normal quantile of two-sided 95 % limits.
Z95 = 1.959963984540054


def byar_limits(count: Column, z: float = Z95) -> tuple[Column, Column]:
    """Byar's closed form for counts of ten or more."""
    lower = count * F.pow(1 - 1 / (9 * count) - z / (3 * F.sqrt(count)), F.lit(3))
    above = count + 1
    return lower, above * F.pow(1 - 1 / (9 * above) + z / (3 * F.sqrt(above)), F.lit(3))
