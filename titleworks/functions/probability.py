"""Tail probabilities for small result tables (one row per test or group).

Public formulas: continued fractions for the incomplete gamma and beta functions, and deviances with Stirling
corrections for what stands before them, as differences of log-gammas would lose digits with growing sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TINY = 1e-300


def _steps(size: float) -> int:
    """Steps that a fraction or series with parameters of this size may take; they converge in a few square roots of it."""
    return 1_000 + 50 * math.isqrt(int(abs(size)) + 1)


def _fraction(step, start: float, most: int) -> float:  # noqa: ANN001
    """Evaluate a continued fraction a1/(b1+a2/(b2+...)) by the modified Lentz method."""
    value = c = start or _TINY
    d = 0.0
    for i in range(1, most):
        a, b = step(i)
        d = 1.0 / ((b + a * d) or _TINY)
        c = (b + a / c) or _TINY
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"a continued fraction did not settle in {most} steps")


def _stirling_rest(z: float) -> float:
    """log(z!) less Stirling's (z + 1/2) log z - z + log(2 pi) / 2."""
    if z < 15.0:
        return math.lgamma(z + 1.0) - (z + 0.5) * math.log(z) + z - 0.5 * math.log(2.0 * math.pi)
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def _deviance(seen: float, expected: float) -> float:
    """seen log(seen / expected) + expected - seen, also where both are nearly equal."""
    gap = seen - expected
    if abs(gap) >= 0.1 * (seen + expected):
        return seen * math.log(seen / expected) - gap
    v = gap / (seen + expected)
    total, power = gap * v, 2.0 * seen * v
    for j in range(3, 400, 2):
        power *= v * v
        last, total = total, total + power / j
        if total == last:
            break
    return total


def beta_front(x: float, y: float, a: float, b: float) -> float:
    """x^a y^b / B(a, b), with y = 1 - x."""
    n = a + b
    rest = _stirling_rest(n) - _stirling_rest(a) - _stirling_rest(b) - _deviance(a, n * x) - _deviance(b, n * y)
    return math.sqrt(a / n * b / (2.0 * math.pi)) * math.exp(rest)


def gamma_front(h: float, a: float) -> float:
    """h^a e^-h / Gamma(a)."""
    return math.sqrt(a / (2.0 * math.pi)) * math.exp(-_stirling_rest(a) - _deviance(a, h))


def beta_cdf(x: float, a: float, b: float, y: float | None = None) -> float:
    """Regularised incomplete beta function; y is 1 - x, where that is known better than x tells."""
    y = 1.0 - x if y is None else y
    if x <= 0.0 or y <= 0.0:
        return float(y <= 0.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_cdf(y, b, a, x)

    def step(i: int) -> tuple[float, float]:
        m = i // 2
        if i % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0

    return beta_front(x, y, a, b) / (a * _fraction(step, 1.0, _steps(a + b)))


def chi2_tail(x: float, df: float) -> float:
    """P(chi squared with df degrees of freedom >= x)."""
    a, half = df / 2.0, x / 2.0
    if half <= 0.0:
        return 1.0
    if half < a + 1.0:
        term = total = 1.0 / a
        for i in range(1, _steps(a)):
            term *= half / (a + i)
            total += term
            if term < total * 1e-16:
                return 1.0 - gamma_front(half, a) * total
        raise ArithmeticError(f"a series for {df} degrees of freedom did not settle")

    def step(i: int) -> tuple[float, float]:
        return -i * (i - a), half + 2 * i + 1 - a

    return gamma_front(half, a) / _fraction(step, half + 1.0 - a, _steps(a))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def median_rank(n: int, middle: int, share: float) -> int:
    """The rank k at which the bootstrap median's distribution reaches `share`.

    A resample's `middle`-th value is at most the k-th value of the data when at least `middle`
    of its n draws fall in the first k, so its distribution is binomial: no draws are needed.
    """
    z = -1.959963984540054 if share < 0.5 else 1.959963984540054
    guess = min(max(math.ceil(middle + z * math.sqrt(n) / 2.0), 1), n)
    reaches = lambda k: beta_cdf(k / n, middle, n - middle + 1, (n - k) / n) >= share
    low, high = max(1, guess - 8), min(n, guess + 8)
    while low > 1 and reaches(low - 1):
        low = max(1, low - 32)
    while high < n and not reaches(high):
        high = min(n, high + 32)
    while low < high:
        k = (low + high) // 2
        low, high = (low, k) if reaches(k) else (k + 1, high)
    return low


@F.pandas_udf(T.DoubleType())
def rank_test_p(test: pd.Series, statistic: pd.Series, n: pd.Series, groups: pd.Series) -> pd.Series:
    """p of a Spearman (rho) or Kruskal-Wallis (H) row; null when it has no statistic."""

    def one(kind: str, value: float, rows: float, k: float) -> float:
        if value is None or math.isnan(value):
            return np.nan
        if kind == "kruskal":
            return chi2_tail(value, k - 1.0)
        if rows < 3:
            return np.nan
        spread = max((1.0 - value) * (1.0 + value), 0.0)
        return 0.0 if spread == 0.0 else t_two_sided(value * math.sqrt((rows - 2.0) / spread), rows - 2.0)

    return pd.Series([one(*row) for row in zip(test, statistic, n, groups, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def interval_ranks(n: pd.Series) -> pd.Series:
    """Ranks (low, low', high, high') whose means bound the middle 95 % of bootstrap medians."""

    def one(rows: int) -> list[int]:
        middles = ((rows + 1) // 2, rows // 2 + 1)
        return [median_rank(int(rows), m, share) for share in (0.025, 0.975) for m in middles]

    return n.map(one)


def resample_medians(resamples: int, seed: int):  # noqa: ANN201
    """A function of (key, scores, counts) that gives the medians of `resamples` resamples of those cells.

    How often a resample holds each score is drawn cell by cell from the binomial that the cells before leave over,
    with a generator seeded by (seed, key, resample), so the result does not depend on how rows are laid out.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def medians(key: pd.Series, scores: pd.Series, counts: pd.Series) -> pd.Series:
        def one(k: int, values: np.ndarray, sizes: np.ndarray) -> list[float]:
            values, sizes = np.asarray(values, "float64"), np.asarray(sizes, "int64")
            n = int(sizes.sum())
            low, high = (n + 1) // 2, n // 2 + 1
            found = []
            for i in range(resamples):
                draws = np.random.default_rng([seed, k % (1 << 64), i]).multinomial(n, sizes / n).cumsum()
                found.append(float(values[np.searchsorted(draws, low)] + values[np.searchsorted(draws, high)]) / 2.0)
            return found

        return pd.Series([one(*row) for row in zip(key, scores, counts, strict=True)])

    return medians
