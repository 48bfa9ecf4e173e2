"""p-values for a handful of aggregated rows. Plain maths; no statistics package is needed."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate, combinations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

# Up to so many values in the smaller group, and without ties, the exact distribution is used.
EXACT_GROUP = 8


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def _beta_inc(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return _beta_inc(df / 2.0, 0.5, df / (df + t * t))


@lru_cache(maxsize=EXACT_GROUP)
def _partition_sums(k: int) -> tuple[int, list[int]]:
    """Period of the counts, and for small m the number of partitions of 0..m into parts of at most k."""
    period = math.lcm(*range(1, k + 1))
    counts = [1] + [0] * (period * (k + 2) - 1)
    for part in range(1, k + 1):
        for m in range(part, len(counts)):
            counts[m] += counts[m - part]
    return period, list(accumulate(counts))


def _partitions_up_to(m: int, k: int) -> int:
    """Within a residue of the period the count is a polynomial of degree k, so k + 1 values give all others."""
    period, known = _partition_sums(k)
    if m < 0:
        return 0
    if m < len(known):
        return known[m]
    x, total = m // period, Fraction(0)
    values = [known[m % period + period * j] for j in range(k + 1)]
    for j, v in enumerate(values):
        weight = Fraction(v)
        for i in range(k + 1):
            if i != j:
                weight *= Fraction(x - i, j - i)
        total += weight
    return int(total)


def u_share(u: int, n1: int, n2: int) -> float:
    """Exact share of rank arrangements with a statistic of at most u; n1 is the smaller, small group."""
    total = 0
    for r in range(n1 + 1):
        for chosen in combinations(range(1, n1 + 1), r):
            total += (-1) ** r * _partitions_up_to(u - sum(chosen) - r * n2, n1)
    return float(Fraction(total, math.comb(n1 + n2, n1)))


def mann_whitney_two_sided(u: float, n1: float, n2: float, tie_term: float) -> float:
    """Exact for a small untied group, else normal with tie and continuity correction."""
    if n1 < 1 or n2 < 1 or math.isnan(u):
        return math.nan
    n1, n2 = int(n1), int(n2)
    top = max(u, n1 * n2 - u)
    if min(n1, n2) <= EXACT_GROUP and tie_term == 0:
        return min(1.0, 2.0 * u_share(math.floor(n1 * n2 - top), min(n1, n2), max(n1, n2)))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12.0 * ((n + 1) - tie_term / (n * (n - 1.0))))
    if sd == 0:
        return math.nan
    return min(1.0, math.erfc((top - n1 * n2 / 2.0 - 0.5) / sd / math.sqrt(2.0)))


def _nullable(values) -> pd.Series:
    return pd.Series([None if math.isnan(v) else v for v in values], dtype="object")


def _t_batch(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(float(a), float(b)) if pd.notna(a) and pd.notna(b) else math.nan
                     for a, b in zip(t, df))


def _mann_whitney_batch(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return _nullable(mann_whitney_two_sided(float(a), b, c, float(d)) if pd.notna(a) else math.nan
                     for a, b, c, d in zip(u, n1, n2, ties))


def t_p_value(t: Column | str, df: Column | str) -> Column:
    return F.pandas_udf(_t_batch, DoubleType())(t, df)


def mann_whitney_p(u: Column | str, n1: Column | str, n2: Column | str, tie_term: Column | str) -> Column:
    return F.pandas_udf(_mann_whitney_batch, DoubleType())(u, n1, n2, tie_term)
