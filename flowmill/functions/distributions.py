"""Small reference distributions, generated from their definitions.

Both tables depend on parameters only, never on data: t quantiles by degrees of
freedom and the null distribution of the signed-rank statistic for small samples.
"""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TABLE_DF = 100
EXACT_MAX_PAIRS = 25


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for coefficient in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + coefficient * d
            c = 1.0 + coefficient / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return front * h


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * _incomplete_beta(df / 2.0, 0.5, df / (df + x * x))
    return 1.0 - tail if x >= 0 else tail


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: int) -> float:
    lo, hi = 0.0, 1.0
    while t_cdf(hi, df) < p:
        hi *= 2.0
    while hi - lo > 1e-14 * hi:
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2.0


def t_quantile_column(df: Column, p: float = 0.975) -> Column:
    """t quantile by degrees of freedom; null below 1.

    A literal array covers small samples; beyond it the expansion around the normal
    quantile is accurate to better than 1e-9.
    """
    table = [t_quantile(p, k) for k in range(1, _TABLE_DF + 1)]
    z = _normal_quantile(p)
    n = df.cast("double")
    # Coefficients of the Cornish-Fisher expansion of the t quantile.
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    far = F.lit(z) + F.lit(g1) / n + F.lit(g2) / n**2 + F.lit(g3) / n**3 + F.lit(g4) / n**4
    return F.when(df.between(1, _TABLE_DF), F.get(F.lit(table), (df - 1).cast("int"))).when(
        df > _TABLE_DF, far
    )


def _normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < p else (lo, mid)
    return (lo + hi) / 2.0


@lru_cache(maxsize=64)
def signed_rank_p_values(n: int) -> list[float]:
    """Two-sided exact p for W = 0, 1, ..., n(n+1)/2 without ties."""
    ways = [1]
    for rank in range(1, n + 1):
        longer = ways + [0] * rank
        for w, count in enumerate(ways):
            longer[w + rank] += count
        ways = longer
    out, cumulative = [], 0
    for count in ways:
        cumulative += count
        out.append(min(1.0, 2.0 * cumulative / 2.0**n))
    return out


def signed_rank_p(n: Column, w: Column) -> Column:
    """Exact two-sided p of the smaller rank sum ``w`` for 1 <= n <= EXACT_MAX_PAIRS."""
    flat: list[float] = []
    starts: list[int] = [0]
    for k in range(1, EXACT_MAX_PAIRS + 1):
        starts.append(len(flat))
        flat += signed_rank_p_values(k)
    at = F.get(F.lit(starts), n.cast("int")) + w.cast("int")
    return F.get(F.lit(flat), at)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|); Spark has no complementary error function."""
    return z.map(lambda v: None if v is None or v != v else math.erfc(abs(v) / math.sqrt(2.0)))
