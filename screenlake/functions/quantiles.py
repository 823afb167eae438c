"""Quantiles of Student's t and of the Beta distribution, without further libraries.

Small tables of t quantiles go into plans as literals; the Beta inverse runs in an Arrow function over
grouped rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(1e-300, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 5000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = c if abs(c) > 1e-300 else 1e-300
            step = c * d
            total *= step
        if abs(step - 1) < 1e-15:
            break
    return front * total


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        if beta_cdf(mid, a, b) < p:
            low = mid
        else:
            high = mid
        if high - low <= 1e-16 * max(high, 1e-300):
            break
    return (low + high) / 2


def t_quantile(p: float, df: int) -> float:
    """Student's t quantile, by the beta distribution of df / (df + t^2)."""
    if p == 0.5:
        return 0.0
    tail = 2 * min(p, 1 - p)
    x = beta_quantile(tail, df / 2, 0.5)
    t = math.sqrt(df * (1 - x) / x)
    return t if p > 0.5 else -t


def t_critical(df: Column, p: float, most: int = 200) -> Column:
    """t quantiles for any degrees of freedom, null under 1: a literal table up to ``most``, from there on the
    expansion about the normal quantile in powers of 1 / df, whose rest is under 1e-9 there."""
    z = NormalDist().inv_cdf(p)
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    many = sum((F.lit(c) / F.pow(df.cast("double"), F.lit(float(k))) for k, c in enumerate(terms[1:], 1)), F.lit(terms[0]))
    table = F.array(*[F.lit(t_quantile(p, k)) for k in range(1, most + 1)])
    return F.when(df > most, many).when(df >= 1, F.get(table, (df - 1).cast("int")))


def clopper_pearson(x: int, n: int, alpha: float, sided: int = 2) -> tuple[float | None, float | None]:
    """Exact binomial interval; None without trials."""
    if not n:
        return None, None
    tail = alpha / sided
    return (0.0 if x == 0 else beta_quantile(tail, x, n - x + 1)), (1.0 if x == n else beta_quantile(1 - tail, x + 1, n - x))


def with_clopper_pearson(df: DataFrame, x: str, n: str, alpha: float, sided: int = 2) -> DataFrame:
    """Columns ci_low and ci_high.  For grouped rows: one interval per row, by Arrow batches."""

    @F.pandas_udf("low double, high double")
    def interval(xs: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clopper_pearson(int(a), int(b), alpha, sided) for a, b in zip(xs, ns)], columns=["low", "high"], dtype=float)

    return df.withColumn("_ci", interval(F.col(x), F.col(n))).withColumns({"ci_low": F.col("_ci.low"), "ci_high": F.col("_ci.high")}).drop("_ci")


def wilson(x: Column, n: Column, z: float) -> tuple[Column, Column]:
    p, zz = x / n, z * z
    centre, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return centre - half, centre + half
