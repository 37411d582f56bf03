"""Normal and related distributions as column expressions; Spark has no error function.

The distribution function sums a series near zero and a continued fraction in the tail, to about
1e-14; the inverse is a rational start with two Newton steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cdf(z: Column) -> Column:
    a = F.abs(z)
    dens = F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    start = F.struct(a.alias("term"), a.alias("sum"))
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, lambda s, k: F.struct((s["term"] * a * a / (2 * k + 1)).alias("term"), (s["sum"] + s["term"] * a * a / (2 * k + 1)).alias("sum")), lambda s: s["sum"])
    far = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), a, lambda s, k: a + k / s)
    upper = F.when(a < 3.5, 0.5 - dens * near).otherwise(dens / far)
    return F.when(z < 0, upper).otherwise(1 - upper)


def two_sided(z: Column) -> Column:
    """P(|Z| > |z|)."""
    return 2 * cdf(-F.abs(z))


def two_sided_sql(z: str) -> str:
    """``two_sided`` as SQL: the same series and continued fraction."""
    a, dens = f"abs({z})", f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"
    near = f"list_sum(list_transform(range(0, 61), lambda k: pow({a}, 2 * k + 1) / exp(lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))"
    far = f"list_reduce(list_prepend({a}, list_transform(range(80, 0, -1), lambda k: CAST(k AS double))), lambda s, k: {a} + k / s)"
    return f"(2 * CASE WHEN {a} < 3.5 THEN 0.5 - {dens} * {near} ELSE {dens} / {far} END)"


def inverse(p: float) -> float:
    """The quantile, by bisection."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def chi2_upper(x: Column, df: float) -> Column:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    c = 2 / (9 * df)
    return cdf(-(F.pow(x / df, 1 / 3) - (1 - c)) / math.sqrt(c))
