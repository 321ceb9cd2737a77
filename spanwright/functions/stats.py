"""Statistics: column builders, and the survival function of chi-square for the few rows that need it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mean_or_zero(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    """Standard score; without spread 0 for the mean itself and 10 or -10 for all else."""
    near = F.abs(value - mean) <= F.greatest(1e-9 * F.greatest(F.abs(value), F.abs(mean)), F.lit(1e-9))
    flat = F.when(near, 0.0).when(value > mean, 10.0).otherwise(-10.0)
    return F.when(std <= 1e-12, flat).otherwise((value - mean) / F.nullif(std, F.lit(0.0)))


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series of the lower part
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    # continued fraction, evaluated from the far end
    value = 0.0
    for k in range(400, 0, -1):
        value = k * (k - a) / (x + 2 * k + 1 - a - value)
    return scale / (x + 1 - a - value)


@F.pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, df: pd.Series) -> pd.Series:
    """Probability that chi-square with ``df`` degrees exceeds ``stat``; for tables with a row a day, not for hot paths."""
    return pd.Series([None if pd.isna(s) or not d > 0 else upper_gamma(d / 2, s / 2) for s, d in zip(stat, df, strict=True)], dtype="float64")
