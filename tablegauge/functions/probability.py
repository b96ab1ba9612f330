"""Tail probabilities and interval formulas on per-group result rows.

The closed forms are column expressions. The chi-square and Fisher tails have no
built-in function; they run as Arrow UDFs over result rows (one row per feature
or per contrast), never over data rows.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Executors get these functions with the job and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Z95 = 1.959963984540054  # two-sided 95% normal quantile


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson score bounds; (0, 0) where n is 0."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    z2 = Z95 * Z95
    scale = 1 + F.try_divide(F.lit(z2), n)
    center = p + F.try_divide(F.lit(z2 / 2), n)
    spread = Z95 * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2 / 4), n * n))
    low = F.greatest(F.lit(0.0), (center - spread) / scale)
    high = F.least(F.lit(1.0), (center + spread) / scale)
    empty = n <= 0
    return F.when(empty, 0.0).otherwise(low), F.when(empty, 0.0).otherwise(high)


def newcombe(k1: Column, n1: Column, k2: Column, n2: Column) -> tuple[Column, Column]:
    """Newcombe hybrid-score bounds for p1 - p2; (-1, 1) where a side is empty."""
    low1, high1 = wilson(k1, n1)
    low2, high2 = wilson(k2, n2)
    p1 = F.try_divide(k1.cast("double"), n1.cast("double"))
    p2 = F.try_divide(k2.cast("double"), n2.cast("double"))
    below = p1 - p2 - F.sqrt(F.pow(p1 - low1, 2.0) + F.pow(high2 - p2, 2.0))
    above = p1 - p2 + F.sqrt(F.pow(high1 - p1, 2.0) + F.pow(p2 - low2, 2.0))
    empty = (n1 <= 0) | (n2 <= 0)
    return (
        F.when(empty, -1.0).otherwise(F.greatest(F.lit(-1.0), below)),
        F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), above)),
    )


def kolmogorov_tail(lam: Column) -> Column:
    """P(K > lam): the theta series below 1, the alternating series from 1 on."""
    terms = F.sequence(F.lit(1), F.lit(100))
    zero = F.lit(0.0)
    theta = F.aggregate(
        terms,
        zero,
        lambda s, k: s + F.exp(-F.pow(2.0 * k - 1.0, 2.0) * F.lit(math.pi**2 / 8) / (lam * lam)),
    )
    alternating = F.aggregate(
        terms,
        zero,
        lambda s, k: s
        + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * F.pow(k * lam, 2.0)),
    )
    p = F.when(lam <= 0, 1.0).when(
        lam < 1, 1.0 - F.lit(math.sqrt(2 * math.pi)) / lam * theta
    ).otherwise(2.0 * alternating)
    return F.greatest(zero, F.least(F.lit(1.0), p))


def _log_terms(first: float, count: int, x: float) -> np.ndarray:
    """Logs of x^s e^-x / Gamma(s + 1) for s = first, first + 1, ..."""
    start = first * math.log(x) - x - math.lgamma(first + 1)
    steps = math.log(x) - np.log(first + np.arange(1, count))
    return start + np.concatenate(([0.0], np.cumsum(steps)))


def _chi_square_tail(stat: float, dof: float) -> float:
    # With whole degrees of freedom the tail is a finite sum of Poisson-like terms,
    # plus erfc when dof is odd. Only terms near s = x carry weight.
    if stat is None or dof is None or math.isnan(stat) or math.isnan(dof):
        return float("nan")
    if stat <= 0 or dof < 1:
        return 1.0
    x, dof = stat / 2.0, int(dof)
    tail = math.erfc(math.sqrt(x)) if dof % 2 else 0.0
    first, last = (0.5 if dof % 2 else 0.0), dof / 2.0 - 1.0
    reach = 60.0 * math.sqrt(x) + 200.0
    low = max(first, first + math.floor(x - reach))
    high = min(last, first + math.ceil(x + reach))
    if high >= low:
        tail += float(np.exp(_log_terms(low, int(round(high - low)) + 1, x)).sum())
    elif last < low:
        tail += 0.0
    return min(1.0, max(0.0, tail))


@pandas_udf(T.DoubleType())
def chi_square_tail(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X > stat) for a chi-square variable with ``dof`` degrees of freedom."""
    return pd.Series([_chi_square_tail(s, d) for s, d in zip(stat, dof)], dtype="float64")


def normal_two_sided(z: Column) -> Column:
    """Two-sided normal tail, as the one-degree chi-square tail of z squared."""
    return chi_square_tail(z * z, F.lit(1.0))


def _fisher(k1: float, n1: float, k2: float, n2: float) -> float:
    # NULL cells arrive as NaN
    if any(v is None or v != v for v in (k1, n1, k2, n2)):
        return float("nan")
    k1, n1, k2, n2 = int(k1), int(n1), int(k2), int(n2)
    if n1 <= 0 or n2 <= 0:
        return 1.0
    hits, total = k1 + k2, n1 + n2
    low, high = max(0, hits - n2), min(n1, hits)
    mean = n1 * hits / total
    spread = math.sqrt(max(mean * (1 - hits / total) * (n2 / max(total - 1, 1)), 1.0))
    # Tables further than 60 deviations from both the mean and k1 add nothing.
    low = max(low, min(k1, int(mean - 60 * spread)) - 1)
    high = min(high, max(k1, int(mean + 60 * spread)) + 1)
    xs = np.arange(low, high, dtype="float64")
    steps = (
        np.log(n1 - xs) + np.log(hits - xs) - np.log(xs + 1) - np.log(n2 - hits + xs + 1)
    )
    logs = np.concatenate(([0.0], np.cumsum(steps)))
    weights = np.exp(logs - logs.max())
    # Ties with the observed table count; 1e-9 in logs absorbs rounding.
    as_unlikely = logs <= logs[k1 - low] + 1e-9
    return float(min(1.0, weights[as_unlikely].sum() / weights.sum()))


@pandas_udf(T.DoubleType())
def fisher_two_sided(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided Fisher exact p of k1 of n1 against k2 of n2."""
    return pd.Series([_fisher(*v) for v in zip(k1, n1, k2, n2)], dtype="float64")
