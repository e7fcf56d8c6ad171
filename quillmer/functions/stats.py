"""Distances, identities, estimates and p-values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import SketchParams


def distance(common: Column, denom: Column, k: int) -> Column:
    """-ln(2j / (1 + j)) / k for j = common / denom; 0 if all is shared (also nothing of nothing), 1 if nothing is."""
    j = F.try_divide(common.cast("double"), denom.cast("double"))
    return F.when(common == denom, 0.0).when(common == 0, 1.0).otherwise(F.least(F.lit(1.0), -F.ln(2 * j / (1 + j)) / k))


def identity(shared: Column, size: Column, k: int) -> Column:
    return F.when(shared == size, 1.0).when(shared == 0, 0.0).otherwise(F.pow(F.try_divide(shared.cast("double"), size.cast("double")), F.lit(1.0 / k)))


def cardinality(n: Column, largest: Column, params: SketchParams) -> Column:
    """Estimated number of distinct k-mers from a sketch's size and largest hash."""
    return F.lit(2.0**params.hash_bits) * n / (largest.cast("double") + params.hash_offset)


_LOG_FACTORIALS = np.zeros(1)


def log_factorial(n: np.ndarray) -> np.ndarray:
    global _LOG_FACTORIALS
    top = int(n.max(initial=0))
    if top < 1 << 20:
        if top >= len(_LOG_FACTORIALS):
            _LOG_FACTORIALS = np.append(0, np.cumsum(np.log(np.arange(1, 2 * top + 2))))
        return _LOG_FACTORIALS[n]
    return np.array([math.lgamma(x + 1) for x in n])


def binomial_tail(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P[Binomial(n, p) >= x], down to the least positive double: the regularised incomplete beta function I_p(x, n - x + 1)."""
    x, n, p = np.broadcast_arrays(np.asarray(x, np.int64), np.asarray(n, np.int64), np.asarray(p, np.float64))
    out = np.where(x <= 0, 1.0, 0.0)
    out = np.where((x > 0) & (x <= n) & (p >= 1), 1.0, out)
    todo = (x > 0) & (x <= n) & (p > 0) & (p < 1)
    if not todo.any():
        return out
    a, b, q = x[todo].astype(float), (n - x + 1)[todo].astype(float), p[todo]
    with np.errstate(under="ignore", over="ignore", divide="ignore", invalid="ignore"):
        front = log_factorial(n[todo]) - log_factorial(x[todo] - 1) - log_factorial((n - x)[todo]) + a * np.log(q) + b * np.log1p(-q)
        swap = q > (a + 1) / (a + b + 2)  # the fraction converges fast on one side of the mean
        a, b, q = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - q, q)
        value = np.exp(front) * _fraction(a, b, q) / a
    out[todo] = np.clip(np.where(swap, 1 - value, value), 0, 1)
    return out


def _fraction(a: np.ndarray, b: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, evaluated forward by Lentz's rule."""
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    c = np.ones_like(q)
    d = 1 / guard(1 - (a + b) * q / (a + 1))
    h = d.copy()
    for m in range(1, 10_000):
        even = m * (b - m) * q / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * q / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 / guard(1 + term * d)
            c = guard(1 + term / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return h


@F.pandas_udf(T.DoubleType())
def binom_tail(x: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series(binomial_tail(x.to_numpy(), n.to_numpy(), p.to_numpy()))


def chance(length: Column, params: SketchParams) -> Column:
    """Probability that a given k-mer is in a random sequence of this length."""
    return F.when(length > 0, 1 / (1 + F.lit(params.kmer_space) / length)).otherwise(0.0)


def pair_p_value(common: Column, denom: Column, length_a: Column, length_b: Column, params: SketchParams) -> Column:
    """Probability of at least so many shared hashes by chance; 1 when none is shared."""
    pa, pb = chance(length_a, params), chance(length_b, params)
    r = F.try_divide(pa * pb, pa + pb - pa * pb)  # arguments of Python functions are computed for every row
    return F.when(common == 0, 1.0).otherwise(binom_tail(common, denom, F.coalesce(r, F.lit(0.0))))


def within_p_value(shared: Column, size: Column, set_size: Column, params: SketchParams) -> Column:
    """Probability of at least so many of ``size`` hashes in a mixture of ``set_size`` distinct k-mers by chance."""
    return F.when(shared == 0, 1.0).otherwise(binom_tail(shared, size, F.least(F.lit(1.0), set_size / F.lit(params.kmer_space))))


def lower_quantile(s: int, p: float, tail: float) -> int:
    """Smallest x with P[Binomial(s, p) <= x] > tail."""
    low, high = 0, s
    while low < high:
        mid = (low + high) // 2
        if 1 - float(binomial_tail(np.array([mid + 1]), np.array([s]), np.array([p]))[0]) > tail:
            high = mid
        else:
            low = mid + 1
    return low


#: The grid of the error-bound tables.
BOUND_SIZES = (100, 500, 1000, 5000, 10000, 50000, 100000, 500000, 1000000)
BOUND_DISTANCES = (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4)


def bounds(spark: SparkSession, k: int = 21, probability: float = 0.99) -> DataFrame:
    """(mode, sketch_size, distance, bound): by how much an estimate may exceed the distance, within the probability; inf where no hash may be shared."""
    tail, rows = (1 - probability) / 2, []
    for mode in ("distance", "screen"):
        for s in BOUND_SIZES:
            for d in BOUND_DISTANCES:
                share = (1 - d) ** k if mode == "screen" else 1 / (2 * math.exp(k * d) - 1)
                j = lower_quantile(s, share, tail) / s
                if mode == "screen":
                    estimate = 1 - j ** (1 / k)
                else:
                    estimate = -math.log(2 * j / (1 + j)) / k if j else math.inf
                rows.append((mode, s, d, estimate - d))
    return spark.createDataFrame(rows, "mode string, sketch_size long, distance double, bound double")


def register(spark: SparkSession, k: int = 21) -> None:
    """SQL functions ``binom_tail(x, n, p)`` and ``sketch_distance(common, denom, k)``."""
    spark.udf.register("binom_tail", binom_tail)

    @F.pandas_udf(T.DoubleType())
    def sketch_distance(common: pd.Series, denom: pd.Series, size: pd.Series) -> pd.Series:
        j = common / denom
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.minimum(1.0, -np.log(2 * j / (1 + j)) / size)
        return pd.Series(np.where(common == denom, 0.0, np.where(common == 0, 1.0, d)))

    spark.udf.register("sketch_distance", sketch_distance)
