"""Scalar functions: distributions, small vector kernels, and SQL expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_pdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    z = (x - mean) / sd
    return math.exp(-z * z / 2) / (sd * math.sqrt(2 * math.pi))


def normal_cdf(x: float, mean: float = 0.0, sd: float = 1.0) -> float:
    return 0.5 * math.erfc((mean - x) / (sd * math.sqrt(2)))


def normal_quantile(p: float, mean: float = 0.0, sd: float = 1.0) -> float:
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    if p in (0.0, 1.0):
        return math.copysign(math.inf, p - 0.5)
    from statistics import NormalDist

    return NormalDist(mean, sd).inv_cdf(p)


def gamma_pdf(x: float, shape: float, scale: float = 1.0) -> float:
    if x < 0 or (x == 0 and shape > 1):
        return 0.0
    if x == 0:
        return 1 / scale if shape == 1 else math.inf
    return math.exp((shape - 1) * math.log(x / scale) - x / scale - math.lgamma(shape)) / scale


def gamma_cdf(x: float, shape: float, scale: float = 1.0) -> float:
    """The regularised lower incomplete gamma function: its series, or its continued fraction."""
    x = x / scale
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1 / shape
        n = shape
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b = x + 1 - shape
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 500):
        a = -i * (i - shape)
        b += 2
        d = 1 / (a * d + b or 1e-300)
        c = b + a / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - front * h


def gamma_quantile(p: float, shape: float, scale: float = 1.0) -> float:
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    if p == 0:
        return 0.0
    if p == 1:
        return math.inf
    low, high = 0.0, max(shape, 1.0)
    while gamma_cdf(high, shape) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if gamma_cdf(middle, shape) < p else (low, middle)
    return (low + high) / 2 * scale


def udf(function: Callable[..., float]) -> Callable[..., Column]:
    """A vectorised column function of one of the functions above; nulls give null."""

    @F.pandas_udf(DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in zip(*columns, strict=True)], dtype="float64")

    return run


lgamma = math.lgamma

# --- vectors -----------------------------------------------------------------


def which_max(v: np.ndarray) -> int:
    """The first place of the largest value."""
    return int(np.argmax(v))


def is_zero(v: np.ndarray) -> bool:
    return not np.any(v)


def dot_difference(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    """a . (b - c)"""
    return float(a @ (b - c))


# --- columns -----------------------------------------------------------------


def place_of_max(v: Column) -> Column:
    """The first place, from 0, of the largest value of an array."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def all_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def dot_difference_of(a: Column, b: Column, c: Column) -> Column:
    """a . (b - c) of arrays."""
    terms = F.zip_with(a, F.zip_with(b, c, lambda x, y: x - y), lambda x, y: x * y)
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def clock(seconds: Column) -> Column:
    """Whole seconds as hh:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def default_sigma(value: Column) -> Column:
    return F.greatest(0.1 * value, F.lit(0.1))


def z_score(mean: Column, sd: Column) -> Column:
    return mean / F.when(sd == 0, F.lit(1e-6)).otherwise(sd)


def one_hot(n: int, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.when(x == k, 1.0).otherwise(0.0))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def neg_log10(p: Column) -> Column:
    return -10 * F.log10(p)


def hours(seconds: float) -> str:
    s = int(seconds)
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"


def percent_complete(done: int, total: int, atoms: float) -> float:
    """Share of the work done, when an iteration costs as much as there are atoms and these
    grow with the logarithm of the iteration (Stirling's sum)."""
    work = lambda n: n * math.log(n + 1) + atoms * n
    return 100.0 if total <= 0 else min(100.0, 100 * work(done) / work(total))


#: The characters that names and values are trimmed of.
TRIM = ' \r\n"'


def trimmed(column: Column) -> Column:
    return F.btrim(column, F.lit(TRIM))
