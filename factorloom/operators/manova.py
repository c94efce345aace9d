"""Pillai's test of two coded responses against each pattern, from covariance sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def codes(frame: DataFrame, column: str) -> DataFrame:
    """Values as whole numbers in their sorted order, from 1."""
    levels = frame.select(column).distinct().withColumn("__code", F.row_number().over(Window.orderBy(column)).cast("double"))  # one row per level
    return frame.join(levels, column).withColumn(column, F.col("__code")).drop("__code")


def beta_tail(x: float, a: float, b: float) -> float:
    """P(Beta(a, b) > x), by the continued fraction of the incomplete beta function."""
    import math

    if x <= 0:
        return 1.0
    if x >= 1:
        return 0.0

    def lower(x: float, a: float, b: float) -> float:
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        h = d
        for m in range(1, 500):
            for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + top * d or 1e-300)
                c = 1 + top / c or 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * h

    return 1 - lower(x, a, b) if x < (a + 1) / (a + b + 2) else lower(1 - x, b, a)


def pillai(samples: DataFrame, factor: DataFrame, first: str, second: str) -> DataFrame:
    """k, n, pillai, f, for one predictor (the pattern) and the pair of responses.

    With one degree of freedom the trace is the squared multiple correlation of the
    pattern on the pair: (r1^2 + r2^2 - 2 r1 r2 r12) / (1 - r12^2).  ``samples`` has idx and
    the two numeric responses.
    """
    rows = factor.select("idx", "k", F.col("mean").alias("x")).join(samples, "idx")
    sums = rows.groupBy("k").agg(
        F.count(F.lit(1)).alias("n"), F.corr("x", first).alias("r1"), F.corr("x", second).alias("r2"), F.corr(first, second).alias("r12")
    )
    r1, r2, r12 = F.col("r1"), F.col("r2"), F.col("r12")
    value = sums.withColumn("pillai", (r1 * r1 + r2 * r2 - 2 * r1 * r2 * r12) / F.when(F.abs(r12) < 1, 1 - r12 * r12))
    return value.select("k", "n", "pillai", (F.col("pillai") / F.when(F.col("pillai") < 1, 1 - F.col("pillai")) * (F.col("n") - 3) / 2).alias("f"))


def manova(samples: DataFrame, factor: DataFrame, first: str, second: str) -> DataFrame:
    """Pillai's trace, its F and p for each pattern; the responses are coded from their levels."""
    coded = codes(codes(samples.select("idx", first, second), first), second)
    # the upper tail of a beta distribution whose first parameter is 1 is a power
    p = F.when(F.col("n") > 3, F.pow(1 - F.col("pillai"), (F.col("n") - 3) / 2))
    return pillai(coded, factor, first, second).withColumn("p", p)
