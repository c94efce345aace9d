import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factorloom.functions import scalars, special
from factorloom.operators import genesets


def values(spark, rows, schema, made):
    df = spark.createDataFrame(rows, schema).select("*", made.alias("made"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    return df.collect()


def near(got, want, digits=9):
    return got == want or abs(got - want) <= 10**-digits * max(1e-30, abs(want))


def test_log_gamma(spark):
    for r in values(spark, [(x,) for x in (1e-6, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 12345.6)], "x double", special.log_gamma(F.col("x"))):
        assert abs(r.made - math.lgamma(r.x)) < 1e-9 * max(1, abs(math.lgamma(r.x)))


def test_incomplete_gamma(spark):
    rows = [(x, a, s) for a in (0.3, 1.0, 2.0, 40.0, 5000.0) for x in (-1.0, 0.0, 1e-3, 0.5 * a, a, a + 1, 1.3 * a, 4 * a) for s in (1.0, 2.5)]
    x, a, s = (F.col(c) for c in "xas")
    for r in values(spark, rows, "x double, a double, s double", F.struct(special.gamma_cdf(x, a, s).alias("cdf"), special.gamma_pdf(x, a, s).alias("pdf"))):
        assert abs(r.made.cdf - scalars.gamma_cdf(r.x, r.a, r.s)) < 1e-10
        assert near(r.made.pdf, scalars.gamma_pdf(r.x, r.a, r.s))


def test_gamma_quantiles(spark):
    rows = [(p, a) for a in (0.3, 1.0, 2.0, 40.0) for p in (0.0, 1e-9, 0.01, 0.3, 0.5, 0.9, 0.9999, 1.0)]
    for r in values(spark, rows, "p double, a double", special.gamma_quantile(F.col("p"), F.col("a"), 3.0)):
        assert near(r.made, scalars.gamma_quantile(r.p, r.a, 3.0), 8), r


def test_normal(spark):
    rows = [(z,) for z in (-30.0, -8.0, -3.1, -1.0, -0.2, 0.0, 1e-9, 0.7, 2.0, 6.0, 9.0)]
    made = F.struct(special.normal_cdf(F.col("z"), 0.5, 2.0).alias("cdf"), special.normal_pdf(F.col("z"), 0.5, 2.0).alias("pdf"))
    for r in values(spark, rows, "z double", made):
        assert near(r.made.cdf, scalars.normal_cdf(r.z, 0.5, 2.0)) and near(r.made.pdf, scalars.normal_pdf(r.z, 0.5, 2.0))
    rows = [(p,) for p in (0.0, 1e-200, 1e-12, 0.001, 0.3, 0.5, 0.50001, 0.9, 1 - 1e-12, 1.0)]
    for r in values(spark, rows, "p double", special.normal_quantile(F.col("p"))):
        assert near(r.made, scalars.normal_quantile(r.p)), r
    with pytest.raises(PySparkException):
        spark.range(1).select(special.normal_quantile(F.lit(1.5))).collect()


def test_hypergeometric_tail(spark):
    rows = [(k, d, g, t) for t in (10, 60, 20_000) for g in (1, 5, t // 3) for d in (1, 4, t // 2) for k in (0, 1, 3, min(d, g) // 2, min(d, g), min(d, g) + 1)]
    names = ("k", "d", "g", "t")
    for r in values(spark, rows, "k long, d long, g long, t long", special.hypergeometric_tail(*map(F.col, names))):
        want = genesets.hypergeometric_tail(r.k, r.d, r.g, r.t)
        assert near(r.made, want, 7) or r.made < 1e-280 and want < 1e-280, r


def test_nulls(spark):
    row = spark.range(1).select(special.normal_cdf(F.lit(None)), special.gamma_cdf(F.lit(None), 2.0), special.log_gamma(F.lit(None)), special.gamma_quantile(F.lit(None), 2.0), special.normal_quantile(F.lit(None))).first()
    assert set(row) == {None}
