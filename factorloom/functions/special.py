"""Special functions as column expressions, so that they stay inside the plan.

Series and continued fractions are folds over a sequence of as many terms as the argument
needs.  All agree with the functions of :mod:`scalars` to nine digits or more; nulls give null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos' approximation of the gamma function with g = 7 and nine terms.
_G = 7.0
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
# A rational start for the normal quantile, good to 4.5e-4.
_TOP, _BOTTOM = (2.515517, 0.802853, 0.010328), (1.0, 1.432788, 0.189269, 0.001308)
_TINY = 1e-300


def _double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def _bound(x: Column, f) -> Column:
    """f of x, which is computed once."""
    return F.transform(F.array(x), f)[0]


def log_gamma(x) -> Column:
    """The logarithm of the gamma function of a positive number."""

    def lanczos(y: Column) -> Column:
        total = F.lit(_LANCZOS[0])
        for n, c in enumerate(_LANCZOS[1:]):
            total = total + c / (y + n)
        t = y + (_G - 0.5)
        return math.log(2 * math.pi) / 2 + (y - 0.5) * F.log(t) - t + F.log(total)

    x = _double(x)
    return _bound(x, lambda y: F.when(y < 0.5, lanczos(y + 1) - F.log(y)).otherwise(lanczos(y)))


def _terms(a: Column) -> Column:
    return F.sequence(F.lit(1), (F.ceil(9 * F.sqrt(a)) + 60).cast("int"))


def _series(a: Column, x: Column) -> Column:
    """Gamma's lower part, less the common factor, by its series."""
    start = F.struct((1 / a).alias("term"), (1 / a).alias("total"))

    def step(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(_terms(a), start, step, lambda s: s["total"])


def _fraction(a: Column, x: Column) -> Column:
    """Gamma's upper part, less the common factor, by its continued fraction."""
    first = 1 / (x + 1 - a)
    start = F.struct(F.lit(1 / _TINY).alias("c"), first.alias("d"), first.alias("h"))
    away = lambda v: F.when(F.abs(v) < _TINY, F.lit(_TINY)).otherwise(v)

    def step(s: Column, n: Column) -> Column:
        an, b = -n * (n - a), x + 1 - a + 2 * n
        c, d = away(b + an / s["c"]), 1 / away(b + an * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(_terms(a), start, step, lambda s: s["h"])


def _parts(a: Column, x: Column, upper: bool) -> Column:
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    low, high = front * _series(a, x), front * _fraction(a, x)
    if upper:
        return F.when(x <= 0, 1.0).when(x < a + 1, 1 - low).otherwise(high)
    return F.when(x <= 0, 0.0).when(x < a + 1, low).otherwise(1 - high)


def gamma_p(a, x) -> Column:
    """The regularised lower incomplete gamma function."""
    return _bound(F.struct(_double(a).alias("a"), _double(x).alias("x")), lambda v: _parts(v["a"], v["x"], False))


def gamma_q(a, x) -> Column:
    """The regularised upper incomplete gamma function."""
    return _bound(F.struct(_double(a).alias("a"), _double(x).alias("x")), lambda v: _parts(v["a"], v["x"], True))


def gamma_cdf(x, shape, scale=1.0) -> Column:
    return gamma_p(shape, _double(x) / _double(scale))


def gamma_pdf(x, shape, scale=1.0) -> Column:
    x, shape, scale = _double(x), _double(shape), _double(scale)
    at_zero = F.when(shape > 1, 0.0).when(shape == 1, 1 / scale).otherwise(float("inf"))
    inside = F.exp((shape - 1) * F.log(x / scale) - x / scale - log_gamma(shape)) / scale
    return F.when(x < 0, 0.0).when(x == 0, at_zero).otherwise(inside)


def gamma_quantile(p, shape, scale=1.0) -> Column:
    """By Newton's steps on the logarithm, from a cube of a normal quantile or, near zero, the series' first term."""
    value = F.struct(_double(p).alias("p"), _double(shape).alias("a"))

    def solved(v: Column) -> Column:
        p, a = v["p"], v["a"]
        cube = F.pow(1 - 1 / (9 * a) + normal_quantile(p) / (3 * F.sqrt(a)), F.lit(3.0)) * a
        small = F.exp((F.log(p) + log_gamma(a + 1)) / a)
        start = F.log(F.when((cube > small) & (cube > 1e-3 * a), cube).otherwise(F.greatest(small, F.lit(_TINY))))

        def step(u: Column, n: Column) -> Column:
            x = F.exp(u)
            slope = F.greatest(F.exp(a * u - x - log_gamma(a)), F.lit(_TINY))
            return u - F.greatest(F.least((_parts(a, x, False) - p) / slope, F.lit(1.0)), F.lit(-1.0))

        return F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step))

    inside = _bound(value, solved)
    p = _double(p)
    known = p.isNotNull() & _double(shape).isNotNull()
    return F.when((p < 0) | (p > 1), F.raise_error(F.lit("p must be in [0, 1]")).cast("double")).when(~known, F.lit(None).cast("double")).when(p == 0, 0.0).when(p == 1, float("inf")).otherwise(inside * _double(scale))


def normal_pdf(x, mean=0.0, sd=1.0) -> Column:
    z = (_double(x) - _double(mean)) / _double(sd)
    return F.exp(-z * z / 2) / (_double(sd) * math.sqrt(2 * math.pi))


def _phi(z: Column) -> Column:
    tail = _parts(F.lit(0.5), z * z / 2, True) / 2
    return F.when(z < 0, tail).otherwise(1 - tail)


def normal_cdf(x, mean=0.0, sd=1.0) -> Column:
    return _bound((_double(x) - _double(mean)) / _double(sd), _phi)


def normal_quantile(p, mean=0.0, sd=1.0) -> Column:
    """By Halley's steps from a rational start, in the lesser tail."""

    def solved(p: Column) -> Column:
        tail = F.least(p, 1 - p)

        def started(t: Column) -> Column:
            poly = lambda c: sum((x * F.pow(t, F.lit(float(n))) for n, x in enumerate(c)), F.lit(0.0))
            return poly(_TOP) / poly(_BOTTOM) - t

        def step(z: Column, n: Column) -> Column:
            e = (_phi(z) - tail) * math.sqrt(2 * math.pi) * F.exp(z * z / 2)
            return z - e / (1 + z * e / 2)

        z = F.aggregate(F.sequence(F.lit(1), F.lit(4)), _bound(F.sqrt(-2 * F.log(tail)), started), step)
        return F.when(p <= 0.5, z).otherwise(-z)

    inside = _bound(_double(p), solved)
    p = _double(p)
    ends = F.when((p < 0) | (p > 1), F.raise_error(F.lit("p must be in [0, 1]")).cast("double")).when(p == 0, float("-inf")).when(p == 1, float("inf"))
    return ends.when(p == 0.5, _double(mean)).otherwise(_double(mean) + inside * _double(sd))


def log_choose(n, k) -> Column:
    n, k = _double(n), _double(k)
    return log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1)


def hypergeometric_tail(overlap, drawn, good, total) -> Column:
    """P(at least ``overlap`` of ``drawn`` from ``total`` of which ``good`` count).

    Terms follow from one another by ratios and are added as logarithms, so that neither
    the first nor the largest can vanish.
    """
    k, d, g, t = (x.cast("long") for x in (overlap, drawn, good, total))
    value = F.struct(F.greatest(k, d + g - t, F.lit(0).cast("long")).alias("lo"), F.least(d, g).alias("hi"), d.alias("d"), g.alias("g"), t.alias("t"))

    def summed(v: Column) -> Column:
        lo, d, g, t = v["lo"], v["d"], v["g"], v["t"]
        first = log_choose(g, lo) + log_choose(t - g, d - lo) - log_choose(t, d)

        def step(s: Column, x: Column) -> Column:
            ratio = ((g - x + 1) * (d - x + 1)).cast("double") / (x * (t - g - d + x))
            log = s["log"] + F.log(ratio)
            top = F.greatest(s["top"], log)
            return F.struct(log.alias("log"), top.alias("top"), (s["sum"] * F.exp(s["top"] - top) + F.exp(log - top)).alias("sum"))

        more = F.when(v["hi"] > lo, F.sequence(lo + 1, v["hi"])).otherwise(F.array().cast("array<bigint>"))
        start = _bound(first, lambda f: F.struct(f.alias("log"), f.alias("top"), F.lit(1.0).alias("sum")))
        return F.when(lo > v["hi"], 0.0).otherwise(F.least(F.lit(1.0), F.aggregate(more, start, step, lambda s: F.exp(s["top"]) * s["sum"])))

    return _bound(value, summed)
