"""Scalar functions as SQL text, which Spark and other engines read alike, and as columns."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _erfc_polynomial() -> tuple[float, ...]:
    """Coefficients, lowest first, of log(erfc(z)) + z^2 - log(t) in u, with t = 2 / (2 + z) scaled to [-1, 1]."""
    low, high = 2 / (2 + 25.5), 1.0

    def g(u: float) -> float:
        t = (u * (high - low) + high + low) / 2
        z = 2 / t - 2
        return math.log(math.erfc(z)) + z * z - math.log(t)

    c = np.polynomial.chebyshev.chebinterpolate(np.vectorize(g), 20)
    return tuple(float(x) for x in np.polynomial.chebyshev.cheb2poly(c))


def normal_cdf_sql(x: str) -> str:
    """SQL for the standard normal distribution function of the SQL expression ``x``."""
    low, high = 2 / (2 + 25.5), 1.0
    z = f"(abs({x}) / 1.4142135623730951e0)"
    t = f"(2e0 / (2e0 + least({z}, 25e0)))"
    u = f"((2e0 * {t} - {high + low!r}e0) / {high - low!r}e0)"
    poly = "0e0"
    for c in reversed(_erfc_polynomial()):
        poly = f"({poly} * __u + {c:.17e})"
    half = f"({t} * exp(-least({z}, 25e0) * least({z}, 25e0) + {poly.replace('__u', u)}) / 2e0)"
    return f"(case when ({x}) >= 0 then 1e0 - {half} else {half} end)"


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function; u is bound once, so that the polynomial is evaluated once."""
    low, high = 2 / (2 + 25.5), 1.0
    z = F.least(F.abs(x) / math.sqrt(2), F.lit(25.0))
    t = 2 / (2 + z)

    def half(s: Column) -> Column:
        poly = F.lit(0.0)
        for c in reversed(_erfc_polynomial()):
            poly = poly * s["u"] + F.lit(c)
        return s["t"] * F.exp(-s["z"] * s["z"] + poly) / 2

    bound = F.array(F.struct(z.alias("z"), t.alias("t"), ((2 * t - (high + low)) / (high - low)).alias("u")))
    tail = F.get(F.transform(bound, half), F.lit(0))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def chi2_3_survival(q: Column) -> Column:
    """The chance that a chi-square variable of 3 degrees exceeds ``q``."""
    root = F.sqrt(F.greatest(q, F.lit(0.0)))
    return 2 * (1 - normal_cdf(root)) + math.sqrt(2 / math.pi) * root * F.exp(-q / 2)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def binary_entropy(p: Column) -> Column:
    """In nats; 0 at both ends."""
    return F.when((p <= 0) | (p >= 1), 0.0).otherwise(-p * F.log(p) - (1 - p) * F.log(1 - p))


def quantised(x: Column, step: float = 1e-6) -> Column:
    """A whole number of steps, ties to even, so that digests don't depend on how an engine prints doubles."""
    return F.bround(x / step, 0).cast("long")


def significant(x: Column, digits: int = 6) -> Column:
    """``x`` to so many significant digits, ties away from zero; null stays null."""
    unit = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.floor(F.abs(x) * unit + 0.5) / unit)


def verdict(p: Column, confidence: float) -> Column:
    """SATISFIED or VIOLATED where the chance is sure enough either way, else UNRESOLVED."""
    return F.when(p >= confidence, "SATISFIED").when(p <= 1 - confidence, "VIOLATED").otherwise("UNRESOLVED")
