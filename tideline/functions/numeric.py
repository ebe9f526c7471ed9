"""Distribution functions as Column expressions (no UDF), accurate to about 1e-12."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions.frames import Col, col


def let(x: Col, body: Callable[[Column], Column]) -> Column:
    """Bind ``x`` once: the body sees a lambda variable, so a large input is not copied into it."""
    return F.element_at(F.transform(F.array(col(x).cast("double")), body), 1)


def norm_pdf(x: Col) -> Column:
    return F.exp(-col(x) * col(x) / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Col) -> Column:
    """Standard normal CDF, accurate to about 1e-12.

    |x| < 3: Phi = 1/2 + pdf(x) * sum x^(2k+1)/(2k+1)!!, as a Horner form of fixed depth.
    |x| >= 3: Mills-ratio continued fraction of fixed depth.
    """

    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))

    def centre(z: Column) -> Column:
        series = F.aggregate(
            down(45), F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * z * z / (2 * k + 1)
        )
        return norm_pdf(z) * z * series

    def tail(z: Column) -> Column:
        return norm_pdf(z) / F.aggregate(down(60), z, lambda acc, k: z + k / acc)

    def signed(v: Column) -> Column:
        upper_tail = F.when(F.abs(v) < 3.0, F.lit(0.5) - centre(F.abs(v))).otherwise(tail(F.abs(v)))
        return let(upper_tail, lambda u: F.when(v >= 0, 1.0 - u).otherwise(u))

    return let(x, signed)


def norm_sf2(t: Col) -> Column:
    """Two-sided normal p-value."""
    return F.lit(2.0) * norm_cdf(-F.abs(col(t)))


# Rational approximation of the normal quantile (P. J. Acklam, public domain).
_ICDF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
           1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_ICDF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
           6.680131188771972e01, -1.328068155288572e01)
_ICDF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
           -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_ICDF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
           3.754408661907416e00)


def _poly(coefs: tuple[float, ...], x: Column) -> Column:
    acc: Column = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def norm_ppf(p: Col) -> Column:
    """Normal quantile: rational start value plus one Newton step on the CDF; NULL outside (0, 1)."""

    def start(q: Column) -> Column:
        tail = let(
            F.sqrt(-2 * F.log(F.least(q, 1 - q))),
            lambda r: _poly(_ICDF_C, r) / (_poly(_ICDF_D, r) * r + 1),
        )
        mid = let(
            q - 0.5,
            lambda c: _poly(_ICDF_A, c * c) * c / (_poly(_ICDF_B, c * c) * c * c + 1),
        )
        return F.when(q < 0.02425, tail).when(q > 1 - 0.02425, -tail).otherwise(mid)

    def refined(q: Column) -> Column:
        return let(start(q), lambda x: x - (norm_cdf(x) - q) / norm_pdf(x))

    inside = F.when((col(p) > 0) & (col(p) < 1), col(p).cast("double"))
    return F.when(inside.isNotNull(), let(inside, refined))


def norm_ppf_value(p: float) -> float:
    """Driver-side quantile of a literal probability."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def chi2_sf(x: Col, df: int) -> Column:
    """Upper tail of chi-square with an integer number of degrees of freedom (finite sums)."""
    v = F.greatest(col(x).cast("double"), F.lit(0.0))
    h = v / 2
    if df % 2 == 0:
        term: Column = F.lit(1.0)
        total: Column = F.lit(1.0)
        for k in range(1, df // 2):
            term = term * h / k
            total = total + term
        return F.exp(-h) * total
    total = norm_sf2(F.sqrt(v))
    term = F.exp(-h) * F.sqrt(h) / math.gamma(1.5)
    for k in range(1, (df + 1) // 2):
        total = total + term
        term = term * h / (k + 0.5)
    return total


def product(x: Col) -> Column:
    """Aggregate product of positive factors as exp(sum(ln)); a non-positive factor gives 0 or NULL."""
    c = col(x)
    any_bad = F.min(c) <= 0
    return F.when(any_bad, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(c > 0, F.log(c)))))
