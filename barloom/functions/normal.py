"""The normal distribution as column expressions; neither Spark nor SQL engines offer an error function."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rational approximation of the normal CDF by Hart (1968), algorithm 5666, as given by West (2005).
CDF_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
           221.213596169931, 220.206867912376]
CDF_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
           637.333633378831, 793.826512519948, 440.413735824752]

# Acklam's rational approximation of the inverse CDF.
PPF_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
PPF_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0]
PPF_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
PPF_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0]
PPF_LOW = 0.02425

EULER_GAMMA = 0.5772156649015329


def _horner(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def norm_cdf(x: Column) -> Column:
    """P(Z <= x) to about 15 digits."""
    size = F.abs(x)
    bell = F.exp(-size * size / 2)
    centre = bell * _horner(size, CDF_NUM) / _horner(size, CDF_DEN)
    fraction = size + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = size + F.lit(k) / fraction
    outer = bell / fraction / F.lit(math.sqrt(2 * math.pi))
    tail = F.when(size > 37, 0.0).when(size < 7.07106781186547, centre).otherwise(outer)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def norm_ppf(p: Column) -> Column:
    """The inverse of `norm_cdf`; infinite at and beyond 0 and 1."""
    def outer(q: Column) -> Column:
        return _horner(q, PPF_C) / _horner(q, PPF_D)

    centre = p - 0.5
    r = centre * centre
    inside = F.greatest(F.least(p, F.lit(1 - 1e-300)), F.lit(1e-300))
    return (
        F.when(p <= 0, float("-inf")).when(p >= 1, float("inf"))
        .when(p < PPF_LOW, outer(F.sqrt(-2 * F.ln(inside))))
        .when(p > 1 - PPF_LOW, -outer(F.sqrt(-2 * F.ln(F.greatest(1 - p, F.lit(1e-300))))))
        .otherwise(_horner(r, PPF_A) * centre / _horner(r, PPF_B))
    )
