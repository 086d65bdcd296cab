"""Normal distribution, scores and intervals as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximation of erf/erfc (Cody, Math. Comp. 23, 1969).
_ERF_SMALL_NUM = [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
                  3.77485237685302021e2, 3.20937758913846947e3]
_ERF_SMALL_DEN = [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
                  2.84423683343917062e3]
_ERFC_MID_NUM = [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
                 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
                 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3]
_ERFC_MID_DEN = [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
                 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
                 3.43936767414372164e3, 1.23033935480374942e3]
_ERFC_TAIL_NUM = [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
                  1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4]
_ERFC_TAIL_DEN = [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
                  6.05183413124413191e-2, 2.33520497626869185e-3]

# Two-sided normal quantiles.
Z_QUANTILES = {50: 0.6744897501960817, 80: 1.2815515655446004, 90: 1.6448536269514722, 95: 1.959963984540054}


def _poly(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def erf(x: Column) -> Column:
    a = F.abs(x)
    sq = a * a
    small = a * _poly(sq, _ERF_SMALL_NUM) / _poly(sq, _ERF_SMALL_DEN)
    mid = 1 - F.exp(-sq) * _poly(a, _ERFC_MID_NUM) / _poly(a, _ERFC_MID_DEN)
    inv = 1 / F.greatest(sq, F.lit(16.0))
    tail = 1 - F.exp(-sq) / F.greatest(a, F.lit(4.0)) * (
        1 / math.sqrt(math.pi) - inv * _poly(inv, _ERFC_TAIL_NUM) / _poly(inv, _ERFC_TAIL_DEN))
    return F.signum(x) * F.when(a <= 0.46875, small).when(a <= 4.0, mid).otherwise(tail)


def normal_cdf(z: Column) -> Column:
    """FN-19."""
    return 0.5 * (1 + erf(z / math.sqrt(2.0)))


def normal_pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi)


def gaussian_crps(actual: Column, mean: Column, sigma: Column) -> Column:
    """FN-20: closed-form CRPS of a normal forecast; the variance has a floor of 1e-6."""
    s = F.greatest(sigma, F.lit(1e-3))
    z = (actual - mean) / s
    return s * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 1 / math.sqrt(math.pi))


def interval(mean: Column, sigma: Column, level: int) -> tuple[Column, Column]:
    """FN-21."""
    half = Z_QUANTILES[level] * sigma
    return mean - half, mean + half
