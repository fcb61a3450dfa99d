"""Closed-form tail probabilities and critical values as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz and Stegun 26.2.17, normal distribution function.
NORMAL_P = 0.2316419
NORMAL_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
# MacKinnon (1994), constant, one variable.
ADF_SMALL = (2.1659, 1.4412, 0.038269)
ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_STAR, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
# Kwiatkowski et al. (1992), trend case: statistic, p.
KPSS_TREND = ((0.119, 0.10), (0.146, 0.05), (0.176, 0.025), (0.216, 0.01))
# Fixed value: 97.5 % point of the normal distribution.
Z975 = 1.959963985


def poly(x: Column, coefs) -> Column:
    out = F.lit(float(coefs[-1]))
    for c in reversed(coefs[:-1]):
        out = out * x + float(c)
    return out


def normal_cdf(z: Column) -> Column:
    k = 1.0 / (1.0 + NORMAL_P * F.abs(z))
    upper = F.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi) * k * poly(k, NORMAL_B)
    return F.when(z >= 0, 1.0 - upper).otherwise(upper)


def adf_p(tau: Column) -> Column:
    z = F.when(tau <= ADF_STAR, poly(tau, ADF_SMALL)).otherwise(poly(tau, ADF_LARGE))
    return F.when(tau > ADF_MAX, 1.0).when(tau < ADF_MIN, 0.0).otherwise(normal_cdf(z))


def kpss_p(stat: Column) -> Column:
    out = F.when(stat <= KPSS_TREND[0][0], KPSS_TREND[0][1])
    for (a, pa), (b, pb) in zip(KPSS_TREND, KPSS_TREND[1:]):
        out = out.when(stat <= b, pa + (stat - a) / (b - a) * (pb - pa))
    return out.otherwise(KPSS_TREND[-1][1])


def chi2_even_tail(q: Column, dof: int) -> Column:
    """P(chi-square > q) for an even number of degrees of freedom."""
    if dof % 2:
        raise ValueError("closed form needs an even number of degrees of freedom")
    h = q / 2.0
    return F.exp(-h) * poly(h, [1.0 / math.factorial(i) for i in range(dof // 2)])


def t_critical(nu: Column) -> Column:
    """Two-sided 5 % point of Student's t by the Cornish-Fisher expansion."""
    z = Z975
    return (
        F.lit(z)
        + (z**3 + z) / 4 / nu
        + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / (nu * nu)
        + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / (nu * nu * nu)
    )
