"""Scalar special functions for p-values, evaluated once on the driver.

Each p-value is an O(1) function of an aggregated statistic, so no
distributed work happens here.  Implementations follow the standard
continued-fraction / series expansions of the regularised incomplete
beta and gamma functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EPS = 1e-15
_TINY = 1e-300


def _betacf(a: float, b: float, x: float) -> float:
    # modified Lentz evaluation of the continued fraction for I_x(a, b)
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 10000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c if abs(1.0 + aa / c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:
        # series for P(a, x)
        ap, s, term = a, 1.0 / a, 1.0 / a
        for _ in range(100000):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                break
        return 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 100000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < _EPS:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h


def t_two_sided_p(t: float, df: float) -> float:
    if df <= 0 or t is None or math.isnan(t):
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def r_p_value(r: float | None, n: int) -> float | None:
    """Two-sided p-value of a correlation coefficient (t with n-2 df)."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1.0:
        return 0.0
    t = r * math.sqrt((n - 2) / (1.0 - r * r))
    return t_two_sided_p(t, n - 2)


def chi2_sf(x: float, dof: float) -> float:
    if dof <= 0:
        return float("nan")
    return gammaincc(dof / 2.0, x / 2.0)


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


# Coefficients of the Acklam rational approximation of the
# inverse standard normal CDF (public algorithm, relative error < 1.2e-9).
_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
      1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
      6.680131188771972e+01, -1.328068155288572e+01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
      -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
      3.754408661907416e+00)
_P_LOW = 0.02425


def _poly(coefs, x):
    acc = coefs[0] if not isinstance(x, Column) else F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def norm_ppf(p: float) -> float:
    if p <= 0.0:
        return -math.inf
    if p >= 1.0:
        return math.inf
    if p < _P_LOW:
        q = math.sqrt(-2 * math.log(p))
        return _poly(_C, q) / (_poly(_D, q) * q + 1)
    if p > 1 - _P_LOW:
        q = math.sqrt(-2 * math.log(1 - p))
        return -_poly(_C, q) / (_poly(_D, q) * q + 1)
    q = p - 0.5
    r = q * q
    return _poly(_A, r) * q / (_poly(_B, r) * r + 1)


def _norm_ppf_parts(p: Column) -> tuple[Column, Column, Column]:
    """The approximation's lower tail, upper tail and middle, as expressions in p."""
    q_low = F.sqrt(-2 * F.log(p))
    q_high = F.sqrt(-2 * F.log(1 - p))
    q = p - 0.5
    r = q * q
    low = _poly(_C, q_low) / (_poly(_D, q_low) * q_low + 1)
    high = -_poly(_C, q_high) / (_poly(_D, q_high) * q_high + 1)
    mid = _poly(_A, r) * q / (_poly(_B, r) * r + 1)
    return low, high, mid


def norm_ppf_col(p: Column) -> Column:
    """The same approximation as a Column expression (stays in codegen)."""
    low, high, mid = _norm_ppf_parts(p)
    return F.when(p < _P_LOW, low).when(p > 1 - _P_LOW, high).otherwise(mid)


def norm_noise(df: DataFrame, u: Column, name: str) -> DataFrame:
    """``norm_ppf_col(u)`` as a column, for a ``u`` that is heavy or counts rows: five evaluations of ``u`` at most instead of one
    wherever the expression names it.  A ``u`` with row ids counts per place, by the rows that come to it: so do these five, once
    for each condition and each part, and give the values that ``norm_ppf_col(u)`` gives."""
    def drawn(part):
        return F.struct(F.lit(part).alias("part"), u.alias("p"))

    low, high, mid = _norm_ppf_parts(F.col("_u.p"))
    return (df.withColumn("_u", F.when(u < _P_LOW, drawn(0)).when(u > 1 - _P_LOW, drawn(1)).otherwise(drawn(2)))
            .withColumn(name, F.when(F.col("_u.part") == 0, low).when(F.col("_u.part") == 1, high).otherwise(mid)).drop("_u"))
