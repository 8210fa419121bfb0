"""Tail probabilities of the normal, t, F and chi-squared distributions.

Scalar helpers for a few dozen test statistics per fitted model.
"""

from __future__ import annotations

import math

_TINY = 1e-300


def _continued_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete-beta continued fraction."""
    c, d = 1.0, 1.0 / _nonzero(1.0 - (a + b) * x / (a + 1.0))
    result = d
    for m in range(1, 10_000):
        step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / _nonzero(1.0 + step * d)
        c = _nonzero(1.0 + step / c)
        result *= c * d
        step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / _nonzero(1.0 + step * d)
        c = _nonzero(1.0 + step / c)
        result *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return result
    raise ArithmeticError(f"no convergence of the incomplete beta function at {a}, {b}, {x}")


def _nonzero(v: float) -> float:
    return v if abs(v) > _TINY else _TINY


def _stirling_rest(a: float) -> float:
    """What Stirling's formula lacks of the log-gamma function, from 16 on."""
    s = 1.0 / (a * a)
    return (1 / 12 - s * (1 / 360 - s * (1 / 1260 - s * (1 / 1680 - s / 1188)))) / a


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)) without the difference of two large numbers."""
    out = 0.0
    while a < 16.0:
        out += math.log(a / (a + b))
        a += 1.0
    out += (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b
    return out + _stirling_rest(a + b) - _stirling_rest(a)


def beta_cdf(x: float, a: float, b: float, rest: float | None = None) -> float:
    """Regularised incomplete beta function; ``rest`` is 1 - x where it is known exactly."""
    y = 1.0 - x if rest is None else rest
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    log_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(_log_gamma_ratio(max(a, b), min(a, b)) - math.lgamma(min(a, b)) + a * log_x + b * log_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _continued_fraction(a, b, x) / a
    return 1.0 - front * _continued_fraction(b, a, y) / b


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def t_two_sided(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_cdf(df / (df + t * t), df / 2.0, 0.5, t * t / (df + t * t))


def f_upper(f: float, df1: float, df2: float) -> float:
    if math.isnan(f) or df1 <= 0 or df2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_cdf(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0, df1 * f / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    """Upper regularised incomplete gamma function at (df/2, x/2)."""
    if x <= 0:
        return 1.0
    a, x = df / 2.0, x / 2.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / _nonzero(b)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / _nonzero(an * d + b)
        c = _nonzero(b + an / c)
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * h
    raise ArithmeticError(f"no convergence of the incomplete gamma function at {df}, {2 * x}")
