"""Special functions: ln Γ as a column, and scalar tails for test statistics.

ln Γ is evaluated inside the JVM because the likelihoods call it for every customer;
the tails are needed once per test row and are ordinary functions.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F

HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)
SHIFT = 8
# First Stirling-series terms, B(2k) / (2k (2k-1)).
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
# The rational approximations of algorithm AS 241 (Wichura 1988) for the inverse of the
# normal distribution, numerator and denominator by rising powers: centre, tails, far tails.
NORMAL_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
     45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
     21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
NORMAL_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
     1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
     0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
NORMAL_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
     0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _rational(parts: tuple, x: Column) -> Column:
    def poly(c):
        out = F.lit(c[-1])
        for k in reversed(c[:-1]):
            out = out * x + F.lit(k)
        return out
    return poly(parts[0]) / poly(parts[1])


def inverse_normal(u: Column) -> Column:
    """The normal quantile of 0 < u < 1."""
    q = u - F.lit(0.5)
    t = F.sqrt(-F.ln(F.least(u, F.lit(1.0) - u)))
    tail = F.when(t <= 5.0, _rational(NORMAL_TAIL, t - F.lit(1.6))).otherwise(_rational(NORMAL_FAR, t - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * _rational(NORMAL_CENTRE, F.lit(0.180625) - q * q)).otherwise(
        F.signum(q) * tail)


def ln_gamma(x: Column) -> Column:
    """ln Γ(x) for x > 0: raise the argument by 8, apply Stirling's series, divide out the product."""
    z = x + F.lit(float(SHIFT))
    inv = F.lit(1.0) / z
    inv2 = inv * inv
    tail = F.lit(STIRLING[-1])
    for c in reversed(STIRLING[:-1]):
        tail = tail * inv2 + F.lit(c)
    product = x
    for i in range(1, SHIFT):
        product = product * (x + F.lit(float(i)))
    return ((z - F.lit(0.5)) * F.ln(z) - z + F.lit(HALF_LOG_TWO_PI)
            + tail * inv - F.ln(product))


def gamma_terms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln Γ, its derivative) of an array of positive numbers, by the same shift and series."""
    x = np.asarray(x, dtype=float)
    z = x + SHIFT
    steps = x[..., None] + np.arange(SHIFT)
    powers = z[..., None] ** -(2 * np.arange(len(STIRLING)) + 1)
    value = (z - 0.5) * np.log(z) - z + HALF_LOG_TWO_PI + powers @ np.array(STIRLING) - np.log(steps).sum(axis=-1)
    slope = np.array([-(2 * k + 1) * c for k, c in enumerate(STIRLING)])
    return value, np.log(z) - 0.5 / z + (powers @ slope) / z - (1.0 / steps).sum(axis=-1)


def log_add_exp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def hyp2f1(a, b, c, z, tol: float = 1e-13, max_terms: int = 5_000_000):
    """Gauss 2F1 by its power series on arrays, for 0 <= z < 1; an error if that does not end.

    Only the elements that still change are carried on.
    """
    a, b, c, z = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, c, z)))
    shape = z.shape
    a, b, c, z = (np.ravel(v) for v in (a, b, c, z))
    out, open_ = np.ones(z.shape), np.arange(z.size)
    total, term = np.ones(z.shape), np.ones(z.shape)
    for n in range(max_terms):
        if not open_.size:
            return out.reshape(shape)
        term = term * (a + n) * (b + n) / ((c + n) * (n + 1.0)) * z
        total = total + term
        # What follows is about a geometric series with ratio z: it must be small as a whole.
        done = np.abs(term) <= tol * np.abs(total) * (1.0 - z)
        if n % 16 == 0 and done.any():
            out[open_[done]] = total[done]
            go = ~done
            open_, total, term, a, b, c, z = (v[go] for v in (open_, total, term, a, b, c, z))
    raise ArithmeticError(f"2F1 did not converge in {max_terms} terms")


def _beta_fraction(a: float, b: float, x: float) -> float:
    # Lentz's method for the continued fraction of the incomplete beta function.
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError("the continued fraction did not converge")


def _ln_gamma_ratio(a: float, b: float) -> float:
    """ln Γ(a + b) − ln Γ(a), by Stirling's series where the two would cancel."""
    if a < 1e5 or b > a:
        return math.lgamma(a + b) - math.lgamma(a)
    tail = lambda z: sum(c / z ** (2 * k + 1) for k, c in enumerate(STIRLING))
    return (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + tail(a + b) - tail(a)


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta function I_x(a, b); ``y`` is 1 − x where it is known more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    large, small = max(a, b), min(a, b)
    ln_x = math.log(x) if x < 0.5 else math.log1p(-y)
    ln_y = math.log(y) if y < 0.5 else math.log1p(-x)
    front = math.exp(_ln_gamma_ratio(large, small) - math.lgamma(small) + a * ln_x + b * ln_y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def p_two_sided_t(t: float | None, df: float) -> float | None:
    if t is None or df <= 0:
        return None
    whole = df + t * t
    return beta_inc(df / 2.0, 0.5, df / whole, t * t / whole)


def p_upper_f(f: float | None, d1: float, d2: float) -> float | None:
    if f is None or d2 <= 0:
        return None
    whole = d2 + d1 * f
    return beta_inc(d2 / 2.0, d1 / 2.0, d2 / whole, d1 * f / whole)


def p_two_sided_z(z: float | None) -> float | None:
    return None if z is None else math.erfc(abs(z) / math.sqrt(2.0))


def p_upper_z(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))
