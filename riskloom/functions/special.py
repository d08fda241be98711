"""Distribution functions that the reports need, on the driver: a few values at a time."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist


def normal_tail(z: float) -> float:
    """P(|Z| > |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's rule."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t."""
    if math.isnan(t):
        return math.nan
    return beta_cdf(df / (df + t * t), df / 2, 0.5)


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) of the chi-square distribution."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


# Fixed values of Royston's approximation (Applied Statistics 44, 1995, algorithm R94); the lowest power first.
LARGEST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_BOUND, SMALL_MEAN, SMALL_SD = (-2.273, 0.459), (0.544, -0.39978, 0.025054, -6.714e-4), (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN, LARGE_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def powers(coefficients: Sequence[float], x: float) -> float:
    return sum(c * x**k for k, c in enumerate(coefficients))


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """(W, its tail probability) of 3 to 5000 values; (1, 1) where all are equal."""
    x = sorted(values)
    n = len(x)
    if not 3 <= n <= 5000:
        raise ValueError("3 to 5000 values")
    mean = math.fsum(x) / n
    spread = math.fsum((v - mean) ** 2 for v in x)
    if x[0] == x[-1] or not spread:
        return 1.0, 1.0
    scores = [normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    length = math.fsum(s * s for s in scores)
    ends = [powers(c, n**-0.5) + scores[-1 - i] / math.sqrt(length) for i, c in enumerate((LARGEST_WEIGHT, SECOND_WEIGHT)[: 2 if n > 5 else 1])]
    if n == 3:
        ends = [math.sqrt(0.5)]
    k = len(ends)
    left = length - 2 * math.fsum(scores[-1 - i] ** 2 for i in range(k))
    shrink = math.sqrt(left / (1 - 2 * math.fsum(a * a for a in ends))) if n > 3 else 1.0
    weights = [-a for a in ends] + [s / shrink for s in scores[k : n - k]] + ends[::-1]
    w = min(1.0, math.fsum(a * v for a, v in zip(weights, x)) ** 2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log1p(-w) if w < 1 else -math.inf
    if n <= 11:
        bound = powers(SMALL_BOUND, n)
        if y >= bound:
            return w, 0.0
        y, mu, sd = -math.log(bound - y), powers(SMALL_MEAN, n), math.exp(powers(SMALL_SD, n))
    else:
        mu, sd = powers(LARGE_MEAN, math.log(n)), math.exp(powers(LARGE_SD, math.log(n)))
    return w, 0.5 * math.erfc((y - mu) / sd / math.sqrt(2))
