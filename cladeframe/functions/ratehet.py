"""Among-column rate variation: discrete gamma categories (Yang 1994)."""

from __future__ import annotations

import math

import numpy as np


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h


def gamma_quantile(a: float, p: float) -> float:
    """Quantile of Gamma(a, rate 1) by bisection in log space."""
    lo, hi = -700.0, math.log(a + 20 * math.sqrt(a) + 50)
    for _ in range(200):
        mid = (lo + hi) / 2
        if gamma_p(a, math.exp(mid)) < p:
            lo = mid
        else:
            hi = mid
    return math.exp((lo + hi) / 2)


def gamma_rates(alpha: float, k: int, median: bool = False) -> np.ndarray:
    """Rates of ``k`` equally likely categories of Gamma(alpha, alpha), mean 1."""
    if k == 1:
        return np.ones(1)
    if median:
        r = np.array([gamma_quantile(alpha, (2 * i + 1) / (2 * k)) for i in range(k)])
        return r / r.mean()
    cuts = [gamma_quantile(alpha, i / k) for i in range(1, k)]
    cum = np.array([0.0, *[gamma_p(alpha + 1, c) for c in cuts], 1.0])
    return np.maximum(np.diff(cum) * k, 1e-10)
