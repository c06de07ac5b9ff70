"""Distribution functions in plain Python: regularised incomplete beta and gamma, normal, and the studentised range."""

from __future__ import annotations

import math

import numpy as np


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by Lentz's continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 1000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)
_ERF = np.vectorize(math.erf)


def range_upper(q: float, k: int) -> float:
    """P(range of k standard normals > q)."""
    z = 8 * _NODES
    cdf = lambda v: 0.5 * (1 + _ERF(v / math.sqrt(2)))
    inner = np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * (cdf(z) - cdf(z - q)) ** (k - 1)
    return 1 - k * float((8 * _WEIGHTS * inner).sum())


def range_quantile(alpha: float, k: int) -> float:
    """The studentised range's upper quantile with infinite degrees of freedom."""
    low, high = 0.0, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if range_upper(mid, k) > alpha else (low, mid)
    return (low + high) / 2


def nemenyi_difference(k: int, n: int, alpha: float = 0.05) -> float:
    """Critical difference of average ranks of k models over n tasks."""
    return range_quantile(alpha, k) / math.sqrt(2) * math.sqrt(k * (k + 1) / (6 * n))


def wilcoxon_p(differences: np.ndarray) -> float:
    """Two-sided signed-rank test: exact without ties up to 50 differences, else the normal approximation with tie correction."""
    d = np.asarray(differences, float)
    d = d[d != 0]
    n = len(d)
    if len(differences) < 3 or n == 0:
        return 1.0
    size = np.abs(d)
    order = np.argsort(size, kind="stable")
    ranks = np.empty(n)
    ranks[order] = np.arange(1, n + 1)
    _, which, counts = np.unique(size, return_inverse=True, return_counts=True)
    ranks = (np.bincount(which, weights=ranks) / counts)[which]
    plus = float(ranks[d > 0].sum())
    w = min(plus, n * (n + 1) / 2 - plus)
    if n <= 50 and (counts == 1).all() and n == len(differences):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] = ways[r:] + ways[:-r]
        return min(1.0, 2 * float(ways[: int(w) + 1].sum() / 2**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - float((counts**3 - counts).sum()) / 48
    return min(1.0, 2 * normal_upper(abs(plus - n * (n + 1) / 4) / math.sqrt(var)))
