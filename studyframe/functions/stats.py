"""Distribution functions for summary rows (one value per predictor, never per data row).

Regularised incomplete beta / gamma by continued fractions, normal tail by
``erfc``; enough for the t, chi-square, normal and hypergeometric p-values the
screens report.
"""

from __future__ import annotations

import math

import numpy as np

_EPS = 1e-15
_TINY = 1e-300


def _beta_cf(a: float, b: float, x: float) -> float:
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = 1.0 + aa / c
        c = c if abs(c) > _TINY else _TINY
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
    ln_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(ln_front) * _beta_cf(a, b, x) / a
    return 1.0 - math.exp(ln_front) * _beta_cf(b, a, 1.0 - x) / b


def gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0.0:
        return 1.0
    if x < a + 1.0:  # series for P, then 1 - P
        s, term, ap = 1.0 / a, 1.0 / a, a
        for _ in range(1000):
            ap += 1.0
            term *= x / ap
            s += term
            if abs(term) < abs(s) * _EPS:
                break
        return max(0.0, 1.0 - s * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for i in range(1, 1000):
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


def pearson_p(r: float, n: int) -> float:
    """Two-sided p of a Pearson / point-biserial r on n pairs (t with n−2 df)."""
    if r is None or n < 3 or math.isnan(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t = r * math.sqrt(df / (1.0 - r * r))
    return t_two_sided_p(t, df)


def chi2_sf(x: float, k: float) -> float:
    if x is None or k <= 0 or math.isnan(x):
        return float("nan")
    return gammaincc(k / 2.0, x / 2.0)


def norm_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Inverse standard normal CDF by bisection on ``erfc`` (summary use only)."""
    if p <= 0.0:
        return float("-inf")
    if p >= 1.0:
        return float("inf")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 1.0 - norm_sf(mid) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


def _stirling_error(n: float) -> float:
    """log n! − log(√(2πn)·(n/e)^n), without the cancellation of large terms."""
    if n <= 15:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    k = 1.0 / (n * n)
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - k / 1188) * k) * k) * k) / n


def _deviance(x: float, mean: float) -> float:
    """x·log(x/mean) + mean − x, exact also where x is close to the mean."""
    d = x - mean
    if abs(d) < 0.1 * (x + mean):
        v = d / (x + mean)
        total, term, j = d * v, 2 * x * v, 1
        while True:
            term *= v * v
            more = total + term / (2 * j + 1)
            if more == total:
                return total
            total, j = more, j + 1
    return x * math.log(x / mean) + mean - x


def _log_binomial(x: int, n: int, p: float, q: float) -> float:
    """log of the binomial probability, by saddle point."""
    if x < 0 or x > n:
        return float("-inf")
    if x == 0:
        return n * math.log1p(-p) if p < 0.1 else n * math.log(q) if n else 0.0
    if x == n:
        return n * math.log(p)
    body = (_stirling_error(n) - _stirling_error(x) - _stirling_error(n - x)
            - _deviance(x, n * p) - _deviance(n - x, n * q))
    return body + 0.5 * (math.log(n) - math.log(2 * math.pi) - math.log(x) - math.log(n - x))


def fisher_exact_2x2(a: int, b: int, c: int, d: int):
    """Odds ratio (a·d)/(b·c) and two-sided p: total probability of tables no
    more likely than the observed one (relative tolerance 1e-7).

    Tables more likely than the observed one form a run around the mode. Its ends are
    found by bisection, and the two tails are summed outward until they vanish.
    """
    a, b, c, d = int(a), int(b), int(c), int(d)
    r1, r2, c1 = a + b, c + d, a + c
    n = r1 + r2
    odds = (a * d) / (b * c) if b * c != 0 else (float("inf") if a * d != 0 else float("nan"))
    if c1 == 0 or c1 == n or r1 == 0 or r2 == 0:
        return odds, 1.0
    p, q = c1 / n, (n - c1) / n
    whole = _log_binomial(c1, n, p, q)

    def logp(x):
        return _log_binomial(x, r1, p, q) + _log_binomial(c1 - x, r2, p, q) - whole if r1 and r2 else 0.0

    lo, hi = max(0, c1 - r2), min(r1, c1)
    cut = logp(a) + math.log1p(1e-7)
    mode = min(hi, max(lo, ((r1 + 1) * (c1 + 1)) // (n + 2)))
    if logp(mode) <= cut:
        return odds, 1.0  # no table is more likely

    def edge(inner, outer):
        """The table nearest the mode, towards ``outer``, that counts; None if there is none."""
        if logp(outer) > cut:
            return None
        while abs(outer - inner) > 1:
            middle = (inner + outer) // 2
            inner, outer = (middle, outer) if logp(middle) > cut else (inner, middle)
        return outer

    total = 0.0
    for x, step, end in ((edge(mode, lo), -1, lo), (edge(mode, hi), 1, hi)):
        if x is None:
            continue
        at, term = x, math.exp(logp(x))
        total += term
        while at != end and term > total * 1e-17:
            k = np.arange(1, min(abs(end - at), 65536) + 1, dtype=np.float64) * step + at
            # ratio of each table to the one before it
            if step > 0:
                ratio = (r1 - k + 1) * (c1 - k + 1) / (k * (r2 - c1 + k))
            else:
                ratio = (k + 1) * (r2 - c1 + k + 1) / ((r1 - k) * (c1 - k))
            terms = term * np.cumprod(ratio)
            total += float(terms.sum())
            at, term = int(k[-1]), float(terms[-1])
    return odds, min(1.0, total)


def p_value_note(p, status: str) -> str:
    """Significance band of a p-value."""
    if status != "ok" or p is None or (isinstance(p, float) and math.isnan(p)):
        return "not_run"
    if p < 0.001:
        return "sig_0.001"
    if p < 0.01:
        return "sig_0.01"
    if p < 0.05:
        return "sig_0.05"
    return "ns"
