"""Special functions and small statistics for the driver."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np


def regularized_gamma(a: float, x: float) -> float:
    """P(a, x): the series below a + 1, else one minus the continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return min(1.0, front * total)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for k in range(1, 500):
        step = -k * (k - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * h


def gamma_quantile(a: float, p: float) -> float:
    """x with P(a, x) = p, by bisection."""
    low, high = 0.0, max(1.0, a)
    while regularized_gamma(a, high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if regularized_gamma(a, middle) < p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def gamma_rates(alpha: float, categories: int) -> list[float]:
    """Mean rates of equally likely categories of a gamma distribution with mean 1."""
    if alpha > 1000 or categories == 1:
        return [1.0] * categories
    cuts = [gamma_quantile(alpha, k / categories) for k in range(1, categories)]
    below = [0.0, *(regularized_gamma(alpha + 1, c) for c in cuts), 1.0]
    rates = np.diff(below) * categories
    return (rates / rates.mean()).tolist()


def chi_square_tail(x: float, df: int) -> float:
    return 1 - regularized_gamma(df / 2, x / 2)


def likelihood_ratio_test(constrained: float, free: float, df: int) -> tuple[float, float]:
    """Twice the gain in log-likelihood, and its chi-square tail."""
    value = max(0.0, 2 * (free - constrained))
    return value, chi_square_tail(value, df)


SCALES = tuple(round(0.5 + 0.1 * k, 1) for k in range(10))


def au_test(site_lnl: np.ndarray, seed: int = 1, reps: int = 1000, scales: tuple[float, ...] = SCALES) -> list[dict]:
    """Approximately unbiased p of each tree by the multiscale bootstrap of ``site_lnl`` (trees x sites), with BP, KH and SH.

    At a scale r replicates have r n sites; z(r) = d sqrt(r) + c / sqrt(r) is fitted by weighted least squares, p = 1 - F(d - c)."""
    rng = np.random.default_rng(seed)
    n = site_lnl.shape[1]
    sums = [rng.multinomial(max(1, round(scale * n)), np.full(n, 1 / n), reps) @ site_lnl.T for scale in scales]
    return au_rows(sums, site_lnl.sum(1), lambda a, b: math.sqrt(n * (site_lnl[a] - site_lnl[b]).var(ddof=1)) if n > 1 else 0.0, scales)


def au_rows(sums: list[np.ndarray], totals: np.ndarray, apart: Callable[[int, int], float], scales: tuple[float, ...] = SCALES) -> list[dict]:
    """What :func:`au_test` gives, from the replicates' sums (replicates x trees) at each scale, the trees' totals, and ``apart(a, b)``, the deviation of the sum of
    two trees' differences."""
    normal = NormalDist()
    reps, trees = sums[0].shape
    share = np.stack([np.bincount(own.argmax(1), minlength=trees) / reps for own in sums])
    centered = sums[list(scales).index(1.0)]
    centered = centered - centered.mean(0)
    best = int(totals.argmax())
    out = []
    for t in range(trees):
        inside = (share[:, t] > 0) & (share[:, t] < 1)
        au = float(share[:, t].mean() > 0.5)
        if inside.sum() >= 2:
            r = np.array(scales)[inside]
            z = np.array([-normal.inv_cdf(p) for p in share[inside, t]])
            density = np.array([normal.pdf(v) for v in z])
            w = reps * density**2 / (share[inside, t] * (1 - share[inside, t]))
            x = np.stack([np.sqrt(r), 1 / np.sqrt(r)], 1)
            d, c = np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
            au = 1 - normal.cdf(d - c)
        gap = totals[best] - totals[t]
        other = best if t != best else int(np.argsort(totals)[-2]) if trees > 1 else t
        sd = apart(other, t) if other != t else 0.0
        kh = 2 * (1 - normal.cdf(abs(totals[other] - totals[t]) / sd)) if sd > 0 else 1.0
        sh = float((centered.max(1) - centered[:, t] >= gap - 1e-12).mean())
        out.append({"tree": t, "lnl": float(totals[t]), "au": au, "bp": float(share[list(scales).index(1.0), t]), "kh": kh, "sh": sh})
    return out
