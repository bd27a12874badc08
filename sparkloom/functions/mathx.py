"""Numeric kernels on collected summaries: distribution tails, the dip, mixtures, histogram widths, mutual information."""

from __future__ import annotations

import math
from functools import cache

import numpy as np


def gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * front)
    b = x + 1 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / (c if abs(c) > 1e-300 else 1e-300)
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_sf(f: float, d1: float, d2: float) -> float:
    if f <= 0 or math.isnan(f):
        return 1.0
    return 0.0 if math.isinf(f) else beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def wilson_lower(hits: int, n: int, z: float = 1.96) -> float:
    """Lower bound of the Wilson interval of a share."""
    if n == 0:
        return 0.0
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n)


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float).copy()
    out = np.zeros_like(x)
    while (small := x < 6).any():
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def histogram_bins(n: int, low: float, high: float, iqr: float) -> int:
    """Number of bins of the automatic rule: the width is the smaller of Sturges' and of Freedman and Diaconis' with a floor."""
    spread = high - low
    if n == 0 or spread == 0:
        return 1
    sturges, root, fd = spread / (math.log2(n) + 1), spread / math.sqrt(n), 2 * iqr * n ** (-1 / 3)
    width = min(max(fd, root / 2), sturges)
    return max(1, math.ceil(spread / width))


def dip(values: np.ndarray, counts: np.ndarray) -> float:
    """Hartigan's dip of a sample given as distinct sorted values with counts.

    The dip is the smallest half-width of a band around the empirical distribution that holds a unimodal one.  For a mode
    at a place, the best convex part before it and the best concave part after it deviate by half of the largest gaps to
    the greatest convex minorant and the least concave majorant; the place with the smallest deviation gives the dip.
    """
    n = float(counts.sum())
    top = np.cumsum(counts) / n
    return dip_between(values.astype(float), top - counts / n, top, n)


def dip_between(x: np.ndarray, low: np.ndarray, top: np.ndarray, n: float) -> float:
    """The dip of the distribution that rises from ``low`` to ``top`` at each ``x`` and is straight in between."""
    if len(x) < 2:
        return 1 / (2 * n)

    def gaps(x: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        """For each prefix, the largest excess of ``above`` over the convex minorant of ``below``."""
        hull: list[int] = []
        out, worst = np.zeros(len(x)), {}
        for i in range(len(x)):
            while len(hull) > 1 and (below[hull[-1]] - below[hull[-2]]) * (x[i] - x[hull[-1]]) >= (below[i] - below[hull[-1]]) * (x[hull[-1]] - x[hull[-2]]):
                worst.pop(hull.pop(), None)
            best = 0.0
            if hull:
                a = hull[-1]
                inner = slice(a, i + 1)
                line = below[a] + (below[i] - below[a]) * (x[inner] - x[a]) / (x[i] - x[a])
                best = max(worst.get(a, 0.0), float((above[inner][:-1] - line[:-1]).max(initial=0.0)), float((above[inner][1:-1] - line[1:-1]).max(initial=0.0)))
            hull.append(i)
            worst[i] = best
            out[i] = best
        return out

    left = gaps(x, low, top)
    right = gaps(-x[::-1], 1 - top[::-1], 1 - low[::-1])[::-1]
    return float(max(np.min(np.maximum(left, right)) / 2, 1 / (2 * n)))


@cache
def _uniform_dips(n: int, rounds: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    one = np.ones(n)
    return np.array([dip(np.sort(r.random(n)), one) for _ in range(rounds)])


def dip_p_value(d: float, n: int, rounds: int = 200, seed: int = 42, most: int = 600) -> float:
    """Share of uniform samples whose dip is at least ``d``; dips of larger samples are scaled by the root of their size."""
    m = min(n, most)
    return float(np.mean(_uniform_dips(m, rounds, seed) >= d * math.sqrt(n / m)))


def mixture_of_two(values: np.ndarray, counts: np.ndarray, rounds: int = 200, start: tuple[float, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, standard deviations and weights of two normal components, by expectation maximisation from ``start`` or the outer quartiles."""
    x, w = values.astype(float), counts.astype(float)
    total = w.sum()
    run = np.cumsum(w) / total
    mean = np.array([x[np.searchsorted(run, 0.25)], x[min(np.searchsorted(run, 0.75), len(x) - 1)]])
    if start is not None:
        mean = np.array(start, dtype=float)
    if mean[0] == mean[1]:
        mean = np.array([x[0], x[-1]])
    var = np.full(2, max(float(np.average((x - np.average(x, weights=w)) ** 2, weights=w)) / 4, 1e-6))
    share, before = np.array([0.5, 0.5]), -np.inf
    for _ in range(rounds):
        logp = np.log(share) - 0.5 * np.log(2 * np.pi * var) - (x[:, None] - mean) ** 2 / (2 * var)
        peak = logp.max(axis=1, keepdims=True)
        each = np.exp(logp - peak)
        likelihood = float((w * (np.log(each.sum(axis=1)) + peak[:, 0])).sum() / total)
        r = each / each.sum(axis=1, keepdims=True) * w[:, None]
        size = r.sum(axis=0) + 1e-12
        mean = (r * x[:, None]).sum(axis=0) / size
        var = (r * (x[:, None] - mean) ** 2).sum(axis=0) / size + 1e-6
        share = size / size.sum()
        if abs(likelihood - before) < 1e-6:
            break
        before = likelihood
    return mean, np.sqrt(var), share


def mutual_information(x: np.ndarray, y: np.ndarray, x_discrete: bool, y_discrete: bool, k: int = 3, seed: int = 42, clip: bool = True) -> float:
    """Nearest-neighbour mutual information in nats of a bounded block of rows; without ``clip`` estimates may be below 0, so they can be averaged."""
    least = 0.0 if clip else -math.inf
    if x_discrete and y_discrete:
        _, xi = np.unique(x, return_inverse=True)
        _, yi = np.unique(y, return_inverse=True)
        table = np.zeros((xi.max() + 1, yi.max() + 1))
        np.add.at(table, (xi, yi), 1)
        p = table / table.sum()
        outer = p.sum(1, keepdims=True) @ p.sum(0, keepdims=True)
        return float(max(least, (p[p > 0] * np.log(p[p > 0] / outer[p > 0])).sum()))
    r = np.random.default_rng(seed)

    def scaled(v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        spread = v.std()
        v = v / spread if spread > 0 else v
        return v + 1e-10 * max(1.0, float(np.abs(v).mean())) * r.normal(size=len(v))

    if x_discrete or y_discrete:
        code, value = (x, scaled(y)) if x_discrete else (y, scaled(x))
        radius, near, size = np.zeros(len(value)), np.zeros(len(value)), np.zeros(len(value))
        for c in np.unique(code):
            at = np.flatnonzero(code == c)
            if len(at) > 1:
                kk = min(k, len(at) - 1)
                d = np.abs(value[at][:, None] - value[at])
                radius[at] = np.nextafter(np.partition(d, kk, axis=1)[:, kk], 0)
                near[at] = kk
            size[at] = len(at)
        use = size > 1
        value, radius, near, size = value[use], radius[use], near[use], size[use]
        if not len(value):
            return 0.0
        m = (np.abs(value[:, None] - value) <= radius[:, None]).sum(axis=1)
        mi = digamma(np.array([len(value)]))[0] + digamma(near).mean() - digamma(size).mean() - digamma(m).mean()
        return float(max(least, mi))
    a, b = scaled(x), scaled(y)
    d = np.maximum(np.abs(a[:, None] - a), np.abs(b[:, None] - b))
    radius = np.nextafter(np.partition(d, min(k, len(a) - 1), axis=1)[:, min(k, len(a) - 1)], 0)
    out = digamma(np.array([len(a)]))[0] + digamma(np.array([k]))[0]
    for v in (a, b):
        out -= digamma((np.abs(v[:, None] - v) <= radius[:, None]).sum(axis=1)).mean()
    return float(max(least, out))
