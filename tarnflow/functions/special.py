"""Distribution functions in numpy: normal, gamma, Pearson III, Gumbel, generalised extreme value, log-logistic."""

from __future__ import annotations

import math

import numpy as np

EULER = 0.5772156649015329


def normal_ppf(p):
    """Inverse normal distribution by bisection-free Newton steps on the complementary error function."""
    p = np.asarray(p, float)
    tail = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(np.maximum(tail, 1e-300)))
    x = t - (2.30753 + 0.27061 * t) / (1 + t * (0.99229 + t * 0.04481))
    erfc = np.vectorize(math.erfc, otypes=[float])
    for _ in range(4):
        err = 0.5 * erfc(x / math.sqrt(2)) - tail
        x = x + err * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
    return np.where(p < 0.5, -x, x)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    y = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def trigamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out += 1 / (x * x)
        x += 1
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return total * lead
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return 1 - lead * h


def gamma_ppf(p: float, a: float) -> float:
    lo, hi = 0.0, max(a, 1.0)
    while gamma_cdf(hi, a) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_cdf(mid, a) < p else (lo, mid)
        if hi - lo <= 1e-14 * hi:
            break
    return (lo + hi) / 2


def gamma_fit(x: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a gamma distribution that starts at 0, by maximum likelihood."""
    s = math.log(x.mean()) - np.log(x).mean()
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        step = (math.log(a) - digamma(a) - s) / (1 / a - trigamma(a))
        new = a - step
        a = new if new > 0 else a / 2
        if abs(step) < 1e-12 * a:
            break
    return a, float(x.mean()) / a


def pearson3_ppf(p: float, skew: float) -> float:
    """Quantile of the standardised Pearson III distribution."""
    if abs(skew) < 1e-5:
        return float(normal_ppf(p))
    a = 4 / skew**2
    q = gamma_ppf(p if skew > 0 else 1 - p, a)
    return skew / 2 * (q - a)


def pearson3_quantiles(chances: np.ndarray, skews: np.ndarray) -> np.ndarray:
    """``pearson3_ppf`` of every skew (rows) at every chance (columns), all at once.

    Newton's rule on the gamma distribution from Wilson and Hilferty's cube, kept inside shrinking bounds; slight skews
    take the cube itself, where it differs from the quantile by less than a hundred-thousandth of a deviation.
    """
    z = normal_ppf(chances)[None, :] + np.zeros((len(skews), 1))
    k = skews[:, None] + np.zeros_like(z)
    flat = np.abs(k) < 1e-5
    k6 = np.where(flat, 1.0, k) / 6
    out = np.where(flat, z, (2 / (6 * k6)) * ((1 + k6 * z - k6**2) ** 3 - 1))
    steep = np.abs(k) >= 0.02
    if not steep.any():
        return out
    g = np.abs(k[steep])
    a, p = 4 / g**2, np.where(k[steep] > 0, (chances[None, :] + np.zeros_like(z))[steep], 1 - (chances[None, :] + np.zeros_like(z))[steep])
    lgamma = np.vectorize(math.lgamma, otypes=[float])(a)
    x = a + np.sign(k[steep]) * out[steep] * 2 / g
    lo, hi = np.zeros_like(x), np.full_like(x, np.inf)
    x = np.where(x > 0, x, a * p ** (1 / a) * 0.5 + 1e-300)
    for _ in range(100):
        f = _gamma_cdfs(x, a, lgamma) - p
        lo, hi = np.where(f < 0, x, lo), np.where(f >= 0, x, hi)
        slope = np.exp((a - 1) * np.log(x) - x - lgamma)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = x - f / slope
        new = np.where((new > lo) & (new < hi), new, np.where(np.isfinite(hi), (lo + hi) / 2, 2 * x))
        if (np.abs(new - x) <= 1e-14 * x).all():
            break
        x = new
    out[steep] = np.sign(k[steep]) * g / 2 * (x - a)
    return out


def _gamma_cdfs(x: np.ndarray, a: np.ndarray, lgamma: np.ndarray) -> np.ndarray:
    """``gamma_cdf`` of arrays; ``lgamma`` is that of ``a``."""
    lead = np.exp(a * np.log(x) - x - lgamma)
    low = x < a + 1
    out = np.zeros_like(x)
    u, n = x[low], a[low].copy()
    term = 1 / n
    total = term.copy()
    while len(u) and (term > 1e-16 * total).any():
        n += 1
        term = term * u / n
        total = total + term
    out[low] = total * lead[low]
    u, v = x[~low], a[~low]
    b = u + 1 - v
    c, d = np.full_like(b, 1e300), 1 / b
    h = d.copy()
    for i in range(1, 10_000):
        if not len(u):
            break
        an = -i * (i - v)
        b = b + 2
        d = 1 / (an * d + b)
        c = b + an / c
        h = h * c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out[~low] = 1 - lead[~low] * h
    return out


def gumbel_mles(x: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """``gumbel_mle`` of every row at once; a row without spread has a scale of 0 at its value."""
    low, mean = x.min(axis=1), x.mean(axis=1)
    s = np.maximum(x.std(axis=1, ddof=1) * math.sqrt(6) / math.pi, 1e-300)
    spread = (x - low[:, None]).any(axis=1)
    y, s = x - low[:, None], np.where(spread, s, 1.0)
    for _ in range(rounds):
        w = np.exp(-y / s[:, None])
        total = w.sum(axis=1)
        m = (y * w).sum(axis=1) / total
        v = ((y * y * w).sum(axis=1) / total - m * m) / (s * s)
        new = s + (mean - low - m - s) / (v + 1)
        s = np.where(spread, np.where(new > 0, new, s / 2), 1.0)
    scale = np.where(spread, s, 0.0)
    return low - scale * np.log(np.exp(-y / s[:, None]).mean(axis=1)), scale


def gumbel_mom(x: np.ndarray) -> tuple[float, float]:
    scale = float(x.std(ddof=1)) * math.sqrt(6) / math.pi
    return float(x.mean()) - EULER * scale, scale


def gumbel_mle(x: np.ndarray) -> tuple[float, float]:
    """Newton steps on the scale's likelihood equation; the location follows."""
    x = np.asarray(x, float)
    low, mean = x.min(), x.mean()
    s = gumbel_mom(x)[1] or 1.0
    for _ in range(200):
        w = np.exp(-(x - low) / s)
        m = (x * w).sum() / w.sum()
        f = mean - m - s
        v = ((x * x * w).sum() / w.sum() - m * m) / (s * s)
        new = s - f / (-v - 1)
        s, old = (new if new > 0 else s / 2), s
        if abs(s - old) < 1e-12 * s:
            break
    return float(low - s * math.log(np.exp(-(x - low) / s).mean())), float(s)


def nelder_mead(f, start: list[float], steps: int = 2000, tolerance: float = 1e-10) -> np.ndarray:
    """A small simplex minimiser."""
    n = len(start)
    points = [np.array(start, float)] + [np.array(start, float) + np.eye(n)[i] * (0.1 * abs(start[i]) or 0.1) for i in range(n)]
    values = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance):
            break
        centre = np.mean(points[:-1], axis=0)
        r = centre + (centre - points[-1])
        fr = f(r)
        if fr < values[0]:
            e = centre + 2 * (centre - points[-1])
            fe = f(e)
            points[-1], values[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < values[-2]:
            points[-1], values[-1] = r, fr
        else:
            c = centre + 0.5 * ((r if fr < values[-1] else points[-1]) - centre)
            fc = f(c)
            if fc < min(fr, values[-1]):
                points[-1], values[-1] = c, fc
            else:
                points = [points[0]] + [points[0] + 0.5 * (p - points[0]) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    return points[int(np.argmin(values))]


def gev_mle(x: np.ndarray) -> tuple[float, float, float]:
    """Shape c (the negative of the usual xi), location and scale."""
    loc, scale = gumbel_mle(x)

    def cost(t: np.ndarray) -> float:
        c, m, s = t[0], t[1], math.exp(t[2])
        z = (x - m) / s
        if abs(c) < 1e-9:
            return float(len(x) * t[2] + z.sum() + np.exp(-z).sum())
        y = 1 - c * z
        if (y <= 0).any():
            return 1e30
        return float(len(x) * t[2] - (1 / c - 1) * np.log(y).sum() + (y ** (1 / c)).sum())

    c, m, s = nelder_mead(cost, [0.05, loc, math.log(scale)])
    return float(c), float(m), float(math.exp(s))


def gev_ppf(p: float, c: float, loc: float, scale: float) -> float:
    if abs(c) < 1e-9:
        return loc - scale * math.log(-math.log(p))
    return loc + scale / c * (1 - (-math.log(p)) ** c)


def logistic_mle(y: np.ndarray) -> tuple[float, float]:
    """Location and scale of a logistic distribution."""
    start = [float(np.median(y)), math.log(float(y.std()) * math.sqrt(3) / math.pi)]

    def cost(t: np.ndarray) -> float:
        z = (y - t[0]) / math.exp(t[1])
        return float(len(y) * t[1] + np.abs(z).sum() + 2 * np.log1p(np.exp(-np.abs(z))).sum())

    m, s = nelder_mead(cost, start)
    return float(m), float(math.exp(s))
