"""Additive block sums of the spectrum, wavelet head, order patterns, lagged regressions and drift bins.

Each family follows the rules of ``partials``: a block yields a fixed number of values from its own samples and a halo,
values of all blocks add up, and ``finish_*`` turns the totals of a series into its features.
"""

from __future__ import annotations

import math

import numpy as np

from .names import WIDTHS

NAN = float("nan")
FFT = 100
SEGMENT, STEP = 256, 128
BINS = SEGMENT // 2 + 1
HEAD = 15
HEAD_REACH = HEAD + 10 * max(WIDTHS) // 2
DIMENSIONS = (3, 4, 5, 6, 7)
ORDER = 10
CELLS, DEGREE = 30, 3
#: Shares of the value order at which drift cells begin and end.
CELL_EDGES = tuple(i / CELLS for i in range(CELLS + 1))


def most_lags(n: float) -> int:
    """Lags that the unit-root regression tries: it grows with the fourth root of the length."""
    return min(math.ceil(12.0 * (n / 100.0) ** 0.25), int(n) // 2 - 2)


# Numbers of each family; those of the unit root grow with the lags of the series and stand at the end of its vector.
SIZES = {"fft": 2 * FFT, "welch": BINS + 1, "cwt": HEAD * len(WIDTHS), "perm": sum(math.factorial(d) for d in DIMENSIONS),
         "ar": (ORDER + 2) ** 2 + ORDER, "drift": 3 * CELLS}


def sizes(lags: int) -> dict:
    """All families for a series whose unit-root regression tries so many lags."""
    return {**SIZES, "adf": 3 * (lags + 1) + 2}


# ---- sums of one block --------------------------------------------------------------------------------------

# Plain dictionaries: they travel with the task like the functions that use them.
WAVES: dict = {}
HATS: dict = {}


def waves(m: int, n: int):
    """Cosines and sines of the first m positions of runs of n samples; all blocks of a run share them."""
    if n not in WAVES or WAVES[n][0].shape[1] < m:
        if len(WAVES) >= 8:
            WAVES.clear()
        turns = (np.arange(FFT)[:, None] * np.arange(m)[None, :]) % n
        angle = 2 * np.pi / n * turns
        WAVES[n] = np.cos(angle), np.sin(angle)
    cos, sin = WAVES[n]
    return cos[:, :m], sin[:, :m]


def fft_sums(w, t0, n):
    if t0 == 0 and len(w) == n:
        got = np.fft.fft(w)[np.arange(FFT) % n]
        return np.concatenate([got.real, got.imag])
    # The block as if it began the run, turned by the phase of its first position.
    cos, sin = waves(len(w), n)
    c, s = cos @ w, sin @ w
    phase = 2 * np.pi / n * ((np.arange(FFT) * t0) % n)
    return np.concatenate([np.cos(phase) * c - np.sin(phase) * s, -(np.sin(phase) * c + np.cos(phase) * s)])


def welch_sums(a, o, m, t0, n):
    """Power per bin summed over the segments that start in this block, and their number."""
    size = min(n, SEGMENT)
    if size < 2:
        return np.zeros(BINS + 1)
    step = max(1, size - size // 2)
    first = -(-t0 // step) * step
    starts = np.arange(first, min(t0 + m, n - size + 1), step) - t0 + o
    out = np.zeros(BINS + 1)
    if len(starts):
        win = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        seg = a[starts[:, None] + np.arange(size)[None, :]]
        seg = (seg - seg.mean(axis=1, keepdims=True)) * win
        power = np.abs(np.fft.rfft(seg, axis=1)) ** 2 / (win ** 2).sum()
        power[:, 1:(None if size % 2 else -1)] *= 2.0
        out[:power.shape[1]] = power.sum(axis=0)
        out[-1] = len(starts)
    return out


def hat(points: int, width: float):
    """Mexican-hat wavelet."""
    if (points, width) not in HATS:
        if len(HATS) >= 256:
            HATS.clear()
        t = np.arange(points) - (points - 1) / 2.0
        s = (t / width) ** 2
        HATS[points, width] = 2.0 / (math.sqrt(3.0 * width) * math.pi ** 0.25) * (1.0 - s) * np.exp(-s / 2.0)
    return HATS[points, width]


def head_sums(a, o, t0, n):
    """First wavelet coefficients of each width: they depend on the head of the series, which block 0 sees."""
    out = np.zeros((len(WIDTHS), HEAD))
    if t0 == 0:
        head = a[o:o + HEAD_REACH]
        for i, width in enumerate(WIDTHS):
            taps = min(10 * width, n)
            full = np.convolve(head, hat(taps, width)[::-1])
            at = np.arange(min(HEAD, n)) + (taps - 1) // 2
            out[i, :len(at)] = full[at]
    return out.ravel()


def pattern_sums(a, o, m):
    """Order patterns of 3..7 neighbours that start at own positions, counted by their number.

    Digit j of a pattern's number (factorial base) tells how many of its first j values are not above value j, so the
    numbers of one more neighbour extend those of the fewer."""
    x = a[o:min(o + m + max(DIMENSIONS) - 1, len(a))]
    above = [None] + [x[:-lag] <= x[lag:] for lag in range(1, max(DIMENSIONS)) if lag < len(x)]
    code, out = np.zeros(len(x), dtype=np.int64), []
    for j in range(1, max(DIMENSIONS)):
        size = len(x) - j
        if size > 0:
            digit = sum(above[j - i][i:i + size].astype(np.int64) for i in range(j))
            code = code[:size] + digit * math.factorial(j)
        if j + 1 in DIMENSIONS:
            out.append(np.bincount(code[:m], minlength=math.factorial(j + 1)) if size > 0 else np.zeros(math.factorial(j + 1)))
    return np.concatenate(out).astype(float)


def ar_sums(c, o, m, t0):
    """Products of (1, c_t, c_(t-1) .. c_(t-10)) over own positions t >= 10, and the first 10 samples, which lower orders add."""
    at = np.arange(max(t0, ORDER), t0 + m) - t0 + o
    rows = np.column_stack([np.ones(len(at))] + [c[at - k] for k in range(ORDER + 1)])
    head = np.zeros(ORDER)
    own = min(t0 + m, ORDER)
    if t0 < own:
        head[t0:own] = c[o:o + own - t0]
    return np.concatenate([(rows.T @ rows).ravel(), head])


def drift_sums(x, y, edges, n):
    out = np.zeros((3, CELLS))
    if n - 1 >= CELLS and len(edges) == CELLS + 1 and (np.diff(edges) > 0).all() and len(x):
        cell = np.clip(np.searchsorted(edges, x, side="left") - 1, 0, CELLS - 1)
        out[0] = np.bincount(cell, minlength=CELLS)
        out[1] = np.bincount(cell, x, CELLS)
        out[2] = np.bincount(cell, y - x, CELLS)
    return out.ravel()


def adf_sums(c, o, m, t0, n, lags=None):
    """Products of steps by lag, sums of levels and their squares, and the first and last lags + 1 samples of the series.

    Step t leads from sample t to t + 1. The regression's table follows from these by corrections at both ends."""
    most = max(0, most_lags(n)) if lags is None else lags
    head, tail = np.zeros(most + 1), np.zeros(most + 1)
    own = c[o:o + m]
    at = np.arange(t0, min(t0 + m, most + 1))
    head[at] = own[at - t0]
    at = np.arange(max(t0, n - 1 - most), t0 + m)
    tail[at - (n - 1 - most)] = own[at - t0]
    end = min(m, n - 1 - t0)  # own steps
    back = min(o, most)
    steps = np.diff(c[o - back:o + end + 1])
    steps = np.concatenate([np.zeros(most - back), steps])  # no steps before the series
    now = steps[most:]
    products = now @ np.lib.stride_tricks.sliding_window_view(steps, most + 1)[:, ::-1] if len(now) else np.zeros(most + 1)
    return np.concatenate([products, [own.sum(), own @ own], head, tail])


def adf_table(row: np.ndarray, most: int):
    """(products of (1, level, step, lagged steps) over steps most .. n - 2, first samples) from the sums of a series."""
    products, (total, square), head, tail = row[:most + 1], row[most + 1:most + 3], row[most + 3:2 * most + 4], row[2 * most + 4:]
    first, last = np.diff(head), np.diff(tail)
    t = np.empty((most + 1, most + 1))  # t[i, j]: steps i and j places back; the range of one place more back lies one step earlier
    t[0] = products
    if most:
        t[0, :-1] -= np.correlate(first, first, "full")[most - 1:]
    for i in range(most):
        t[i + 1, i + 1:] = t[i, i:-1] + first[most - 1 - i] * first[most - 1 - i::-1] - last[most - 1 - i] * last[most - 1 - i::-1]
    t = np.triu(t) + np.triu(t, 1).T
    k = np.arange(most + 1)
    ends, begins = tail[most - k], head[most - k]
    # Level times step telescopes: 2 c (c' - c) = c'^2 - c^2 - (c' - c)^2; a level is an earlier one and the steps between.
    level = 0.5 * (ends ** 2 - begins ** 2 - np.diag(t)) + np.array([t[1:q + 1, q].sum() for q in k])
    table = np.empty((most + 3, most + 3))
    at = [2, *range(3, most + 3)]
    table[np.ix_(at, at)] = t
    table[0, 0] = 0.0
    table[0, at] = table[at, 0] = ends - begins
    table[1, at] = table[at, 1] = level
    table[0, 1] = table[1, 0] = total - head[:most].sum() - tail[-1]
    table[1, 1] = square - (head[:most] ** 2).sum() - tail[-1] ** 2
    return table, head


def block_values(family, a, c, o, m, t0, n, edges, lags=None):
    if family == "fft":
        return fft_sums(a[o:o + m], t0, n)
    if family == "welch":
        return welch_sums(a, o, m, t0, n)
    if family == "cwt":
        return head_sums(a, o, t0, n)
    if family == "perm":
        return pattern_sums(a, o, m)
    if family == "ar":
        return ar_sums(c, o, m, t0)
    if family == "adf":
        return adf_sums(c, o, m, t0, n, lags)
    last = min(o + m, len(a) - 1)
    return drift_sums(a[o:last], a[o + 1:last + 1], edges, n)


# ---- features of the totals ---------------------------------------------------------------------------------

def finish_fft(v, n, attr, k):
    real, imag = v[:, k], np.where((k == 0) | (2 * k == n), 0.0, v[:, FFT + k])  # both are real by definition
    got = {"real": real, "imag": imag, "abs": np.hypot(real, imag), "angle": np.degrees(np.arctan2(imag, real))}[attr]
    return np.where(k <= n // 2, got, NAN)


def power(row, n):
    size = min(int(n), SEGMENT)
    return row[:size // 2 + 1] / row[-1] if row[-1] else np.zeros(1)


def finish_welch(powers, k):
    return np.array([p[k] if k < len(p) else NAN for p in powers])


def finish_fourier_entropy(powers, bins):
    """Entropy of the histogram of the power density over its largest value; ``powers`` has one density per series."""
    out = []
    for p in powers:
        top, low = p.max(), p.min()
        if not top > 0:
            out.append(0.0)
            continue
        span = top - low
        cell = np.minimum((p - low) / span * bins, bins - 1).astype(int) if span > 0 else np.full(len(p), bins // 2)
        share = np.bincount(cell)[np.unique(cell)] / len(p)
        out.append(-(share * np.log(share)).sum())
    return np.array(out)


def finish_wavelet(v, n, width, k):
    return np.where(k < n, v[:, WIDTHS.index(width) * HEAD + k], NAN)


def finish_patterns(v, dimension):
    at = sum(math.factorial(d) for d in DIMENSIONS if d < dimension)
    counts = v[:, at:at + math.factorial(dimension)]
    total = counts.sum(axis=1, keepdims=True)
    share = counts / np.where(total > 0, total, NAN)
    terms = np.where(share > 0, share * np.log(np.where(share > 0, share, 1.0)), 0.0)
    return np.where(total[:, 0] > 0, -terms.sum(axis=1), NAN)


def finish_ar(v, n, mu, order=ORDER):
    """Intercept and coefficients of the autoregression, from the normal equations of the centred series."""
    out = np.full((len(n), order + 1), NAN)
    at = [0, *range(2, order + 2)]
    for i in np.flatnonzero(n > 2 * order + 1):
        table = v[i, :-ORDER].reshape(ORDER + 2, ORDER + 2)[:order + 2, :order + 2]
        head = v[i, -ORDER:][:int(min(n[i], ORDER))]
        # Positions from the order on up to 10, which the products leave out.
        early = np.column_stack([np.ones(max(0, len(head) - order))] + [head[order - k:max(order, len(head)) - k] for k in range(order + 1)])
        table = table + early.T @ early
        beta = np.linalg.lstsq(table[np.ix_(at, at)], table[at, 1], rcond=None)[0]
        out[i] = beta
        out[i, 0] += mu[i] * (1.0 - beta[1:].sum())
    return out


def cell_polynomial(row, degree=DEGREE):
    """Polynomial through the mean step over the cells, or None."""
    n, x, d = row.reshape(3, CELLS)
    ok = n > 0
    return np.polyfit(x[ok] / n[ok], d[ok] / n[ok], degree) if ok.sum() > degree else None


def finish_drift(v, degree=DEGREE):
    """Coefficients of the drift polynomial and, in the last column, its largest real root."""
    out = np.full((len(v), degree + 2), NAN)
    for i, row in enumerate(v):
        poly = cell_polynomial(row, degree)
        if poly is not None:
            roots = np.roots(poly)
            out[i, :-1] = poly
            out[i, -1] = np.max(np.real(roots)) if len(roots) else NAN
    return out


# MacKinnon's (1994) response surface of the unit-root test with a constant.
TAU_MAX, TAU_MIN, TAU_SPLIT = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 0.038269)
TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)


def unit_root_p(stat: float) -> float:
    if stat > TAU_MAX:
        return 1.0
    if stat < TAU_MIN:
        return 0.0
    z = sum(c * stat ** i for i, c in enumerate(TAU_SMALL if stat <= TAU_SPLIT else TAU_LARGE))
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def residuals(table, columns):
    """Residual sum of squares of the step regressed on growing sets of columns, from their products."""
    scale = np.sqrt(np.diag(table))
    if (scale[[*columns, 2]] <= 0).any():
        return None
    unit = table / np.outer(np.where(scale > 0, scale, 1.0), np.where(scale > 0, scale, 1.0))
    try:
        root = np.linalg.cholesky(unit[np.ix_(columns, columns)])
    except np.linalg.LinAlgError:
        return None
    if (np.diag(root) < 1e-7).any():
        return None
    part = np.linalg.solve(root, unit[columns, 2])
    return (1.0 - np.cumsum(part ** 2)) * table[2, 2]


def unit_root(row, n, lags=None):
    """(statistic, p, lags) of the unit-root regression with constant; unless given, the lags minimise AIC on a common sample."""
    most = most_lags(n)
    if most < 0 or lags is not None and lags > most:
        return NAN, NAN, NAN
    table, head = adf_table(row, most)
    count = n - 1 - most
    table[0, 0] = count
    columns = [0, 1, *range(3, most + 3)]
    used = lags
    if used is None:
        rss = residuals(table, columns)
        if rss is None or (rss[1:] <= 0).any():
            return NAN, NAN, NAN
        aic = [count * (math.log(2 * math.pi * r / count) + 1.0) + 2.0 * (k + 2) for k, r in enumerate(rss[1:])]
        used = int(np.argmin(aic))
    # Fewer lags allow more steps: those between `used` and `most` lie in the head of the series.
    at, step = np.arange(used, most), np.diff(head)
    rows = np.column_stack([np.ones(len(at)), head[at], step[at]] + [step[at - k] for k in range(1, used + 1)])
    both = table[:used + 3, :used + 3] + rows.T @ rows
    columns = columns[:used + 2]
    square, cross = both[np.ix_(columns, columns)], both[columns, 2]
    dof = n - 1 - used - len(columns)
    scale = np.sqrt(np.diag(square))
    if dof <= 0 or (scale <= 0).any():
        return NAN, NAN, NAN
    inverse = np.linalg.pinv(square / np.outer(scale, scale)) / np.outer(scale, scale)
    beta = inverse @ cross
    left = both[2, 2] - beta @ cross
    if left <= 0:
        return NAN, NAN, NAN
    stat = float(beta[1] / math.sqrt(left / dof * inverse[1, 1]))
    return stat, unit_root_p(stat), float(used)


def finish_unit_root(rows, n, lags=None):
    return np.array([unit_root(row, int(count), lags) for row, count in zip(rows, n)]).reshape(-1, 3)
