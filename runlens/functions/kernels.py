"""The five calculators that need a series in one piece: moments of the whole spectrum, ridge lines, the Lempel-Ziv parse and
two entropies over all template pairs. They work on series of one block; a longer one stops the job.
"""

from __future__ import annotations

import bisect
import math

import numpy as np

from .spectral_sums import hat

NAN = float("nan")


# ---- spectrum -------------------------------------------------------------------------------

def fft_aggregated(x, wanted):
    """Moments of the amplitude spectrum over the bin number.

    The last term of the kurtosis is -3 centroid (not its fourth power), as the public feature library
    defines it.
    """
    amp = np.abs(np.fft.rfft(x))
    total = amp.sum()
    if total == 0:
        return [NAN] * len(wanted)
    k = np.arange(len(amp), dtype=float)
    m1, m2, m3, m4 = (float((amp * k ** p).sum() / total) for p in (1, 2, 3, 4))
    var = m2 - m1 ** 2
    small = var < 0.5
    out = {"centroid": m1, "variance": var,
           "skew": NAN if small else (m3 - 3 * m1 * var - m1 ** 3) / var ** 1.5,
           "kurtosis": NAN if small else (m4 - 4 * m1 * m3 + 6 * m2 * m1 ** 2 - 3 * m1) / var ** 2}
    return [out[p["aggtype"]] for p in wanted]


# ---- wavelets -------------------------------------------------------------------------------

def wavelet_rows(x, widths):
    return np.array([np.convolve(x, hat(min(10 * w, len(x)), w)[::-1], mode="same")[:len(x)] for w in widths])


def nearest(places, targets):
    """Index of the closest place for every target."""
    if not len(places):
        return np.empty(0, dtype=int)
    order = np.argsort(places, kind="stable")
    ranked = places[order]
    right = np.searchsorted(ranked, targets).clip(1, max(1, len(ranked) - 1)) if len(ranked) > 1 else np.zeros(len(targets), int)
    left = np.maximum(right - 1, 0)
    return order[np.where(np.abs(ranked[left] - targets) <= np.abs(ranked[right] - targets), left, right)]


def ridge_peaks(x, n: int) -> int:
    """Peaks that persist as ridge lines over the wavelet widths 1..n with signal-to-noise of at least 1."""
    widths = np.arange(1, n + 1)
    c = wavelet_rows(x, widths)
    inner = np.zeros(c.shape, dtype=bool)
    if c.shape[1] > 2:
        inner[:, 1:-1] = (c[:, 1:-1] > c[:, :-2]) & (c[:, 1:-1] > c[:, 2:])
    levels = [np.flatnonzero(r) for r in inner]
    filled = [i for i, r in enumerate(levels) if len(r)]
    if not filled:
        return 0
    top = filled[-1]
    live = [[[top], [p], 0] for p in levels[top]]
    ended = []
    for row in range(top - 1, -1, -1):
        for line in live:
            line[2] += 1
        ends = np.array([line[1][-1] for line in live])
        near = nearest(ends, levels[row])
        for i, p in enumerate(levels[row]):
            j = int(near[i]) if len(ends) else -1
            if j >= 0 and abs(ends[j] - p) <= widths[row] / 4.0:
                live[j][0].append(row)
                live[j][1].append(p)
                live[j][2] = 0
            else:
                live.append([[row], [p], 0])
        ended += [ln for ln in live if ln[2] > 1]
        live = [ln for ln in live if ln[2] <= 1]
    kept = [(rows, cols) for rows, cols, _ in ended + live if len(rows) >= math.ceil(c.shape[0] / 4)]
    if not kept:
        return 0
    half, odd = divmod(math.ceil(c.shape[1] / 20), 2)
    places = [(min(rows), cols[rows.index(min(rows))]) for rows, cols in kept]
    floors = noise_floor(c[0], half, half + odd, [p for _, p in places])
    return sum(bool(floors[p] != 0 and abs(c[r, p] / floors[p]) >= 1) for r, p in places)


def noise_floor(row, before: int, after: int, wanted) -> dict:
    """Tenth percentile of row[p-before:p+after] for the wanted places, by one sorted window that moves along."""
    n = len(row)
    values, window, lo, hi, out = row.tolist(), [], 0, 0, {}
    for p in sorted(set(wanted)):
        while hi < min(p + after, n):
            bisect.insort(window, values[hi])
            hi += 1
        while lo < p - before:
            del window[bisect.bisect_left(window, values[lo])]
            lo += 1
        place = 0.1 * (len(window) - 1)
        k = int(place)
        top = window[min(k + 1, len(window) - 1)]
        out[p] = window[k] + (top - window[k]) * (place - k)
    return out


def number_cwt_peaks(x, wanted):
    return [float(ridge_peaks(x, p["n"])) for p in wanted]


# ---- order patterns and complexity ----------------------------------------------------------

def lempel_ziv_complexity(x, wanted):
    out = []
    for p in wanted:
        edges = np.linspace(x.min(), x.max(), p["bins"] + 1)[1:]
        word = tuple(np.searchsorted(edges, x, side="left").tolist())
        seen, start, size = set(), 0, 1
        while start + size <= len(word):
            piece = word[start:start + size]
            if piece in seen:
                size += 1
            else:
                seen.add(piece)
                start, size = start + size, 1
        out.append(len(seen) / len(word))
    return out


# ---- quadratic entropies --------------------------------------------------------------------

def near_counts(x, m: int, tol: float):
    """For every template of length m the number of templates within tol (itself included)."""
    win = np.lib.stride_tricks.sliding_window_view(x, m)
    out = np.empty(len(win), dtype=np.int64)
    for lo in range(0, len(win), 256):
        dist = np.abs(win[lo:lo + 256, None, :] - win[None, :, :]).max(axis=2)
        out[lo:lo + 256] = (dist <= tol).sum(axis=1)
    return out


def sample_entropy(x, wanted):
    m, tol = 2, 0.2 * np.std(x)
    if len(x) <= m + 1:
        return [NAN] * len(wanted)
    b = (near_counts(x, m, tol) - 1).sum()
    a = (near_counts(x, m + 1, tol) - 1).sum()
    value = -math.log(a / b) if a > 0 and b > 0 else (float("inf") if b > 0 else NAN)
    return [value] * len(wanted)


def approximate_entropy(x, wanted):
    out = []
    for p in wanted:
        m, tol = p["m"], p["r"] * np.std(x)
        if len(x) <= m + 1:
            out.append(0.0)
            continue
        phi = [float(np.log(near_counts(x, k, tol) / (len(x) - k + 1.0)).sum() / (len(x) - k + 1.0)) for k in (m, m + 1)]
        out.append(abs(phi[0] - phi[1]))
    return out


KERNELS = {f.__name__: f for f in (fft_aggregated, number_cwt_peaks, lempel_ziv_complexity, sample_entropy, approximate_entropy)}


def series_features(x, groups) -> list:
    """Values of all wanted kernel features of one series: groups = [(calculator, [params, ..]), ..]."""
    x = np.asarray(x, dtype=float)
    out = []
    for name, wanted in groups:
        try:
            out.extend(KERNELS[name](x, wanted))
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError, IndexError):
            out.extend([NAN] * len(wanted))
    return out
