"""Order-dependent sums over one block of a series, and the features formed from their totals.

Every family yields a fixed number of additive values, so block results of a long series are summed by
Spark before ``finish`` turns them into features (vectorised over the series of a batch).
"""

from __future__ import annotations

import numpy as np

from . import spectral_sums as ss
from .names import EDGES, PEAKS, QUANTILES, SIGMAS
from .special import student_two_sided

LAGS = 40
CHUNKS = (5, 10, 50)
CHUNK_STATS = ("max", "min", "mean", "var")
CROSSINGS = (0, -1, 1)
PAIRS = [(i, j) for i in range(len(EDGES) - 1) for j in range(i + 1, len(EDGES))]
PROBS = tuple(sorted({*QUANTILES, 0.5, *EDGES}))

# family -> number of additive values
SIZES = {"change": 3, "c3": 3, "reversal": 3, "acorr": LAGS, "cross": 3, "peaks": len(PEAKS), "mass": len(QUANTILES),
         "energy": 10, "chunks": 3 * len(CHUNKS) * len(CHUNK_STATS), "sigma": len(SIGMAS), "bins": 10,
         "corridor": 4 * len(PAIRS), "counts": 4}

FAMILY = {"absolute_sum_of_changes": "change", "mean_abs_change": "change", "cid_ce": "change",
          "mean_second_derivative_central": "change", "c3": "c3", "time_reversal_asymmetry_statistic": "reversal",
          "autocorrelation": "acorr", "agg_autocorrelation": "acorr", "partial_autocorrelation": "acorr",
          "number_crossing_m": "cross", "number_peaks": "peaks", "index_mass_quantile": "mass",
          "energy_ratio_by_chunks": "energy", "agg_linear_trend": "chunks", "ratio_beyond_r_sigma": "sigma",
          "binned_entropy": "bins", "change_quantiles": "corridor", "count_above_mean": "counts",
          "count_below_mean": "counts", "has_duplicate_max": "counts", "has_duplicate_min": "counts",
          "fft_coefficient": "fft", "spkt_welch_density": "welch", "fourier_entropy": "welch", "cwt_coefficients": "cwt",
          "permutation_entropy": "perm", "ar_coefficient": "ar", "augmented_dickey_fuller": "adf",
          "friedrich_coefficients": "drift", "max_langevin_fixed_point": "drift"}
# Samples before and after a block that a family needs (default: the widest peak); the unit root needs its lags.
REACH = {"welch": (0, ss.SEGMENT), "cwt": (0, ss.HEAD_REACH), "ar": (ss.ORDER, 0), "perm": (0, max(ss.DIMENSIONS))}


def halo(families, lags: int) -> tuple:
    """(before, after) in samples for a list of families."""
    reach = [REACH.get(f, (lags + 1, 2) if f == "adf" else (max(PEAKS), max(PEAKS))) for f in families]
    return max((r[0] for r in reach), default=0), max((r[1] for r in reach), default=0)


def supported(f) -> bool:
    """Parameter values with their own sums."""
    p = dict(f.params)
    return {"fft_coefficient": lambda: p["coeff"] < ss.FFT, "permutation_entropy": lambda: p["tau"] == 1 and p["dimension"] in ss.DIMENSIONS,
            "cwt_coefficients": lambda: p["coeff"] < ss.HEAD and p["w"] in ss.WIDTHS, "ar_coefficient": lambda: 1 <= p["k"] <= ss.ORDER,
            "friedrich_coefficients": lambda: 0 < p["m"] < ss.CELLS and p["r"] == ss.CELLS,
            "max_langevin_fixed_point": lambda: 0 < p["m"] < ss.CELLS and p["r"] == ss.CELLS}.get(f.calculator, lambda: True)()


def _peaks(a, o, m):
    p = np.arange(max(o, 1), min(o + m, len(a) - 1))
    p = p[(a[p] > a[p - 1]) & (a[p] > a[p + 1])]
    out = []
    for n in PEAKS:
        p = p[(p >= n) & (p + n < len(a))]
        if len(p):
            top = np.lib.stride_tricks.sliding_window_view(a, n).max(axis=1)
            p = p[(a[p] > top[p - n]) & (a[p] > top[p + 1])]
        out.append(len(p))
    return out


def _chunks(w, t0, mu):
    out = []
    for c in CHUNKS:
        full = len(w) // c
        body, tail = w[:full * c].reshape(full, c), w[full * c:]
        i = t0 // c + np.arange(full + (len(tail) > 0), dtype=float)
        for name in CHUNK_STATS:
            y = getattr(body, name)(axis=1) if full else np.empty(0)
            if len(tail):
                y = np.append(y, getattr(tail, name)())
            if name != "var":
                y = y - mu
            out += [y.sum(), y @ y, i @ y]
    return out


def _energy(w, t0, n):
    q, r = divmod(n, 10)
    edges = np.clip([s * q + min(s, r) - t0 for s in range(11)], 0, len(w))
    return [float(w[a:b] @ w[a:b]) for a, b in zip(edges[:-1], edges[1:])]


def _corridor(x, y, qs):
    low, high, d = np.minimum(x, y), np.maximum(x, y), y - x
    out = []
    for i, j in PAIRS:
        lo, hi = qs[PROBS.index(EDGES[i])], qs[PROBS.index(EDGES[j])]
        e = d[(low >= lo) & (high <= hi)] if lo < hi else d[:0]
        out += [len(e), e.sum(), np.abs(e).sum(), e @ e]
    return out


def block_sums(families, a, o, m, t0, n, mu, var, mn, mx, sa, base, qs, edges=(), lags=None) -> np.ndarray:
    """Additive values of the own samples a[o:o+m]; the halo serves pairs that reach beyond them. ``lags`` are those of the
    unit root, by default what the length n of the series asks for."""
    w = a[o:o + m]
    c = a - mu

    def ahead(v, lag):
        return v[o:max(o, min(o + m, len(v) - lag))], lag

    def shifted(v, part, lag):
        return v[o + lag:o + lag + len(part)]

    parts: list = []
    x, _ = ahead(a, 1)
    y = shifted(a, x, 1)
    for family in families:
        out: list = []
        if family == "change":
            z0, _ = ahead(a, 2)
            d = y - x
            out += [np.abs(d).sum(), d @ d, (shifted(a, z0, 2) - 2 * shifted(a, z0, 1) + z0).sum()]
        elif family in ("c3", "reversal"):
            for lag in (1, 2, 3):
                u, _ = ahead(a, 2 * lag)
                v, z = shifted(a, u, lag), shifted(a, u, 2 * lag)
                out.append((u * v * z).sum() if family == "c3" else (z * z * v - v * u * u).sum())
        elif family == "acorr":
            for lag in range(1, LAGS + 1):
                u, _ = ahead(c, lag)
                out.append(u @ shifted(c, u, lag))
        elif family == "cross":
            out += [((x > k) != (y > k)).sum() for k in CROSSINGS]
        elif family == "peaks":
            out += _peaks(a, o, m)
        elif family == "mass":
            share = (base + np.cumsum(np.abs(w))) / sa if sa > 0 else np.ones(m)
            out += [(share < p).sum() for p in QUANTILES]
        elif family == "energy":
            out += _energy(w, t0, n)
        elif family == "chunks":
            out += _chunks(w, t0, mu)
        elif family == "sigma":
            out += [(np.abs(w - mu) > r * np.sqrt(var)).sum() for r in SIGMAS]
        elif family == "bins":
            k = np.minimum(9, np.floor((w - mn) / (mx - mn) * 10.0)).astype(int) if mx > mn else np.zeros(m, int)
            out += np.bincount(k, minlength=10).tolist()
        elif family == "corridor":
            out += _corridor(x, y, qs)
        elif family == "counts":
            out += [(w > mu).sum(), (w < mu).sum(), (w == mx).sum(), (w == mn).sum()]
        else:
            out = ss.block_values(family, a, c, o, m, t0, n, np.asarray(edges, dtype=float), lags)
        parts.append(np.asarray(out, dtype=float))
    return np.concatenate(parts) if parts else np.empty(0)


def in_order(families) -> list:
    """The unit root last: its numbers grow with the series."""
    return [f for f in families if f != "adf"] + [f for f in families if f == "adf"]


def places(families) -> dict:
    """family -> slice of its values in the concatenated vector; the unit root has the rest of it."""
    size = {**SIZES, **ss.SIZES}
    out, at = {}, 0
    for f in families:
        out[f] = slice(at, None if f == "adf" else at + size[f])
        at += size.get(f, 0)
    return out


def durbin_levinson(acov, lags: int) -> list:
    """Partial autocorrelations 0..lags from autocovariances."""
    out = [1.0]
    phi: list = []
    err = acov[0]
    for k in range(1, lags + 1):
        if k >= len(acov) or not err or not np.isfinite(acov[k]):
            out.append(np.nan)
            continue
        a = (acov[k] - sum(p * acov[k - 1 - j] for j, p in enumerate(phi))) / err
        phi = [p - a * q for p, q in zip(phi, phi[::-1])] + [a]
        err *= 1.0 - a * a
        out.append(float(a))
    return out


def _div(a, b):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


def _trend(n, size, name, y, yy, iy, mu):
    """Regression of the chunk values on the chunk number."""
    k = np.ceil(n / size)
    sxx, sxy = k * (k * k - 1) / 12.0, iy - (k - 1) / 2.0 * y
    syy = np.maximum(0.0, yy - y * y / k)
    slope = _div(sxy, sxx)
    r = np.nan_to_num(np.clip(_div(sxy, np.sqrt(sxx * syy)), -1.0, 1.0))
    shift = 0.0 if name == "var" else mu
    err = np.where(k > 2, np.sqrt(_div(_div((1 - r * r) * syy, sxx), k - 2)), 0.0)
    return {"slope": slope, "intercept": shift + y / k - slope * (k - 1) / 2.0, "rvalue": r, "stderr": err}


def finish(features, families, rows: list, st: dict) -> np.ndarray:
    """Feature matrix (series x features) from summed block values (one vector per series) and series statistics."""
    at = places(families)
    common = at["adf"].start if "adf" in at else None
    v = np.array([r[:common] for r in rows]).reshape(len(rows), -1)
    n, mu, var = st["n"], st["mu"], st["var"]
    sd = np.sqrt(var)
    acs = None
    if "acorr" in at:
        steps = np.arange(1, LAGS + 1)
        acov = np.where(n[:, None] > steps, _div(v[:, at["acorr"]], np.maximum(n[:, None] - steps, 1)), np.nan)
        acs = _div(acov, var[:, None])
        pacf_lag = max([f["lag"] for f in features if f.calculator == "partial_autocorrelation"], default=0)
        pacf = np.array([durbin_levinson([var[i], *acov[i, :pacf_lag]], pacf_lag) for i in range(len(n))]) if pacf_lag else None
    if "adf" in at:
        roots: dict = {}
        flat = st["mn"] == st["mx"]
    powers = list(map(ss.power, v[:, at["welch"]], n)) if "welch" in at else None
    orders: dict = {}  # autoregressions by order
    drifts: dict = {}  # drift polynomials by degree
    out = []
    for f in features:
        c, p = f.calculator, dict(f.params)
        part = v[:, at[FAMILY[c]]] if c in FAMILY and FAMILY[c] != "adf" else None
        if c == "absolute_sum_of_changes":
            got = part[:, 0]
        elif c == "mean_abs_change":
            got = _div(part[:, 0], n - 1)
        elif c == "cid_ce":
            got = np.sqrt(part[:, 1])
            if p["normalize"]:
                got = np.where(sd > 0, _div(got, sd), 0.0)
        elif c == "mean_second_derivative_central":
            got = np.where(n > 2, _div(part[:, 2], 2.0 * (n - 2)), np.nan)
        elif c in ("c3", "time_reversal_asymmetry_statistic"):
            k = p["lag"]
            got = np.where(n > 2 * k, _div(part[:, k - 1], n - 2.0 * k), 0.0)
        elif c == "autocorrelation":
            got = np.where(var > 0, 1.0, np.nan) if p["lag"] == 0 else acs[:, p["lag"] - 1]
        elif c == "agg_autocorrelation":
            fn = {"mean": np.nanmean, "median": np.nanmedian, "var": np.nanvar}[p["f_agg"]]
            got = np.array([0.0 if n[i] < 2 or var[i] < 1e-10 else fn(acs[i, :min(p["maxlag"], int(n[i]) - 1)])
                            for i in range(len(n))])
        elif c == "partial_autocorrelation":
            got = pacf[:, p["lag"]] if pacf is not None else np.ones(len(n))
        elif c == "number_crossing_m":
            got = part[:, CROSSINGS.index(p["m"])]
        elif c == "number_peaks":
            got = part[:, PEAKS.index(p["n"])]
        elif c == "index_mass_quantile":
            got = np.where(st["sa"] > 0, (part[:, QUANTILES.index(p["q"])] + 1) / n, np.nan)
        elif c == "energy_ratio_by_chunks":
            got = _div(part[:, p["segment_focus"]], st["ss"])
        elif c == "agg_linear_trend":
            k = 3 * (CHUNKS.index(p["chunk_len"]) * len(CHUNK_STATS) + CHUNK_STATS.index(p["f_agg"]))
            got = _trend(n, p["chunk_len"], p["f_agg"], part[:, k], part[:, k + 1], part[:, k + 2], mu)[p["attr"]]
            got = np.where(n > p["chunk_len"], got, np.nan)
        elif c == "ratio_beyond_r_sigma":
            got = part[:, SIGMAS.index(p["r"])] / n
        elif c == "binned_entropy":
            share = part / n[:, None]
            got = -np.where(share > 0, share * np.log(np.where(share > 0, share, 1.0)), 0.0).sum(axis=1)
        elif c == "change_quantiles":
            k = 4 * PAIRS.index((EDGES.index(p["ql"]), EDGES.index(p["qh"])))
            mean = _div(part[:, k + (2 if p["isabs"] else 1)], part[:, k])
            got = mean if p["f_agg"] == "mean" else np.maximum(0.0, _div(part[:, k + 3], part[:, k]) - mean ** 2)
            got = np.where(part[:, k] > 0, got, 0.0)
        elif c in ("count_above_mean", "count_below_mean"):
            got = part[:, 0 if c == "count_above_mean" else 1]
        elif c in ("has_duplicate_max", "has_duplicate_min"):
            got = (part[:, 2 if c == "has_duplicate_max" else 3] >= 2).astype(float)
        elif c == "fft_coefficient":
            got = ss.finish_fft(part, n, p["attr"], p["coeff"])
        elif c == "spkt_welch_density":
            got = ss.finish_welch(powers, p["coeff"])
        elif c == "fourier_entropy":
            got = ss.finish_fourier_entropy(powers, p["bins"])
        elif c == "cwt_coefficients":
            got = ss.finish_wavelet(part, n, p["w"], p["coeff"])
        elif c == "permutation_entropy":
            got = ss.finish_patterns(part, p["dimension"])
        elif c == "ar_coefficient":
            if p["k"] not in orders:
                orders[p["k"]] = ss.finish_ar(part, n, mu, p["k"])
            got = orders[p["k"]][:, p["coeff"]] if p["coeff"] <= p["k"] else np.full(len(n), np.nan)
        elif c in ("friedrich_coefficients", "max_langevin_fixed_point"):
            k, degree = p.get("coeff", p["m"] + 1), p["m"]
            if degree not in drifts:
                drifts[degree] = ss.finish_drift(part, degree)
            got = drifts[degree][:, k] if c == "max_langevin_fixed_point" or k <= degree else np.full(len(n), np.nan)
        elif c == "augmented_dickey_fuller":
            lags = p.get("lags")
            if lags not in roots:
                roots[lags] = ss.finish_unit_root([r[common:] for r in rows], n, lags)
            got = np.where(flat, np.nan, roots[lags][:, ("teststat", "pvalue", "usedlag").index(p["attr"])])
        elif c == "linear_trend":
            got = np.array([_slope_p(r, k) for r, k in zip(np.nan_to_num(st["rv"]), n)])
        out.append(got)
    return np.column_stack(out) if out else np.empty((len(n), 0))


def _slope_p(r: float, n: float) -> float:
    """Two-sided p of a zero slope."""
    if n < 3:
        return 0.0 if n == 2 and r != 0 else 1.0
    dof = n - 2.0
    return student_two_sided(r * np.sqrt(dof / ((1.0 - r + 1e-20) * (1.0 + r + 1e-20))), dof)
