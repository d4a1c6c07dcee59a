"""Feature names: ``channel__calculator__param_value__..`` with parameters in name order, and the sets."""

from __future__ import annotations

import ast
from dataclasses import dataclass


@dataclass(frozen=True)
class Feature:
    """One calculator with its parameters (sorted name/value pairs)."""

    calculator: str
    params: tuple = ()

    @property
    def suffix(self) -> str:
        parts = [self.calculator]
        for key, value in self.params:
            parts.append(f'{key}_"{value}"' if isinstance(value, str) else f"{key}_{value}")
        return "__".join(parts)

    def __getitem__(self, name):
        return dict(self.params)[name]


def feature(calculator: str, **params) -> Feature:
    return Feature(calculator, tuple(sorted(params.items())))


def parse(name: str) -> tuple:
    """(channel, Feature) of a full feature name."""
    channel, calculator, *rest = name.split("__")
    params = []
    for part in rest:
        key, _, text = part.rpartition("_")
        if "_(" in part:
            key, text = part.split("_(", 1)
            text = "(" + text
        elif part.endswith('"'):
            key, text = part[:-1].split('_"', 1)
            text = f"'{text}'"
        params.append((key, ast.literal_eval(text)))
    return channel, Feature(calculator, tuple(sorted(params)))


def by_channel(names) -> dict:
    """{channel: [Feature, ..]} for a list of full names."""
    out: dict = {}
    for n in names:
        channel, f = parse(n)
        out.setdefault(channel, []).append(f)
    return out


# Fixed parameter values of the public feature sets.
WIDTHS = (2, 5, 10, 20)
EDGES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)
SIGMAS = (0.5, 1, 1.5, 2, 2.5, 3, 5, 6, 7, 10)
PEAKS = (1, 3, 5, 10, 50)


def minimal() -> list:
    return [feature(c) for c in ("sum_values", "median", "mean", "length", "standard_deviation", "variance",
                                 "root_mean_square", "maximum", "absolute_maximum", "minimum")]


def efficient() -> list:
    """All calculators with cost up to n log n (about 780 per channel)."""
    out = minimal() + [feature(c) for c in (
        "variance_larger_than_standard_deviation", "has_duplicate_max", "has_duplicate_min", "has_duplicate",
        "abs_energy", "mean_abs_change", "mean_change", "mean_second_derivative_central", "variation_coefficient",
        "skewness", "kurtosis", "absolute_sum_of_changes", "longest_strike_below_mean", "longest_strike_above_mean",
        "count_above_mean", "count_below_mean", "last_location_of_maximum", "first_location_of_maximum",
        "last_location_of_minimum", "first_location_of_minimum", "percentage_of_reoccurring_values_to_all_values",
        "percentage_of_reoccurring_datapoints_to_all_datapoints", "sum_of_reoccurring_values",
        "sum_of_reoccurring_data_points", "ratio_value_number_to_time_series_length", "benford_correlation")]
    out += [feature(c, lag=i) for c in ("time_reversal_asymmetry_statistic", "c3") for i in (1, 2, 3)]
    out += [feature("cid_ce", normalize=b) for b in (True, False)]
    out += [feature("symmetry_looking", r=i * 0.05) for i in range(20)]
    out += [feature("large_standard_deviation", r=i * 0.05) for i in range(1, 20)]
    out += [feature("quantile", q=v) for v in QUANTILES]
    out += [feature("autocorrelation", lag=i) for i in range(10)]
    out += [feature("agg_autocorrelation", f_agg=f, maxlag=40) for f in ("mean", "median", "var")]
    out += [feature("partial_autocorrelation", lag=i) for i in range(10)]
    out += [feature("number_cwt_peaks", n=n) for n in (1, 5)]
    out += [feature("number_peaks", n=n) for n in PEAKS]
    out += [feature("binned_entropy", max_bins=10)]
    out += [feature("index_mass_quantile", q=v) for v in QUANTILES]
    out += [feature("cwt_coefficients", widths=WIDTHS, coeff=c, w=w) for c in range(15) for w in WIDTHS]
    out += [feature("spkt_welch_density", coeff=c) for c in (2, 5, 8)]
    out += [feature("ar_coefficient", coeff=c, k=10) for c in range(11)]
    out += [feature("change_quantiles", ql=lo, qh=hi, isabs=b, f_agg=f) for i, lo in enumerate(EDGES[:-1])
            for hi in EDGES[i + 1:] for b in (False, True) for f in ("mean", "var")]
    out += [feature("fft_coefficient", coeff=k, attr=a) for a in ("real", "imag", "abs", "angle") for k in range(100)]
    out += [feature("fft_aggregated", aggtype=a) for a in ("centroid", "variance", "skew", "kurtosis")]
    out += [feature("value_count", value=v) for v in (0, 1, -1)]
    out += [feature("range_count", min=a, max=b) for a, b in ((-1, 1), (-1e12, 0), (0, 1e12))]
    out += [feature("friedrich_coefficients", coeff=c, m=3, r=30) for c in range(4)]
    out += [feature("max_langevin_fixed_point", m=3, r=30)]
    out += [feature("linear_trend", attr=a) for a in ("pvalue", "rvalue", "intercept", "slope", "stderr")]
    out += [feature("agg_linear_trend", attr=a, chunk_len=c, f_agg=f) for a in ("rvalue", "intercept", "slope", "stderr")
            for c in (5, 10, 50) for f in ("max", "min", "mean", "var")]
    out += [feature("augmented_dickey_fuller", attr=a, autolag="AIC") for a in ("teststat", "pvalue", "usedlag")]
    out += [feature("number_crossing_m", m=m) for m in (0, -1, 1)]
    out += [feature("energy_ratio_by_chunks", num_segments=10, segment_focus=s) for s in range(10)]
    out += [feature("ratio_beyond_r_sigma", r=r) for r in SIGMAS]
    out += [feature("count_above", t=0), feature("count_below", t=0)]
    out += [feature("lempel_ziv_complexity", bins=b) for b in (2, 3, 5, 10, 100)]
    out += [feature("fourier_entropy", bins=b) for b in (2, 3, 5, 10, 100)]
    out += [feature("permutation_entropy", tau=1, dimension=d) for d in (3, 4, 5, 6, 7)]
    out += [feature("mean_n_absolute_max", number_of_maxima=7)]
    return out


def comprehensive() -> list:
    """The efficient set and the two entropies of quadratic cost."""
    return efficient() + [feature("sample_entropy")] + [
        feature("approximate_entropy", m=2, r=r) for r in (0.1, 0.3, 0.5, 0.7, 0.9)]


# Calculators that need a series in one piece; they are defined for series of one block.
ONE_PIECE = ("fft_aggregated", "number_cwt_peaks", "lempel_ziv_complexity", "sample_entropy", "approximate_entropy")


def additive() -> list:
    """The efficient set without the calculators that need a series in one piece: for series of any length."""
    return [f for f in efficient() if f.calculator not in ONE_PIECE]


SETS = {"additive": additive, "minimal": minimal, "efficient": efficient, "comprehensive": comprehensive}
