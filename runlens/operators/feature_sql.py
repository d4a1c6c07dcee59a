"""SQL formulas of the features that Spark's own aggregates and array functions express.

PLAIN   aggregates over the samples of a series, no order needed
WHOLE   value-level results: quantiles and repeated values, from the sorted values ``sw``
NATIVE  results of one block (own values ``w``) that are merged by min, max, top or strike folding
final   formula of a feature over these columns, or None for the Arrow families
"""

from __future__ import annotations

from ..functions.names import Feature
from ..functions.partials import PROBS
from ..functions.spectral_sums import CELL_EDGES

PLAIN = {
    "n": "count(v)", "mu": "avg(v)", "var": "var_pop(v)", "mn": "min(v)", "mx": "max(v)", "s": "sum(v)",
    "ss": "sum(v*v)", "sa": "sum(abs(v))", "sk": "skewness(v)", "ku": "kurtosis(v)",
    "v_first": "min_by(v, t)", "v_last": "max_by(v, t)",
    "slope": "regr_slope(v, t)", "icept": "regr_intercept(v, t)", "rv": "try_divide(covar_pop(v, t), stddev_pop(v) * stddev_pop(t))",
    "ca0": "count_if(v >= 0)", "cb0": "count_if(v <= 0)",
    "vc0": "count_if(v = 0)", "vc1": "count_if(v = 1)", "vcm1": "count_if(v = -1)",
    "rc1": "count_if(v >= -1 and v < 1)", "rcneg": "count_if(v >= -1e12D and v < 0)",
    "rcpos": "count_if(v >= 0 and v < 1e12D)",
    **{f"dg{d}": f"count_if(substring(ltrim('0.', cast(abs(v) as string)), 1, 1) = '{d}')" for d in range(1, 10)},
}


def total(array: str) -> str:
    return f"aggregate({array}, 0D, (acc, e) -> acc + e)"


def quantile_list(probs) -> str:
    """Quantiles with linear interpolation in the sorted values ``sw`` of a whole series."""
    shares = ", ".join(f"{p!r}D" for p in probs)
    low = "cast(floor(p * (size(sw) - 1)) as int)"
    return (f"transform(array({shares}), p -> sw[{low}] + (sw[least({low} + 1, size(sw) - 1)] - sw[{low}]) "
            f"* (p * (size(sw) - 1) - floor(p * (size(sw) - 1))))")


WHOLE = {
    "qs": quantile_list(PROBS),
    # Borders of the drift cells: quantiles of all values but the last one.
    "sp": "array_sort(slice(w, 1, greatest(size(w) - 1, 1)))",
    "dq": quantile_list(CELL_EDGES).replace("sw", "sp"),
    "ndist": "cast(size(array_distinct(w)) as bigint)",
    "revals": "filter(sw, (e, i) -> i + 1 < size(sw) and e = get(sw, i + 1) and (i = 0 or get(sw, i - 1) <> e))",
    "repoints": "filter(sw, (e, i) -> (i > 0 and get(sw, i - 1) = e) or (i + 1 < size(sw) and get(sw, i + 1) = e))",
    "nreval": "cast(size(revals) as bigint)",
    "nrepoint": "cast(size(repoints) as bigint)",
    "sreval": total("revals"),
    "srepoint": total("repoints"),
}

STRIKE = ("aggregate(w, named_struct('cur', 0L, 'best', 0L, 'pre', 0L, 'open', true), (acc, e) -> if({test}, "
          "named_struct('cur', acc.cur + 1L, 'best', greatest(acc.best, acc.cur + 1L), 'pre', "
          "if(acc.open, acc.pre + 1L, acc.pre), 'open', acc.open), "
          "named_struct('cur', 0L, 'best', acc.best, 'pre', acc.pre, 'open', false)))")

NATIVE = {
    "strike_a": (STRIKE.format(test="e > mu"), "strike"),
    "strike_b": (STRIKE.format(test="e < mu"), "strike"),
    "fmx": ("if(array_contains(w, mx), t0 + array_position(w, mx) - 1, null)", "min"),
    "fmn": ("if(array_contains(w, mn), t0 + array_position(w, mn) - 1, null)", "min"),
    "lmx": ("if(array_contains(w, mx), t0 + m - array_position(reverse(w), mx), null)", "max"),
    "lmn": ("if(array_contains(w, mn), t0 + m - array_position(reverse(w), mn), null)", "max"),
    "top7": ("slice(sort_array(transform(w, e -> abs(e)), false), 1, 7)", "top"),
}


def ratio(a: str, b: str) -> str:
    return f"try_divide(cast({a} as double), cast({b} as double))"


SD = "sqrt(var)"
MEDIAN = f"qs[{PROBS.index(0.5)}]"
SIMPLE = {
    "sum_values": "s", "mean": "mu", "length": "n", "maximum": "mx", "minimum": "mn",
    "absolute_maximum": "greatest(abs(mx), abs(mn))", "variance": "var", "standard_deviation": SD,
    "root_mean_square": "sqrt(ss / n)", "abs_energy": "ss", "median": MEDIAN,
    "variation_coefficient": ratio(SD, "mu"),
    "skewness": "if(n < 3, null, if(var = 0, 0D, sk * sqrt(n * (n - 1D)) / nullif(n - 2D, 0D)))",
    "kurtosis": "if(n < 4, null, if(var = 0, 0D, try_divide((n - 1D) * ((n + 1D) * ku + 6D), (n - 2D) * (n - 3D))))",
    "variance_larger_than_standard_deviation": f"if(var > {SD}, 1, 0)",
    "has_duplicate": "if(ndist < n, 1, 0)",
    "percentage_of_reoccurring_values_to_all_values": ratio("nreval", "ndist"),
    "percentage_of_reoccurring_datapoints_to_all_datapoints": ratio("nrepoint", "n"),
    "sum_of_reoccurring_values": "sreval", "sum_of_reoccurring_data_points": "srepoint",
    "ratio_value_number_to_time_series_length": ratio("ndist", "n"),
    "first_location_of_maximum": ratio("fmx", "n"), "first_location_of_minimum": ratio("fmn", "n"),
    "last_location_of_maximum": ratio("lmx + 1", "n"), "last_location_of_minimum": ratio("lmn + 1", "n"),
    "mean_change": ratio("v_last - v_first", "n - 1"),
    "longest_strike_above_mean": "strike_a.best", "longest_strike_below_mean": "strike_b.best",
    "mean_n_absolute_max": "if(n > 7, " + total("top7") + " / 7D, null)",
    "count_above": ratio("ca0", "n"), "count_below": ratio("cb0", "n"),
}


def _benford() -> str:
    # Share of numbers whose first digit is d, log10(1 + 1/d).
    share = [f"log10(1D + 1D / {d}D)" for d in range(1, 10)]
    seen = [f"(dg{d} / n)" for d in range(1, 10)]
    mean = "((" + " + ".join(seen) + ") / 9D)"
    cross = " + ".join(f"({a} - 1D / 9D) * ({b} - {mean})" for a, b in zip(share, seen))
    ssx = " + ".join(f"pow({a} - 1D / 9D, 2)" for a in share)
    ssy = " + ".join(f"pow({b} - {mean}, 2)" for b in seen)
    return ratio(f"({cross})", f"sqrt(({ssx}) * ({ssy}))")


SIMPLE["benford_correlation"] = _benford()


def final(f: Feature) -> str | None:
    c, p = f.calculator, dict(f.params)
    if c in SIMPLE:
        return SIMPLE[c]
    if c == "quantile":
        return f"qs[{PROBS.index(p['q'])}]"
    if c == "value_count":
        return {0: "vc0", 1: "vc1", -1: "vcm1"}[p["value"]]
    if c == "range_count":
        return {1: "rc1", 0: "rcneg", 1e12: "rcpos"}[p["max"]]
    if c == "large_standard_deviation":
        return f"if({SD} > {p['r']!r}D * (mx - mn), 1, 0)"
    if c == "symmetry_looking":
        return f"if(abs(mu - {MEDIAN}) < {p['r']!r}D * (mx - mn), 1, 0)"
    if c == "linear_trend" and p["attr"] != "pvalue":
        r = "coalesce(rv, 0D)"
        return {"slope": "slope", "intercept": "icept", "rvalue": r,
                "stderr": f"if(n > 2, sqrt((1D - {r} * {r}) * var * 12D / (n * n - 1D) / nullif(n - 2D, 0D)), 0D)"}[p["attr"]]
    return None
