import math

import numpy as np
import pandas as pd
import pytest

from runlens.functions import kernels, names, partials, spectral_sums
from runlens.operators import features

from helpers import make_runs

RNG = np.random.RandomState(7)
SERIES = np.round(RNG.normal(size=130).cumsum(), 2)


def test_names_round_trip():
    for f in names.comprehensive():
        assert names.parse("dy_1__" + f.suffix) == ("dy_1", f)
    assert len({f.suffix for f in names.efficient()}) == len(names.efficient())
    assert names.feature("linear_trend", attr="slope").suffix == 'linear_trend__attr_"slope"'


@pytest.mark.parametrize("which", ["additive"])
def test_blocks_and_whole_runs_agree(spark, which):
    """A run cut into many blocks gives the same features as the same run in one block."""
    df, _ = make_runs(spark, {(0, 1): 700, (0, 2): 60, (1, 1): 149}, width=2)
    keys = ["faultNumber", "simulationRun", "feature"]
    a = features.extract_features(df, ["a", "b"], which, long_runs=False).toPandas().set_index(keys)["value"]
    b = features.extract_features(df, ["a", "b"], which, block=100).toPandas().set_index(keys)["value"]
    assert len(a) == 6 * len(names.SETS[which]()) and len(a) == len(b)
    b = b.loc[a.index]
    assert (a.isna() == b.isna()).all()
    gap = (a - b).abs() / (1e-6 + a.abs())
    assert gap.max() < 1e-6, gap.sort_values().tail()


def test_selected_features_only(spark):
    df, _ = make_runs(spark, {(0, 1): 40, (0, 2): 50}, width=3)
    want = ["b__mean", 'c__fft_coefficient__attr_"abs"__coeff_1', "c__number_peaks__n_1"]
    got = features.extract_selected(df, ["a", "b", "c"], want, long_runs=False)
    full = features.extract_features(df, ["a", "b", "c"], "efficient", long_runs=False)
    keys = ["simulationRun", "feature"]
    a = got.toPandas().set_index(keys)["value"].sort_index()
    b = full.where(full.feature.isin(want)).toPandas().set_index(keys)["value"].sort_index()
    assert len(a) == 6 and np.allclose(a, b)


def test_short_and_constant_series(spark):
    rows = [(0, 1, i + 1, i, [2.0]) for i in range(30)] + [(0, 2, 1, 0, [1.5])] + [(0, 3, i + 1, i, [float(i)]) for i in range(3)]
    df = spark.createDataFrame(rows, "faultNumber int, simulationRun int, sample int, t bigint, x array<double>")
    got = features.extract_features(df, ["v"], "comprehensive", long_runs=False).toPandas()
    assert got.groupby("simulationRun").size().nunique() == 1
    one = got[got.simulationRun == 1].set_index("feature")["value"]
    assert one["v__variance"] == 0 and one["v__binned_entropy__max_bins_10"] == 0 and one["v__has_duplicate"] == 1
    assert one["v__cid_ce__normalize_True"] == 0
    assert not np.isinf(got["value"].dropna()).any()


def series_values(spark, x, features, block=4000):
    """Features of one series through Spark: {calculator parameters: value}."""
    rows = [(0, 1, i + 1, i, [float(v)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "faultNumber int, simulationRun int, sample int, t bigint, x array<double>")
    got = features_of(df, features, block)
    return {names.parse(r["feature"])[1]: r["value"] for r in got.collect()}


def features_of(df, which, block):
    return features.extract_features(df, ["v"], which, block=block)


def pick(*calculators):
    return [f for f in names.comprehensive() if f.calculator in calculators]


@pytest.mark.parametrize("block", [4000, 50])
def test_spectrum_and_regressions_by_definition(spark, block):
    x = SERIES
    n = len(x)
    got = series_values(spark, x, pick("fft_coefficient", "ar_coefficient", "spkt_welch_density", "cwt_coefficients",
                                       "friedrich_coefficients", "permutation_entropy"), block)
    spec = np.fft.rfft(x)
    for f, v in got.items():
        p = dict(f.params)
        if f.calculator == "fft_coefficient":
            k = p["coeff"]
            want = {"real": np.real, "imag": np.imag, "abs": np.abs, "angle": lambda z: np.angle(z, deg=True)}[p["attr"]](
                spec[k]) if k < len(spec) else None
            if p["attr"] != "angle" or want is None or abs(spec[k]) > 1e-6 and abs(abs(want) - 180) > 1e-6:
                assert (v is None) == (want is None) and (v is None or math.isclose(v, want, rel_tol=1e-6, abs_tol=1e-6)), f
        elif f.calculator == "cwt_coefficients":
            taps = spectral_sums.hat(min(10 * p["w"], n), p["w"])
            assert math.isclose(v, np.convolve(x, taps[::-1], mode="same")[:n][p["coeff"]], rel_tol=1e-9, abs_tol=1e-9)
        elif f.calculator == "permutation_entropy":
            d = p["dimension"]
            codes = {}
            for i in range(n - d + 1):
                key = tuple(np.argsort(np.argsort(x[i:i + d], kind="stable"), kind="stable"))
                codes[key] = codes.get(key, 0) + 1
            share = np.array(list(codes.values())) / (n - d + 1)
            assert math.isclose(v, -(share * np.log(share)).sum(), rel_tol=1e-9)
    design = np.column_stack([np.ones(n - 10)] + [x[10 - k:n - k] for k in range(1, 11)])
    beta = np.linalg.lstsq(design, x[10:], rcond=None)[0]
    assert np.allclose([got[f] for f in pick("ar_coefficient")], beta, rtol=1e-6, atol=1e-8)
    edges = np.quantile(x[:-1], np.linspace(0, 1, 31))
    if (np.diff(edges) > 0).all():
        cell = np.clip(np.searchsorted(edges, x[:-1], side="left") - 1, 0, 29)
        own = [c for c in range(30) if (cell == c).any()]
        poly = np.polyfit([x[:-1][cell == c].mean() for c in own], [np.diff(x)[cell == c].mean() for c in own], 3)
        assert np.allclose([got[f] for f in pick("friedrich_coefficients")], poly, rtol=1e-6)


@pytest.mark.parametrize("block", [4000, 50])
def test_unit_root_lag_choice_by_refitting(spark, block):
    x = SERIES
    got = {f["attr"]: v for f, v in series_values(spark, x, pick("augmented_dickey_fuller"), block).items()}
    dx, most = np.diff(x), math.ceil(12 * (len(x) / 100) ** 0.25)

    def fit(lags, skip):
        y = dx[skip:]
        d = np.column_stack([np.ones(len(y)), x[skip:-1]] + [dx[skip - j:len(dx) - j] for j in range(1, lags + 1)])
        return y, d, *np.linalg.lstsq(d, y, rcond=None)[:2]

    aic = []
    for lags in range(most + 1):
        y, d, _, rss = fit(lags, most)
        aic.append(len(y) * (math.log(2 * math.pi * rss[0] / len(y)) + 1) + 2 * (lags + 2))
    used = int(np.argmin(aic))
    y, d, beta, rss = fit(used, used)
    stat = beta[1] / math.sqrt(rss[0] / (len(y) - d.shape[1]) * np.linalg.inv(d.T @ d)[1, 1])
    assert got["usedlag"] == used and math.isclose(got["teststat"], stat, rel_tol=1e-6) and 0 <= got["pvalue"] <= 1


def test_whole_series_kernels_by_definition():
    x = SERIES
    n = len(x)
    m, tol = 2, 0.2 * x.std()

    def matches(size):
        win = [x[i:i + size] for i in range(n - size + 1)]
        return sum(np.abs(a - b).max() <= tol for i, a in enumerate(win) for j, b in enumerate(win) if i != j)

    assert math.isclose(kernels.sample_entropy(x, [{}])[0], -math.log(matches(m + 1) / matches(m)))
    words, at, size = set(), 0, 1
    edges = np.linspace(x.min(), x.max(), 4)[1:]
    code = [int(np.sum(edges < v)) for v in x]
    while at + size <= n:
        w = tuple(code[at:at + size])
        if w in words:
            size += 1
        else:
            words.add(w)
            at, size = at + size, 1
    assert kernels.lempel_ziv_complexity(x, [{"bins": 3}])[0] == len(words) / n


def test_one_piece_calculators_stop_on_longer_series(spark):
    df, _ = make_runs(spark, {(0, 1): 120}, width=1)
    with pytest.raises(Exception, match="longer than one block"):
        features.extract_features(df, ["a"], pick("sample_entropy"), block=50).collect()
    with pytest.raises(Exception, match="exceeds one block"):
        features.extract_features(df, ["a"], pick("mean_abs_change"), block=50, long_runs=False).collect()


def test_welch_of_a_sine_peaks_at_its_frequency():
    x = np.sin(2 * np.pi * np.arange(512) * 32 / 256)
    assert spectral_sums.power(spectral_sums.welch_sums(x, 0, 512, 0, 512), 512).argmax() == 32
    noise = RNG.normal(size=200000)
    assert math.isclose(spectral_sums.power(spectral_sums.welch_sums(noise, 0, 200000, 0, 200000), 200000).mean() / 2, 1.0, rel_tol=0.05)


def test_ridge_peaks_find_both_bumps_whatever_the_last_digits():
    t = np.arange(100)
    x = np.exp(-((t - 30) / 4.0) ** 2) + 0.8 * np.exp(-((t - 71) / 5.0) ** 2) + 0.001 * t
    counts = {kernels.ridge_peaks(x + 1e-13 * np.random.RandomState(i).normal(size=100), 5) for i in range(5)}
    assert len(counts) == 1 and counts.pop() >= 2


def test_partial_autocorrelation_of_levinson():
    acov = [1.0, 0.5, 0.25, 0.125]
    assert np.allclose(partials.durbin_levinson(acov, 3), [1.0, 0.5, 0.0, 0.0])


def test_block_sums_add_up():
    x = SERIES
    qs = np.quantile(x, partials.PROBS)
    st = dict(n=len(x), mu=x.mean(), var=x.var(), mn=x.min(), mx=x.max(), sa=np.abs(x).sum())
    lags = spectral_sums.most_lags(len(x))
    fam, edges = [*partials.SIZES, *spectral_sums.sizes(lags)], np.quantile(x[:-1], spectral_sums.CELL_EDGES)
    whole = partials.block_sums(fam, x, 0, len(x), 0, *st.values(), 0.0, qs, edges, lags)
    assert len(whole) == sum({**partials.SIZES, **spectral_sums.sizes(lags)}[f] for f in fam)
    total, base = 0, 0.0
    for t0 in range(0, len(x), 50):
        lo, hi = max(0, t0 - 50), min(len(x), t0 + 50 + 256)
        m = min(50, len(x) - t0)
        total = total + partials.block_sums(fam, x[lo:hi], t0 - lo, m, t0, *st.values(), base, qs, edges, lags)
        base += np.abs(x[t0:t0 + m]).sum()
    assert np.allclose(whole, total)


@pytest.mark.parametrize("block", [4000, 16])
@pytest.mark.parametrize("length", [4, 9, 13, 120])
def test_autoregression_and_drift_of_any_order(spark, block, length):
    x = SERIES[:length]
    orders, degrees = (1, 2, 3, 7, 10), (1, 2, 4)
    which = [names.feature("ar_coefficient", coeff=c, k=k) for k in orders for c in range(k + 2)]
    which += [names.feature("friedrich_coefficients", coeff=c, m=m, r=30) for m in degrees for c in range(m + 2)]
    which += [names.feature("max_langevin_fixed_point", m=m, r=30) for m in degrees]
    got = series_values(spark, x, which, block)
    edges = np.quantile(x[:-1], np.linspace(0, 1, 31))
    cell = np.clip(np.searchsorted(edges, x[:-1], side="left") - 1, 0, 29)
    drifts = length > 30 and (np.diff(edges) > 0).all()
    own = [c for c in range(30) if (cell == c).any()]
    for f, v in got.items():
        p = dict(f.params)
        want = None
        if f.calculator == "ar_coefficient":
            k = p["k"]
            if length > 2 * k + 1 and p["coeff"] <= k:
                design = np.column_stack([np.ones(length - k)] + [x[k - j:length - j] for j in range(1, k + 1)])
                want = np.linalg.lstsq(design, x[k:], rcond=None)[0][p["coeff"]]
        elif drifts:
            poly = np.polyfit([x[:-1][cell == c].mean() for c in own], [np.diff(x)[cell == c].mean() for c in own], p["m"])
            want = np.real(np.roots(poly)).max() if "coeff" not in p else poly[p["coeff"]] if p["coeff"] <= p["m"] else None
        assert (v is None) == (want is None) and (v is None or math.isclose(v, want, rel_tol=1e-5, abs_tol=1e-7)), (f, v, want)


def test_feature_batches_leave_in_slices():
    """However many series an Arrow batch has, results are passed on slice by slice."""
    rng, n, many = np.random.RandomState(3), 40, 2 * features.SLICE + 10
    plan = features.Plan(names.efficient())
    a = [np.cumsum(rng.normal(size=n)) for _ in range(many)]
    st = {"n": n, "mu": [x.mean() for x in a], "var": [x.var() for x in a], "mn": [x.min() for x in a], "mx": [x.max() for x in a],
          "sa": [np.abs(x).sum() for x in a], "ss": [x @ x for x in a], "rv": 0.5}
    quantiles = [[float(q) for q in np.quantile(x, features.pt.PROBS)] for x in a]
    s = pd.DataFrame({"a": a, "o": 0, "m": n, "t0": 0, **st, "base": 0.0, "qs": quantiles,
                      "dq": [np.quantile(x[:-1], features.CELL_EDGES) for x in a]})
    run = features.one_block_udf(plan.summed, plan.families, plan.groups).func
    parts = list(run(iter([s])))
    assert [len(p) for p in parts] == [features.SLICE, features.SLICE, 10]
    whole = np.array([v for p in parts for v in p])
    alone = np.array([v for i in (0, 300, many - 1) for v in next(iter(run(iter([s.iloc[[i]]]))))])
    assert whole.shape == (many, len(plan.summed) + len(plan.kernel))
    assert np.allclose(whole[[0, 300, many - 1]], alone.reshape(3, -1), equal_nan=True)
