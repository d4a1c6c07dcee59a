"""Features of the user series (one channel ``value``), long form: simulationRun, feature, value."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import names as fn
from runlens.functions.names import EDGES, PEAKS, QUANTILES, SIGMAS, feature
from runlens.operators import features as ft

from .views import SQL, long_series, q, rnd, user_series, with_views

E = fn.efficient()
K = '"simulationRun"'
ROW = f'PARTITION BY {K} ORDER BY sample'


def family(*calculators) -> list:
    return [f for f in fn.comprehensive() if f.calculator in calculators]


def run(features, digits=4, block=4000):
    def query(spark, sf):
        long = ft.extract_features(user_series(spark, sf), ["value"], features, block=block, long_runs=block < 1000)
        finite = F.when(F.abs("value") < float("inf"), F.col("value"))
        return long.select("simulationRun", "feature", rnd(finite, digits).alias("value"))
    return query


BASE = f"""g AS (SELECT {K}, count(*)::DOUBLE AS n, avg(v) AS mu, var_pop(v) AS var, stddev_pop(v) AS sd, min(v) AS mn, max(v) AS mx,
 sum(v) AS s, sum(v*v) AS ss, sum(abs(v)) AS sa, skewness(v) AS sk, kurtosis(v) AS ku, quantile_cont(v, 0.5) AS med FROM series1 GROUP BY 1),
x AS (SELECT {K}, sample - 1 AS t, v, mu, var, sd, mn, mx, n, ss, sa, med FROM series1 JOIN g USING ({K}))"""


def sql(pairs: dict, ctes: str, source: str, digits=4, base=BASE) -> str:
    """pairs: feature -> aggregate expression over ``source``; one row per series and feature."""
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS c{i}" for i, e in enumerate(pairs.values()))
    union = " UNION ALL ".join(
        f"SELECT {K}, 'value__{f.suffix}' AS feature, {q(f'c{i}', digits)} AS value FROM w" for i, f in enumerate(pairs))
    return with_views("series1", f"WITH {base}{', ' + ctes if ctes else ''}, w AS (SELECT {K}, {cols} FROM {source} GROUP BY 1) {union}")


def named(mapping: dict) -> dict:
    return {feature(k): v for k, v in mapping.items()}


def first(e):
    return f"any_value({e})"


QUERIES: dict = {}


def add(name, pairs, ctes="", source="x", digits=4, base=BASE, block=4000):
    QUERIES[name] = (run(list(pairs), digits, block), sql(pairs, ctes, source, digits, base))


add("f1_plain", named({"sum_values": "sum(v)", "mean": "avg(v)", "length": "count(*)", "minimum": "min(v)", "maximum": "max(v)",
                       "absolute_maximum": "max(abs(v))"}))
add("f2_spread", named({"variance": "var_pop(v)", "standard_deviation": "stddev_pop(v)", "root_mean_square": "sqrt(avg(v*v))",
                        "abs_energy": "sum(v*v)", "variation_coefficient": "stddev_pop(v)/avg(v)"}))
add("f3_quantiles", {feature("median"): "quantile_cont(v,0.5)",
                     **{feature("quantile", q=p): f"quantile_cont(v,{p})" for p in QUANTILES}})
add("f3_quantiles_blocks", {feature("median"): "quantile_cont(v,0.5)",
                            **{feature("quantile", q=p): f"quantile_cont(v,{p})" for p in QUANTILES}}, block=50)
add("f4_shape", named({"skewness": "skewness(v)", "kurtosis": "kurtosis(v)"}))
add("f5_minimal_set", named({"sum_values": "sum(v)", "median": "quantile_cont(v,0.5)", "mean": "avg(v)", "length": "count(*)",
                             "standard_deviation": "stddev_pop(v)", "variance": "var_pop(v)", "root_mean_square": "sqrt(avg(v*v))",
                             "maximum": "max(v)", "absolute_maximum": "max(abs(v))", "minimum": "min(v)"}))
add("f6_counts", {**named({"count_above_mean": "sum(CASE WHEN v>mu THEN 1 ELSE 0 END)", "count_below_mean": "sum(CASE WHEN v<mu THEN 1 ELSE 0 END)"}),
                  feature("count_above", t=0): "avg(CASE WHEN v>=0 THEN 1 ELSE 0 END)", feature("count_below", t=0): "avg(CASE WHEN v<=0 THEN 1 ELSE 0 END)",
                  **{feature("value_count", value=k): f"sum(CASE WHEN v={k} THEN 1 ELSE 0 END)" for k in (0, 1, -1)},
                  **{feature("range_count", min=a, max=b): f"sum(CASE WHEN v>={a} AND v<{b} THEN 1 ELSE 0 END)" for a, b in ((-1, 1), (-1e12, 0), (0, 1e12))}})
add("f7_flags", {feature("variance_larger_than_standard_deviation"): "CASE WHEN var_pop(v) > stddev_pop(v) THEN 1 ELSE 0 END",
                 **{f: f"CASE WHEN {first('sd')} > {f['r']!r}*({first('mx')}-{first('mn')}) THEN 1 ELSE 0 END" for f in family("large_standard_deviation")},
                 **{f: f"CASE WHEN abs({first('mu')}-{first('med')}) < {f['r']!r}*({first('mx')}-{first('mn')}) THEN 1 ELSE 0 END" for f in family("symmetry_looking")},
                 **{feature("ratio_beyond_r_sigma", r=r): f"avg(CASE WHEN abs(v-mu) > {r}*sd THEN 1 ELSE 0 END)" for r in SIGMAS}})
DUP = named({"has_duplicate": "max(CASE WHEN c>1 THEN 1 ELSE 0 END)", "has_duplicate_max": "max(CASE WHEN v=mx AND c>1 THEN 1 ELSE 0 END)",
             "has_duplicate_min": "max(CASE WHEN v=mn AND c>1 THEN 1 ELSE 0 END)",
             "percentage_of_reoccurring_values_to_all_values": "sum(CASE WHEN c>1 THEN 1 ELSE 0 END)/count(*)",
             "percentage_of_reoccurring_datapoints_to_all_datapoints": "sum(CASE WHEN c>1 THEN c ELSE 0 END)/sum(c)",
             "sum_of_reoccurring_values": "sum(CASE WHEN c>1 THEN v ELSE 0 END)",
             "sum_of_reoccurring_data_points": "sum(CASE WHEN c>1 THEN c*v ELSE 0 END)",
             "ratio_value_number_to_time_series_length": "count(*)/sum(c)"})
VC = f"vc AS (SELECT {K}, v, any_value(mx) AS mx, any_value(mn) AS mn, count(*) AS c FROM x GROUP BY {K}, v)"
add("f8_repeated_values", DUP, VC, "vc")
add("f8_repeated_values_blocks", DUP, VC, "vc", block=50)
add("f9_locations", named({"first_location_of_maximum": "min(CASE WHEN v=mx THEN t END)/any_value(n)",
                           "last_location_of_maximum": "(max(CASE WHEN v=mx THEN t END)+1)/any_value(n)",
                           "first_location_of_minimum": "min(CASE WHEN v=mn THEN t END)/any_value(n)",
                           "last_location_of_minimum": "(max(CASE WHEN v=mn THEN t END)+1)/any_value(n)"}))
STEP = f"st AS (SELECT *, lead(v) OVER (PARTITION BY {K} ORDER BY t) AS y, lead(v,2) OVER (PARTITION BY {K} ORDER BY t) AS z FROM x)"
CHANGES = {**named({"absolute_sum_of_changes": "sum(abs(y-v))", "mean_abs_change": "avg(abs(y-v))",
                    "mean_change": "avg(y-v)", "mean_second_derivative_central": "avg((z-2*y+v)/2)"}),
           feature("cid_ce", normalize=False): "sqrt(sum((y-v)*(y-v)))",
           feature("cid_ce", normalize=True): "sqrt(sum((y-v)*(y-v)))/any_value(sd)"}
add("f10_changes", CHANGES, STEP, "st")
add("f10_changes_blocks", CHANGES, STEP, "st", block=50)
LAGGED = "lg AS (SELECT *, " + ", ".join(f"lead(v,{i}) OVER (PARTITION BY {K} ORDER BY t) AS l{i}" for i in (1, 2, 3, 4, 6)) + " FROM x)"
add("f11_lagged_products", {**{feature("c3", lag=i): f"avg(v*l{i}*l{2 * i})" for i in (1, 2, 3)},
                            **{feature("time_reversal_asymmetry_statistic", lag=i): f"avg(l{2 * i}*l{2 * i}*l{i} - l{i}*v*v)" for i in (1, 2, 3)}},
    LAGGED, "lg", digits=2)
AC = ("ac AS (SELECT *, " + ", ".join(f"lead(v,{i}) OVER (PARTITION BY {K} ORDER BY t) AS l{i}" for i in range(1, 41)) + " FROM x), "
      f"al AS (SELECT {K}, any_value(n) AS n, " + ", ".join(f"avg((v-mu)*(l{i}-mu))/any_value(var) AS a{i}" for i in range(1, 41)) + " FROM ac GROUP BY 1)")
LIST = "list_filter([" + ", ".join(f"a{i}" for i in range(1, 41)) + "], lambda e: e IS NOT NULL)"
add("f12_autocorrelation", {feature("autocorrelation", lag=0): "1.0",
                            **{feature("autocorrelation", lag=i): first(f"a{i}") for i in range(1, 10)},
                            feature("agg_autocorrelation", f_agg="mean", maxlag=40): f"any_value(list_avg({LIST}))",
                            feature("agg_autocorrelation", f_agg="median", maxlag=40): f"any_value(list_median({LIST}))",
                            feature("agg_autocorrelation", f_agg="var", maxlag=40): f"any_value(list_var_pop({LIST}))"}, AC, "al")
add("f13_partial_autocorrelation", {feature("partial_autocorrelation", lag=0): "1.0",
                                    feature("partial_autocorrelation", lag=1): first("a1"),
                                    feature("partial_autocorrelation", lag=2): "any_value((a2-a1*a1)/(1-a1*a1))"}, AC, "al")
STRIKE = f"""sk AS (SELECT {K}, t, v>mu AS up, v<mu AS dn, row_number() OVER (PARTITION BY {K} ORDER BY t)
 - row_number() OVER (PARTITION BY {K}, v>mu ORDER BY t) AS gu, row_number() OVER (PARTITION BY {K} ORDER BY t)
 - row_number() OVER (PARTITION BY {K}, v<mu ORDER BY t) AS gd FROM x),
su AS (SELECT {K}, gu, count(*) AS c FROM sk WHERE up GROUP BY 1,2), sdn AS (SELECT {K}, gd, count(*) AS c FROM sk WHERE dn GROUP BY 1,2),
sa2 AS (SELECT {K}, max(c) AS a, 0 AS b FROM su GROUP BY 1 UNION ALL SELECT {K}, 0, max(c) FROM sdn GROUP BY 1)"""
STRIKES = named({"longest_strike_above_mean": "max(a)", "longest_strike_below_mean": "max(b)"})
add("f14_strikes", STRIKES, STRIKE, "sa2")
add("f14_strikes_blocks", STRIKES, STRIKE, "sa2", block=50)
PK = ("pk AS (SELECT *, lead(v) OVER (PARTITION BY {K} ORDER BY t) AS y, " + ", ".join(
    f"CASE WHEN t>={n} AND t+{n}<n AND v > max(v) OVER (PARTITION BY {{K}} ORDER BY t ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) "
    f"AND v > max(v) OVER (PARTITION BY {{K}} ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) THEN 1 ELSE 0 END AS p{n}" for n in PEAKS)
      + " FROM x)").replace("{K}", K)
add("f15_crossings_peaks", {**{feature("number_crossing_m", m=m): f"sum(CASE WHEN y IS NOT NULL AND (v>{m}) <> (y>{m}) THEN 1 ELSE 0 END)" for m in (0, -1, 1)},
                            **{feature("number_peaks", n=n): f"sum(p{n})" for n in PEAKS}}, PK, "pk")
QS = f"qq AS (SELECT {K}, " + ", ".join(f"quantile_cont(v,{e}) AS q{i}" for i, e in enumerate(EDGES)) + " FROM series1 GROUP BY 1), " \
    + STEP + f", cq AS (SELECT * FROM st JOIN qq USING ({K}))"


def corridor(f):
    lo, hi = EDGES.index(f["ql"]), EDGES.index(f["qh"])
    inside = f"q{lo}<q{hi} AND least(v,y)>=q{lo} AND greatest(v,y)<=q{hi}"
    d = "abs(y-v)" if f["isabs"] else "(y-v)"
    agg = "avg" if f["f_agg"] == "mean" else "var_pop"
    return f"coalesce({agg}(CASE WHEN {inside} THEN {d} END), 0)"


add("f16_change_quantiles", {f: corridor(f) for f in family("change_quantiles")}, QS, "cq", digits=3)
MASS = (f"ms AS (SELECT *, sum(abs(v)) OVER (PARTITION BY {K} ORDER BY t ROWS UNBOUNDED PRECEDING)/sa AS cum, "
        "CASE WHEN t < (k%10)*(k//10+1) THEN t//(k//10+1) ELSE (k%10) + (t-(k%10)*(k//10+1))//(k//10) END AS seg FROM (SELECT *, CAST(n AS BIGINT) AS k FROM x))")
MASSES = {**{feature("index_mass_quantile", q=p): f"(sum(CASE WHEN cum<{p} THEN 1 ELSE 0 END)+1)/any_value(n)" for p in QUANTILES},
          **{feature("energy_ratio_by_chunks", num_segments=10, segment_focus=s): f"sum(CASE WHEN seg={s} THEN v*v ELSE 0 END)/any_value(ss)" for s in range(10)}}
add("f17_mass_energy", MASSES, MASS, "ms")
add("f17_mass_energy_blocks", MASSES, MASS, "ms", block=50)
add("f18_linear_trend", {feature("linear_trend", attr="slope"): "regr_slope(v,t)", feature("linear_trend", attr="intercept"): "regr_intercept(v,t)",
                         feature("linear_trend", attr="rvalue"): "corr(v,t)",
                         feature("linear_trend", attr="stderr"): "sqrt((1-corr(v,t)*corr(v,t))*regr_syy(v,t)/regr_sxx(v,t)/(count(*)-2))"})
CH = ", ".join(f"ch{c} AS (SELECT {K}, t//{c} AS i, any_value(n) AS n, max(v) AS ymax, min(v) AS ymin, avg(v) AS ymean, var_pop(v) AS yvar FROM x GROUP BY 1, t//{c})"
               for c in (5, 10, 50))
CHALL = CH + ", chall AS (" + " UNION ALL ".join(f"SELECT {c} AS c, * FROM ch{c}" for c in (5, 10, 50)) + ")"


def chunk(f):
    y = f"CASE WHEN c={f['chunk_len']} THEN y{f['f_agg']} END"
    x = f"CASE WHEN c={f['chunk_len']} THEN i END"
    r = f"coalesce(CASE WHEN isnan(corr({y},{x})) THEN 0 ELSE corr({y},{x}) END,0)"
    k = f"count({y})"
    body = {"slope": f"regr_slope({y},{x})", "intercept": f"regr_intercept({y},{x})", "rvalue": r,
            "stderr": f"CASE WHEN {k}>2 THEN sqrt((1-{r}*{r})*regr_syy({y},{x})/regr_sxx({y},{x})/({k}-2)) ELSE 0 END"}[f["attr"]]
    return f"CASE WHEN any_value(n) > {f['chunk_len']} THEN {body} END"


add("f19_chunk_trend", {f: chunk(f) for f in family("agg_linear_trend")}, CHALL, "chall", digits=3)
BINS = f"""bn AS (SELECT {K}, least(9, floor((v-mn)/(mx-mn)*10)) AS b, any_value(n) AS n, count(*) AS c FROM x GROUP BY 1,2),
be AS (SELECT {K}, -sum(c/n*ln(c/n)) AS h FROM bn GROUP BY 1),
dg AS (SELECT {K}, d.d, avg(CASE WHEN substr(ltrim(CAST(abs(v) AS VARCHAR),'0.'),1,1)=CAST(d.d AS VARCHAR) THEN 1.0 ELSE 0.0 END) AS p, log10(1+1/d.d) AS e
 FROM x, (SELECT unnest(range(1,10)) AS d) d GROUP BY 1,2),
bf AS (SELECT {K}, corr(p,e) AS r FROM dg GROUP BY 1),
tp AS (SELECT {K}, avg(a) AS m FROM (SELECT {K}, abs(v) AS a, row_number() OVER (PARTITION BY {K} ORDER BY abs(v) DESC) AS r FROM x) WHERE r<=7 GROUP BY 1),
hh AS (SELECT * FROM be JOIN bf USING ({K}) JOIN tp USING ({K}))"""
add("f20_distribution", {feature("binned_entropy", max_bins=10): first("h"), feature("benford_correlation"): first("r"),
                         feature("mean_n_absolute_max", number_of_maxima=7): first("m")}, BINS, "hh")
RE, IM = "sum(v*cos(2*pi()*{k}*t/n))", "sum(-v*sin(2*pi()*{k}*t/n))"
add("f21_fft_few", {**{feature("fft_coefficient", coeff=k, attr="real"): RE.format(k=k) for k in range(4)},
                    **{feature("fft_coefficient", coeff=k, attr="imag"): IM.format(k=k) for k in range(1, 4)},
                    **{feature("fft_coefficient", coeff=k, attr="abs"): f"sqrt(pow({RE.format(k=k)},2)+pow({IM.format(k=k)},2))" for k in range(1, 4)}}, digits=3)
PERM = f"""pe AS (SELECT {K}, t, n, v AS a, lead(v) OVER (PARTITION BY {K} ORDER BY t) AS b, lead(v,2) OVER (PARTITION BY {K} ORDER BY t) AS c FROM x),
pp AS (SELECT {K}, (b<a)::INT+(c<a)::INT AS r1, (a<=b)::INT+(c<b)::INT AS r2, (a<=c)::INT+(b<=c)::INT AS r3, n-2 AS k FROM pe WHERE c IS NOT NULL),
pc AS (SELECT {K}, r1, r2, r3, any_value(k) AS k, count(*) AS m FROM pp GROUP BY 1,2,3,4)"""
add("f23_permutation_entropy", {feature("permutation_entropy", tau=1, dimension=3): "-sum(m/k*ln(m/k))"}, PERM, "pc")


def add_long(name, pairs, ctes="", source="x", digits=4):
    """The same check on three series of many blocks."""
    features = list(pairs)

    def query(spark, sf):
        long = ft.extract_features(long_series(spark, sf), ["value"], features)
        return long.select("simulationRun", "feature", rnd(F.when(F.abs("value") < float("inf"), F.col("value")), digits).alias("value"))
    QUERIES[name] = (query, sql(pairs, ctes, source, digits).replace(SQL["series1"], SQL["serieslong"]).replace("FROM series1 ", "FROM serieslong "))


FFT_FEW = {**{feature("fft_coefficient", coeff=k, attr="abs"): f"sqrt(pow({RE.format(k=k)},2)+pow({IM.format(k=k)},2))" for k in (1, 2, 40, 99)},
           feature("fft_coefficient", coeff=3, attr="real"): RE.format(k=3), feature("fft_coefficient", coeff=3, attr="imag"): IM.format(k=3)}
add_long("f21_fft_long", FFT_FEW, digits=1)
add_long("f23_permutation_entropy_long", {feature("permutation_entropy", tau=1, dimension=3): "-sum(m/k*ln(m/k))"}, PERM, "pc")
SEGMENTS = (f"sg AS (SELECT {K}, s, t-s AS i, v FROM x JOIN (SELECT unnest(range(0, 10000000, 128)) AS s) ON s BETWEEN t-255 AND t WHERE s+256<=n), "
            f"sm AS (SELECT *, v - avg(v) OVER (PARTITION BY {K}, s) AS u, 0.5-0.5*cos(2*pi()*i/256) AS h FROM sg), "
            f"sp AS (SELECT {K}, s, k, 2*(pow(sum(u*h*cos(2*pi()*k*i/256)),2)+pow(sum(u*h*sin(2*pi()*k*i/256)),2))/sum(h*h) AS p "
            "FROM sm, (SELECT unnest([2,5,8]) AS k) GROUP BY 1,2,3)")
add_long("f22_welch_density_long", {feature("spkt_welch_density", coeff=k): f"avg(CASE WHEN k={k} THEN p END)" for k in (2, 5, 8)}, SEGMENTS, "sp", digits=3)


def rows_only(name, features, block=4000):
    QUERIES[name] = (run(features, 4, block), None)


# Unit-root regression with one lagged step: two regressors and a constant, solved from centred products.
ROOT = (f"us AS (SELECT {K}, v AS l, lead(v) OVER (PARTITION BY {K} ORDER BY t) - v AS d, v - lag(v) OVER (PARTITION BY {K} ORDER BY t) AS p FROM x), "
        f"um AS (SELECT {K}, count(*) AS m, var_pop(l)*count(*) AS ll, var_pop(p)*count(*) AS pp, covar_pop(l,p)*count(*) AS lp, covar_pop(l,d)*count(*) AS ld, "
        f"covar_pop(p,d)*count(*) AS pd, var_pop(d)*count(*) AS dd FROM us WHERE d IS NOT NULL AND p IS NOT NULL GROUP BY 1), "
        "ub AS (SELECT *, (ld*pp-pd*lp)/(ll*pp-lp*lp) AS b, (pd*ll-ld*lp)/(ll*pp-lp*lp) AS c FROM um)")
ROOTS = {feature("augmented_dickey_fuller", attr="teststat", lags=1): "any_value(CASE WHEN m > 3 THEN b/sqrt((dd-b*ld-c*pd)/(m-3)*pp/(ll*pp-lp*lp)) END)",
         feature("augmented_dickey_fuller", attr="usedlag", lags=1): "any_value(CASE WHEN m > 3 THEN 1 END)"}
add("f25_unit_root_one_lag", ROOTS, ROOT, "ub")
add("f25_unit_root_one_lag_blocks", ROOTS, ROOT, "ub", block=50)
add_long("f25_unit_root_one_lag_long", ROOTS, ROOT, "ub", digits=3)
# Autoregressions of order one and two with a constant, from centred products.
AUTO = (f"a0 AS (SELECT {K}, v AS y, lag(v) OVER (PARTITION BY {K} ORDER BY t) AS a, lag(v,2) OVER (PARTITION BY {K} ORDER BY t) AS b FROM x), "
        f"a1 AS (SELECT {K}, count(*) AS n, regr_slope(y,a) AS s, regr_intercept(y,a) AS i FROM a0 GROUP BY 1), "
        f"a2 AS (SELECT {K}, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a,a) AS aa, covar_pop(b,b) AS bb, covar_pop(a,b) AS ab, "
        f"covar_pop(a,y) AS ay, covar_pop(b,y) AS bq FROM a0 WHERE b IS NOT NULL GROUP BY 1), "
        f"a3 AS (SELECT *, (ay*bb-bq*ab)/(aa*bb-ab*ab) AS u, (bq*aa-ay*ab)/(aa*bb-ab*ab) AS w FROM a1 LEFT JOIN a2 USING ({K}))")
AUTOS = {feature("ar_coefficient", coeff=0, k=1): "any_value(CASE WHEN n > 3 THEN i END)",
         feature("ar_coefficient", coeff=1, k=1): "any_value(CASE WHEN n > 3 THEN s END)",
         feature("ar_coefficient", coeff=2, k=1): "any_value(CASE WHEN n < 0 THEN s END)",
         feature("ar_coefficient", coeff=0, k=2): "any_value(CASE WHEN n > 5 THEN my-u*ma-w*mb END)",
         feature("ar_coefficient", coeff=1, k=2): "any_value(CASE WHEN n > 5 THEN u END)",
         feature("ar_coefficient", coeff=2, k=2): "any_value(CASE WHEN n > 5 THEN w END)"}
add("f13_autoregression_low_orders", AUTOS, AUTO, "a3", digits=3)
add("f13_autoregression_low_orders_blocks", AUTOS, AUTO, "a3", digits=3, block=50)
add_long("f13_autoregression_low_orders_long", AUTOS, AUTO, "a3", digits=3)
# Drift line: mean step over the mean value of thirty cells with equal counts.
DRIFT = (f"d0 AS (SELECT * FROM (SELECT {K}, v, lead(v) OVER (PARTITION BY {K} ORDER BY t) - v AS d FROM x) WHERE d IS NOT NULL), "
         f"d1 AS (SELECT {K}, quantile_cont(v, [{', '.join(f'{i}/30.0::DOUBLE' for i in range(31))}]) AS e FROM d0 GROUP BY 1 HAVING count(*) >= 30), "
         f"d2 AS (SELECT {K}, greatest(len(list_filter(e, lambda c: c < v)) - 1, 0) AS cell, avg(v) AS mv, avg(d) AS md "
         f"FROM d0 JOIN d1 USING ({K}) WHERE len(list_distinct(e)) = 31 GROUP BY 1, 2), "
         f"d3 AS (SELECT {K}, regr_slope(md, mv) AS s, regr_intercept(md, mv) AS i FROM d2 GROUP BY 1), "
         f"d4 AS (SELECT {K}, d3.s AS s, d3.i AS i FROM g LEFT JOIN d3 USING ({K}))")
DRIFTS = {feature("friedrich_coefficients", coeff=0, m=1, r=30): first("s"),
          feature("friedrich_coefficients", coeff=1, m=1, r=30): first("i"),
          feature("max_langevin_fixed_point", m=1, r=30): first("-i/s")}
add("f24_drift_line", DRIFTS, DRIFT, "d4", digits=3)
add("f24_drift_line_blocks", DRIFTS, DRIFT, "d4", digits=3, block=50)
# Several families of the additive set on series of many blocks.
TWO = f"{LAGGED}, tw AS (SELECT *, lead(v) OVER (PARTITION BY {K} ORDER BY t) AS y FROM lg)"
add_long("f_additive_long", {feature("mean_abs_change"): "avg(abs(y-v))", feature("cid_ce", normalize=False): "sqrt(sum((y-v)*(y-v)))",
                             **{feature("c3", lag=i): f"avg(v*l{i}*l{2 * i})" for i in (1, 2, 3)},
                             **{feature("ratio_beyond_r_sigma", r=r): f"avg(CASE WHEN abs(v-mu) > {r}*sd THEN 1 ELSE 0 END)" for r in SIGMAS},
                             **{feature("number_crossing_m", m=m): f"sum(CASE WHEN y IS NOT NULL AND (v>{m}) <> (y>{m}) THEN 1 ELSE 0 END)" for m in (0, -1, 1)},
                             feature("count_above_mean"): "sum(CASE WHEN v>mu THEN 1 ELSE 0 END)",
                             feature("count_below_mean"): "sum(CASE WHEN v<mu THEN 1 ELSE 0 END)"}, TWO, "tw", digits=2)


rows_only("f13_ar_coefficient", family("ar_coefficient"))
rows_only("f18_trend_p_value", [feature("linear_trend", attr="pvalue")])
rows_only("f21_fft_all", family("fft_coefficient", "fft_aggregated"))
rows_only("f20_fourier_entropy", family("fourier_entropy"))
rows_only("f22_welch_wavelet", family("spkt_welch_density", "cwt_coefficients", "number_cwt_peaks"))
rows_only("f23_complexity", family("permutation_entropy", "lempel_ziv_complexity"))
rows_only("f24_drift_polynomial", family("friedrich_coefficients", "max_langevin_fixed_point"))
rows_only("f25_unit_root", family("augmented_dickey_fuller"))
rows_only("f26_quadratic_entropies", family("sample_entropy", "approximate_entropy"))
rows_only("f_efficient_set", E)
rows_only("f_additive_set", fn.additive())


SELECTED = ["value__mean", 'value__linear_trend__attr_"slope"', "value__c3__lag_1", "value__quantile__q_0.1"]


def f27(spark, sf):
    long = ft.extract_selected(user_series(spark, sf), ["value"], SELECTED, long_runs=False)
    return long.select("simulationRun", "feature", rnd("value", 4).alias("value"))


QUERIES["f27_p18_extract_selected"] = (f27, sql({fn.parse(n)[1]: e for n, e in zip(
    SELECTED, ["avg(v)", "regr_slope(v,t)", "avg(v*l1*l2)", "quantile_cont(v,0.1)"])}, LAGGED, "lg"))

DFT = (f"kk AS (SELECT {K}, k, any_value(n) AS n, sqrt(pow(sum(v*cos(2*pi()*k*t/n)),2)+pow(sum(v*sin(2*pi()*k*t/n)),2)) AS amp "
       f"FROM x, (SELECT unnest(range(0, 64)) AS k) WHERE k <= n//2 GROUP BY 1,2), "
       f"mo AS (SELECT {K}, sum(amp*k)/sum(amp) AS m1, sum(amp*k*k)/sum(amp) AS m2, sum(amp*k*k*k)/sum(amp) AS m3, "
       f"sum(amp*k*k*k*k)/sum(amp) AS m4 FROM kk GROUP BY 1), "
       "mv AS (SELECT *, m2-m1*m1 AS vv FROM mo)")
add("f21_fft_aggregated", {feature("fft_aggregated", aggtype="centroid"): first("m1"), feature("fft_aggregated", aggtype="variance"): first("vv"),
                           feature("fft_aggregated", aggtype="skew"): "any_value((m3-3*m1*vv-m1*m1*m1)/pow(vv,1.5))",
                           feature("fft_aggregated", aggtype="kurtosis"): "any_value((m4-4*m1*m3+6*m2*m1*m1-3*m1)/(vv*vv))"}, DFT, "mv")
# Every user series is shorter than 256, so the density has one segment of the whole series.
WELCH = (f"hw AS (SELECT {K}, t, n, v-mu AS u, 0.5-0.5*cos(2*pi()*t/n) AS h FROM x), "
         f"wd AS (SELECT {K}, k, any_value(n) AS n, (pow(sum(u*h*cos(2*pi()*k*t/n)),2)+pow(sum(u*h*sin(2*pi()*k*t/n)),2))/sum(h*h) AS p "
         "FROM hw, (SELECT unnest([2,5,8]) AS k) GROUP BY 1,2)")
add("f22_welch_density", {feature("spkt_welch_density", coeff=k): f"sum(CASE WHEN k={k} THEN 2*p END)" for k in (2, 5, 8)}, WELCH, "wd", digits=3)


def wavelet(c: int, w: int) -> str:
    """Coefficient c of the convolution with 10*w Mexican-hat taps (series longer than the taps)."""
    size = 10 * w
    at = f"({c + (size - 1) // 2} - t)"
    s = f"pow(({at} - {(size - 1) / 2})/{w}.0, 2)"
    return (f"sum(CASE WHEN {at} BETWEEN 0 AND {size - 1} THEN v * 2/(sqrt(3.0*{w})*pow(pi(),0.25)) * (1-{s})*exp(-{s}/2) ELSE 0 END)")


add_long("f22_wavelet_long", {feature("cwt_coefficients", widths=fn.WIDTHS, coeff=c, w=w): wavelet(c, w) for c in (0, 7, 14) for w in fn.WIDTHS}, digits=3)
add("f22_wavelet_small", {feature("cwt_coefficients", widths=fn.WIDTHS, coeff=c, w=2): wavelet(c, 2) for c in range(15)}, digits=3)
SAMPEN = f"""tm AS (SELECT {K}, t, sd, v AS a, lead(v) OVER (PARTITION BY {K} ORDER BY t) AS b, lead(v,2) OVER (PARTITION BY {K} ORDER BY t) AS c FROM x),
prs AS (SELECT p."simulationRun", CASE WHEN p.c IS NOT NULL AND r.c IS NOT NULL AND abs(p.c-r.c) <= 0.2*p.sd THEN 1 ELSE 0 END AS three
 FROM tm p JOIN tm r ON p."simulationRun"=r."simulationRun" AND p.t<>r.t AND abs(p.a-r.a) <= 0.2*p.sd AND abs(p.b-r.b) <= 0.2*p.sd)"""
add("f26_sample_entropy", {feature("sample_entropy"): "-ln(nullif(sum(three),0)/count(*))"}, SAMPEN, "prs")
FOUR = (f"hf AS (SELECT {K}, t, n, v-mu AS u, 0.5-0.5*cos(2*pi()*t/n) AS h FROM x), "
        f"pw AS (SELECT {K}, k, any_value(n) AS n, (CASE WHEN k=0 OR 2*k=any_value(n) THEN 1 ELSE 2 END)*(pow(sum(u*h*cos(2*pi()*k*t/n)),2)+pow(sum(u*h*sin(2*pi()*k*t/n)),2))/sum(h*h) AS p "
        f"FROM hf, (SELECT unnest(range(0, 64)) AS k) WHERE k <= n//2 GROUP BY 1,2), "
        f"pr AS (SELECT {K}, p/max(p) OVER (PARTITION BY {K}) AS p FROM pw), pm AS (SELECT {K}, min(p) AS lo, count(*) AS c FROM pr GROUP BY 1), "
        f"ph AS (SELECT {K}, least(1, floor((p-lo)/(1-lo)*2)) AS b, any_value(c) AS c, count(*) AS m FROM pr JOIN pm USING ({K}) GROUP BY 1,2)")
add("f20_fourier_entropy_2", {feature("fourier_entropy", bins=2): "-sum(m/c*ln(m/c))"}, FOUR, "ph")
