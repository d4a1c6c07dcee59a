"""Moments and per-run spectra; closed forms in SQL for one or two channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import moments as mo
from runlens.operators import prep, reports, spectra
from runlens.schema import Numerics, SpectrumConfig, Window

from .views import q, rnd, run_values, runs, user_series, vectors, with_views

K = '"faultNumber", "simulationRun"'
KEYS = ["faultNumber", "simulationRun"]
OVER = f"OVER (PARTITION BY {K} ORDER BY sample)"


def one(spark, sf):
    """One channel (quantity / 50) of the lineitem runs."""
    return runs(spark, sf, two=True).withColumn("x", F.array(F.col("x")[0]))


def spec(spark, sf, method, two=True, cutoff=21, **kw):
    df = runs(spark, sf, two=two)
    scaler = prep.fit_scaler(run_values(spark, sf, two=two)) if kw.get("scaling_mode") == "scaler" or method == "lda" else None
    cfg = SpectrumConfig(method, window=Window(cutoff), **kw)
    return spectra.run_spectra(df, cfg, 2 if two else 4, scaler, dense=True)


def a17_native(spark, sf):
    m = mo.moments(runs(spark, sf, two=True).withColumn("z", F.col("x")), 2, native=True)
    return m.select(*KEYS, "n", "last_t", rnd(F.col("mean")[0]).alias("m0"), rnd(F.col("mean")[1]).alias("m1"),
                    *[rnd(F.col("cov")[i]).alias(c) for i, c in enumerate(("c00", "c01", "c11"))])


def a17_partial(spark, sf):
    m = mo.moments(runs(spark, sf, two=True).withColumn("z", F.col("x")), 2, native=False)
    return m.select(*KEYS, "n", "last_t", rnd(F.col("mean")[0]).alias("m0"), rnd(F.col("mean")[1]).alias("m1"),
                    *[rnd(F.col("cov")[i]).alias(c) for i, c in enumerate(("c00", "c01", "c11"))])


def a17_wide(spark, sf):
    """64 channels: class = label, one long run per class; trace and corner of the covariance."""
    v = vectors(spark, sf).select(F.col("label").alias("faultNumber"), F.lit(1).alias("simulationRun"),
                                  F.col("run_id").alias("t"), F.col("x").alias("z"))
    m = mo.moments(v, 64)
    diag = F.array(*[F.col("cov")[i * 64 - i * (i - 1) // 2] for i in range(64)])
    return m.select("faultNumber", "n", rnd(F.aggregate(diag, F.lit(0.0), lambda a, b: a + b)).alias("trace"),
                    rnd(F.col("cov")[63]).alias("c_first_last"))


def d1(spark, sf):
    s = spec(spark, sf, "pca")
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0]).alias("v1"), rnd(F.col("values")[1]).alias("v2"))


def d1_a1(spark, sf):
    agg = reports.aggregate_spectra(spec(spark, sf, "pca").where("status = 'ok'"))
    return agg.select("faultNumber", "pos", rnd("mean").alias("mean"), rnd("std").alias("std"))


def a1_a3_wide(spark, sf):
    agg = reports.aggregate_spectra(spec(spark, sf, "pca").where("status = 'ok'"))
    cv = reports.coefficient_of_variation(agg).select("faultNumber", "pos", "mean", F.col("cv").alias("std"))
    wide = reports.aggregate_wide(cv, "lambda_", 2)
    return wide.select("faultNumber", *[rnd(c).alias(c.replace("_std", "_cv")) for c in wide.columns[1:]])


def j6(spark, sf):
    agg = reports.aggregate_spectra(spec(spark, sf, "pca").where("status = 'ok'"))
    o = reports.reference_overlay(agg, 2)
    return o.select("faultNumber", "pos", rnd("mean").alias("mean"), rnd("reference").alias("reference"))


def d0_gapped(spark, sf):
    """Runs whose every third sample is missing, cut by position to 25 (normal) and 15 (faulty) samples."""
    cfg = SpectrumConfig("dpca", numerics=Numerics(lags=1), window=Window(21, 25, 15))
    s = spectra.run_spectra(one(spark, sf).where("sample % 3 <> 0"), cfg, 1)
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0]).alias("v1"))


def d2(spark, sf):
    cfg = SpectrumConfig("dpca", numerics=Numerics(lags=1), window=Window(21))
    s = spectra.run_spectra(one(spark, sf), cfg, 1, dense=True)
    return s.select(*KEYS, "n", rnd(F.col("values")[0]).alias("v1"), rnd(F.col("values")[1]).alias("v2"))


def d2_wide(spark, sf):
    s = spec(spark, sf, "dpca", two=False)
    return s.select(*KEYS, "status", F.size("values").alias("k"),
                    rnd(F.aggregate("values", F.lit(0.0), lambda a, b: a + b)).alias("total"))


def d3(spark, sf):
    cfg = SpectrumConfig("cva", window=Window(21))
    s = spectra.run_spectra(one(spark, sf), cfg, 1, dense=True)
    return s.select(*KEYS, "n", rnd(F.col("values")[0]).alias("v1"))


def d4(spark, sf):
    cfg = SpectrumConfig("dyca", window=Window(21), numerics=Numerics(linear=1, total=1), scaling_mode="scaler")
    df = one(spark, sf)
    s = spectra.run_spectra(df, cfg, 1, prep.fit_scaler(df), dense=True)
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0], 5).alias("v1"))


def d4_failed(spark, sf):
    """Skipped and failed runs: short one-channel series, global-mean scaling."""
    df = user_series(spark, sf).drop("t")
    cfg = SpectrumConfig("dyca", window=Window(1), numerics=Numerics(linear=30, total=60))
    s = spectra.run_spectra(df, cfg, 1, dense=True)
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0], 5).alias("v1"))


def d5_one(spark, sf):
    cfg = SpectrumConfig("ica", window=Window(21), numerics=Numerics(components=1))
    s = spectra.run_spectra(one(spark, sf), cfg, 1, dense=True)
    return s.select(*KEYS, "n", "converged", rnd(F.col("values")[0], 5).alias("v1"))


def d5_wide(spark, sf):
    return spec(spark, sf, "ica", two=False, numerics=Numerics(components=3), scaling_mode="scaler")


def d7(spark, sf):
    s = spec(spark, sf, "lda")
    return s.select(*KEYS, "n", rnd(F.col("values")[0], 5).alias("v1"))


def j4(spark, sf):
    return spectra.next_run(runs(spark, sf).where("faultNumber = 0"), block=16)


def d9(spark, sf):
    cfg = SpectrumConfig("dyca", numerics=Numerics(linear=2), scaling_mode="scaler")
    df = runs(spark, sf)
    return spectra.estimate_dyca_mn(df, cfg, 4, prep.fit_scaler(df), dense=True)


def d9_two(spark, sf):
    """Two channels, one linear equation: both eigenvalues and the one singular value have closed forms."""
    cfg = SpectrumConfig("dyca", numerics=Numerics(linear=1), scaling_mode="scaler")
    df = runs(spark, sf, two=True)
    s = spectra.estimate_dyca_mn(df, cfg, 2, prep.fit_scaler(df), near=0.005, clear=0.5, dense=True)
    return s.select(*KEYS, "status", rnd(F.col("eigenvalues")[0], 5).alias("l1"), rnd(F.col("eigenvalues")[1], 5).alias("l2"),
                    rnd(F.col("singular_values")[0], 4).alias("s1"), "m_hint", "extra_hint")


def d4_two(spark, sf):
    s = spec(spark, sf, "dyca", numerics=Numerics(linear=1, total=2), scaling_mode="scaler")
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0], 5).alias("v1"), rnd(F.col("values")[1], 5).alias("v2"))


def d10(spark, sf):
    """A user-defined spectrum: share of the strongest channel's variance."""
    import numpy as np
    spectra.add_method("strongest", spectra.Method(
        spectra.Request(lambda df, c: df.withColumn("z", F.col("x")), least=lambda c, d: 150),
        lambda n, mean, cov, d, c: np.array([np.diag(cov).max() / np.trace(cov)]), spectra.Export("top_", "Top", "top")))
    s = spec(spark, sf, "strongest")
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0]).alias("v1"))


def d10_extra(spark, sf):
    """A user-defined spectrum with two columns of its own: total variance and number of the strongest channel."""
    import numpy as np

    def solve(n, mean, cov, d, c):
        v = np.diag(cov)
        return np.array([v.max() / v.sum()]), {"total": float(v.sum()), "strongest": int(v.argmax())}

    spectra.add_method("strongest_with", spectra.Method(
        spectra.Request(lambda df, c: df.withColumn("z", F.col("x")), least=lambda c, d: 150), solve, spectra.Export("top_", "Top", "top"),
        extra=(("total", "double"), ("strongest", "int"))))
    s = spec(spark, sf, "strongest_with")
    return s.select(*KEYS, "n", "status", rnd(F.col("values")[0]).alias("v1"), rnd("total").alias("total"), "strongest")


def d10_export(spark, sf):
    d10_extra(spark, sf)
    cfg = SpectrumConfig("strongest_with", window=Window(21))
    wide = spectra.wide_spectra(spectra.run_spectra(runs(spark, sf, two=True), cfg, 2, dense=True), cfg, 1)
    return wide.select(*KEYS, rnd("top_1").alias("top_1"), rnd("total").alias("total"), "strongest")


def a17_all(spark, sf):
    """All 2,080 entries of the covariance of 64 channels, and all means."""
    v = vectors(spark, sf).select(F.col("label").alias("faultNumber"), F.lit(1).alias("simulationRun"),
                                  F.col("run_id").alias("t"), F.col("x").alias("z"))
    m = mo.moments(v, 64)
    cells = m.select("faultNumber", F.posexplode("cov").alias("at", "value"))
    means = m.select("faultNumber", F.posexplode("mean").alias("at", "value")).withColumn("at", F.col("at") - 64)
    return cells.unionByName(means).select("faultNumber", F.col("at").cast("bigint").alias("at"), rnd("value").alias("value"))


def a13(spark, sf):
    df = user_series(spark, sf).drop("t")
    s = spectra.run_spectra(df, SpectrumConfig("dyca", window=Window(1), numerics=Numerics(linear=30, total=60)), 1, dense=True)
    return spectra.success_counters(s).select("status", "runs")


def t8_p14(spark, sf):
    s = spec(spark, sf, "pca").where("status = 'ok'").withColumn("v", prep.first_components("values", 1))
    return s.select(*KEYS, rnd(prep.spectrum_transform("v", "log")[0]).alias("logv"), F.size("v").alias("k"))


CUT = f"""cut AS (SELECT * FROM runs2 WHERE "faultNumber" = 0 OR sample >= 21),
mom AS (SELECT {K}, count(*) AS n, avg(a) AS ma, avg(b) AS mb, covar_pop(a,a) AS caa, covar_pop(a,b) AS cab, covar_pop(b,b) AS cbb FROM cut GROUP BY 1,2)"""
SHARES = CUT + f""", eig AS (SELECT {K}, n, (caa+cbb)/2 + sqrt(((caa-cbb)/2)*((caa-cbb)/2) + cab*cab) AS l1, caa+cbb AS tr FROM mom),
sh AS (SELECT {K}, n, l1/tr AS v1, 1 - l1/tr AS v2 FROM eig),
shl AS (SELECT {K}, 1 AS pos, v1 AS v FROM sh UNION ALL SELECT {K}, 2, v2 FROM sh)"""
R = 1e-6


def R2(body):
    return with_views("runs2", body)


STEP2 = "(coalesce(lead({c}) {o}, {c}) - coalesce(lag({c}) {o}, {c})) / (CASE WHEN lead({c}) {o} IS NULL OR lag({c}) {o} IS NULL THEN 1.0 ELSE 2.0 END) AS d{c}"
# Eigenvalues of S1 S0^-1 S1' u = l S2 u for two scaled channels, and how far S0^-1 S1' u of the first stands off u.
DYCA2 = f"""WITH st AS (SELECT avg(a) AS ua, stddev_pop(a) AS sa, avg(b) AS ub, stddev_pop(b) AS sb FROM runs2 WHERE "faultNumber"=0), {CUT},
sc AS (SELECT {K}, sample, (a-ua)/sa AS a, (b-ub)/sb AS b FROM cut JOIN st ON true),
dd AS (SELECT {K}, a, b, {STEP2.format(c='a', o=OVER)}, {STEP2.format(c='b', o=OVER)} FROM sc),
s2 AS (SELECT {K}, count(*) AS n, avg(a*a) AS p, avg(a*b) AS q, avg(b*b) AS r, avg(da*a) AS e, avg(da*b) AS f, avg(db*a) AS g, avg(db*b) AS h,
 avg(da*da) AS x, avg(da*db) AS y, avg(db*db) AS z FROM dd GROUP BY 1,2),
aa AS (SELECT *, (e*e*r - 2*e*f*q + f*f*p)/(p*r-q*q) AS a11, (e*g*r - (e*h+f*g)*q + f*h*p)/(p*r-q*q) AS a12,
 (g*g*r - 2*g*h*q + h*h*p)/(p*r-q*q) AS a22 FROM s2),
tr AS (SELECT *, (z*a11 - 2*y*a12 + x*a22)/(x*z-y*y)/2 AS half, (a11*a22-a12*a12)/(x*z-y*y) AS det FROM aa),
ll AS (SELECT *, half + sqrt(half*half-det) AS l1, half - sqrt(half*half-det) AS l2 FROM tr),
uu AS (SELECT *, -(a12-l1*y) AS u1, a11-l1*x AS u2 FROM ll),
vv AS (SELECT *, r*(e*u1+g*u2) - q*(f*u1+h*u2) AS v1, p*(f*u1+h*u2) - q*(e*u1+g*u2) AS v2 FROM uu),
ev AS (SELECT *, abs(u1*v2-u2*v1)/sqrt((u1*u1+u2*u2)*(v1*v1+v2*v2)) AS s1 FROM vv)
"""
A17_SQL = R2(f"""SELECT {K}, count(*) AS n, CAST(max(sample)-1 AS BIGINT) AS last_t, {q('avg(a)')} AS m0, {q('avg(b)')} AS m1,
 {q('var_pop(a)')} AS c00, {q('covar_pop(a,b)')} AS c01, {q('var_pop(b)')} AS c11 FROM runs2 GROUP BY 1,2""")

QUERIES = {
    "a17_moments_native": (a17_native, A17_SQL),
    "a17_moments_partial": (a17_partial, A17_SQL),
    "a17_moments_wide": (a17_wide, with_views("feat", f"""WITH c AS (SELECT label, feature, var_pop(value) AS s, count(*) AS n FROM feat GROUP BY 1,2),
x AS (SELECT a.label, covar_pop(a.value, b.value) AS c FROM feat a JOIN feat b ON a.run_id=b.run_id AND a.feature='f00' AND b.feature='f63' GROUP BY 1)
SELECT c.label AS "faultNumber", max(n) AS n, {q('sum(s)')} AS trace, {q('max(x.c)')} AS c_first_last FROM c JOIN x ON c.label=x.label GROUP BY 1""")),
    "d1_pca_spectrum": (d1, R2(f"WITH {SHARES} SELECT {K}, n, 'ok' AS status, {q('v1')} AS v1, {q('v2')} AS v2 FROM sh")),
    "d1_a1_pca_shares_by_class": (d1_a1, R2(f'WITH {SHARES} SELECT "faultNumber", pos, {q("avg(v)")} AS mean, {q("stddev_samp(v)")} AS std FROM shl GROUP BY 1,2')),
    "a1_a3_coefficient_of_variation": (a1_a3_wide, R2(f'WITH {SHARES} SELECT "faultNumber", ' + ", ".join(
        f"{q(f'avg(v{i})')} AS lambda_{i}_mean, {q(f'stddev_samp(v{i})/avg(v{i})')} AS lambda_{i}_cv" for i in (1, 2)) + " FROM sh GROUP BY 1")),
    "j6_reference_overlay": (j6, R2(f"""WITH {SHARES}, ag AS (SELECT "faultNumber", pos, avg(v) AS m FROM shl GROUP BY 1,2)
SELECT a."faultNumber", a.pos, {q('a.m')} AS mean, {q('r.m')} AS reference FROM ag a JOIN ag r ON r.pos=a.pos AND r."faultNumber"=0""")),
    "d0_gapped_spectra": (d0_gapped, R2(f"""WITH {CUT}, g AS (SELECT *, row_number() {OVER} - 1 AS t FROM cut WHERE sample % 3 <> 0),
h AS (SELECT * FROM g WHERE t < CASE WHEN "faultNumber" = 0 THEN 25 ELSE 15 END), l AS (SELECT {K}, a, lag(a) {OVER} AS p FROM h),
m AS (SELECT {K}, count(*) AS n, var_pop(a) AS caa, covar_pop(a,p) AS cab, var_pop(p) AS cbb FROM l WHERE p IS NOT NULL GROUP BY 1,2)
SELECT {K}, n, 'ok' AS status, {q('((caa+cbb)/2 + sqrt(((caa-cbb)/2)*((caa-cbb)/2) + cab*cab))/(caa+cbb)')} AS v1 FROM m""")),
    "d2_dpca_spectrum": (d2, R2(f"""WITH {CUT}, l AS (SELECT {K}, a, lag(a) {OVER} AS p FROM cut), m AS (SELECT {K}, count(*) AS n, var_pop(a) AS caa, covar_pop(a,p) AS cab, var_pop(p) AS cbb FROM l WHERE p IS NOT NULL GROUP BY 1,2),
e AS (SELECT {K}, n, ((caa+cbb)/2 + sqrt(((caa-cbb)/2)*((caa-cbb)/2) + cab*cab))/(caa+cbb) AS v1 FROM m)
SELECT {K}, n, {q('v1')} AS v1, {q('1-v1')} AS v2 FROM e""")),
    "d2_dpca_wide": (d2_wide, with_views("runs4", f"SELECT DISTINCT {K}, 'ok' AS status, 12 AS k, 1.0::DOUBLE AS total FROM runs4")),
    "d3_cva_spectrum": (d3, R2(f"""WITH {CUT}, l AS (SELECT {K}, a, lag(a) {OVER} AS p FROM cut), m AS (SELECT {K}, count(*) AS n, var_samp(a) AS caa, covar_samp(a,p) AS cab, var_samp(p) AS cbb FROM l WHERE p IS NOT NULL GROUP BY 1,2)
SELECT {K}, n, {q(f'least(1.0, abs(cab)/sqrt(caa*(1+{R})*cbb*(1+{R})))')} AS v1 FROM m""")),
    "d4_w7_dyca_spectrum": (d4, R2(f"""WITH st AS (SELECT avg(a) AS mu, stddev_pop(a) AS sd FROM runs2 WHERE "faultNumber"=0), {CUT},
x AS (SELECT {K}, sample, (a-mu)/sd AS x FROM cut, st),
d AS (SELECT {K}, x, (coalesce(lead(x) {OVER}, x) - coalesce(lag(x) {OVER}, x)) / (CASE WHEN lead(x) {OVER} IS NULL OR lag(x) {OVER} IS NULL THEN 1.0 ELSE 2.0 END) AS dx FROM x)
SELECT {K}, count(*) AS n, 'ok' AS status, {q('avg(x*dx)*avg(x*dx)/(avg(x*x)*avg(dx*dx))', 5)} AS v1 FROM d GROUP BY 1,2""")),
    "d4_w4_dyca_skipped": (d4_failed, with_views("series1", f"""WITH m AS (SELECT {K}, avg(v) AS mu FROM series1 GROUP BY 1,2),
x AS (SELECT {K}, sample, v-mu AS x FROM series1 JOIN m USING ({K})),
d AS (SELECT {K}, x, (coalesce(lead(x) {OVER}, x) - coalesce(lag(x) {OVER}, x)) / (CASE WHEN lead(x) {OVER} IS NULL OR lag(x) {OVER} IS NULL THEN 1.0 ELSE 2.0 END) AS dx FROM x)
SELECT {K}, count(*) AS n, CASE WHEN count(*) < 65 THEN 'skipped' ELSE 'ok' END AS status,
 CASE WHEN count(*) >= 65 THEN {q('avg(x*dx)*avg(x*dx)/(avg(x*x)*avg(dx*dx))', 5)} END AS v1 FROM d GROUP BY 1,2""")),
    "d5_ica_kurtosis": (d5_one, R2(f"WITH {CUT} SELECT {K}, count(*) AS n, 1 AS converged, {q('kurtosis_pop(a)', 5)} AS v1 FROM cut GROUP BY 1,2")),
    "d5_ica_spectrum": (d5_wide, None),
    "d6_d7_j3_lda_spectrum": (d7, R2(f"""WITH st AS (SELECT avg(a) AS ua, stddev_pop(a) AS sa, avg(b) AS ub, stddev_pop(b) AS sb FROM runs2 WHERE "faultNumber"=0),
sc AS (SELECT {K}, sample, (a-ua)/sa AS a, (b-ub)/sb AS b FROM runs2, st),
mm AS (SELECT {K}, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS caa, covar_pop(a,b) AS cab, var_pop(b) AS cbb FROM sc WHERE "faultNumber"=0 OR sample>=21 GROUP BY 1,2),
ff AS (SELECT *, coalesce(lead("simulationRun") OVER (ORDER BY "simulationRun"), first_value("simulationRun") OVER (ORDER BY "simulationRun")) AS nxt FROM mm WHERE "faultNumber"=0),
pr AS (SELECT m.*, r.n AS n0, r.ma AS ma0, r.mb AS mb0, r.caa AS caa0, r.cab AS cab0, r.cbb AS cbb0 FROM mm m JOIN ff s ON s."simulationRun"=m."simulationRun"
 JOIN ff r ON r."simulationRun" = CASE WHEN m."faultNumber"=0 THEN s.nxt ELSE m."simulationRun" END),
w AS (SELECT *, n*caa+n0*caa0 AS p, n*cab+n0*cab0 AS o, n*cbb+n0*cbb0 AS s, ma-ma0 AS da, mb-mb0 AS db FROM pr),
g AS (SELECT *, p + {R}*(p+s)/2 AS pp, s + {R}*(p+s)/2 AS ss FROM w)
SELECT {K}, n, {q('n*n0/(n+n0)*(da*da*ss - 2*da*db*o + db*db*pp)/(pp*ss-o*o)', 5)} AS v1 FROM g""")),
    "j4_pair_with_neighbour": (j4, with_views("runs4", """WITH r AS (SELECT DISTINCT "simulationRun" FROM runs4 WHERE "faultNumber"=0)
SELECT "simulationRun", coalesce(lead("simulationRun") OVER (ORDER BY "simulationRun"), (SELECT min("simulationRun") FROM r)) AS partner FROM r""")),
    "d9_estimate_dyca_mn": (d9, None),
    "d9_estimate_dyca_mn_two": (d9_two, R2(f"""{DYCA2} SELECT {K}, 'ok' AS status, {q('l1', 5)} AS l1, {q('l2', 5)} AS l2, {q('s1', 4)} AS s1,
 (l1 >= 0.005)::INTEGER + (l2 >= 0.005)::INTEGER AS m_hint, (s1 >= 0.5)::INTEGER AS extra_hint FROM ev WHERE "faultNumber" = 0""")),
    "d4_dyca_two_channels": (d4_two, R2(f"{DYCA2} SELECT {K}, n, 'ok' AS status, {q('l1', 5)} AS v1, {q('l2', 5)} AS v2 FROM ev")),
    "d10_registered_spectrum": (d10, R2(f"WITH {CUT} SELECT {K}, n, CASE WHEN n<150 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN n>=150 THEN {q('greatest(caa,cbb)/(caa+cbb)')} END AS v1 FROM mom")),
    "d10_extra_columns": (d10_extra, R2(f"""WITH {CUT} SELECT {K}, n, CASE WHEN n<150 THEN 'skipped' ELSE 'ok' END AS status,
 CASE WHEN n>=150 THEN {q('greatest(caa,cbb)/(caa+cbb)')} END AS v1, CASE WHEN n>=150 THEN {q('caa+cbb')} END AS total,
 CASE WHEN n>=150 THEN CASE WHEN cbb>caa THEN 1 ELSE 0 END END AS strongest FROM mom""")),
    "d10_extra_export": (d10_export, R2(f"""WITH {CUT} SELECT {K}, {q('greatest(caa,cbb)/(caa+cbb)')} AS top_1, {q('caa+cbb')} AS total,
 CASE WHEN cbb>caa THEN 1 ELSE 0 END AS strongest FROM mom WHERE n>=150""")),
    "a17_moments_all": (a17_all, with_views("feat", f"""WITH f AS (SELECT *, CAST(substr(feature, 2) AS BIGINT) AS i FROM feat)
SELECT a.label AS "faultNumber", a.i*64 - a.i*(a.i-1)//2 + b.i - a.i AS at, {q('covar_pop(a.value, b.value)')} AS value
FROM f a JOIN f b ON a.run_id=b.run_id AND a.i<=b.i GROUP BY a.label, a.i, b.i UNION ALL
SELECT label, i - 64, {q('avg(value)')} FROM f GROUP BY 1, i""")),
    "a13_success_counters": (a13, with_views("series1", f"WITH l AS (SELECT {K}, count(*) AS n FROM series1 GROUP BY 1,2) SELECT CASE WHEN n<65 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS runs FROM l GROUP BY 1")),
    "t8_first_components": (t8_p14, R2(f"WITH {SHARES} SELECT {K}, {q('log10(greatest(v1,1e-12))')} AS logv, 1 AS k FROM sh")),
}
