"""Projected runs; closed forms where one or two channels allow them."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import prep, projections
from runlens.schema import Numerics, PipelineConfig
from runlens.sources.runs import prepare_runs

from .views import q, rnd, run_values, runs, with_views

K = '"faultNumber", "simulationRun"'
KEYS = ["faultNumber", "simulationRun"]
OVER = f"OVER (PARTITION BY {K} ORDER BY sample)"


def rows(spark, sf, two=False):
    return prepare_runs(runs(spark, sf, two=two).drop("t"), cutoff=21, length=None, dense=True)


def run(spark, sf, spec, two=False, scaling="scaler", **kw):
    df = rows(spark, sf, two)
    scaler = prep.fit_scaler(run_values(spark, sf, two=two)) if scaling == "scaler" else None
    ctx = projections.Context(PipelineConfig((spec,), scaling_mode=scaling, **kw), 2 if two else 4, scaler)
    return projections.project(df, spec, ctx)


def v1(spark, sf):
    return run(spark, sf, ("raw",), two=True, scaling="global_mean").select(
        *KEYS, "t", *[rnd(F.col("x")[i]).alias(f"x{i}") for i in range(2)])


def v2(spark, sf):
    """Component scores on two channels, as magnitudes (signs are fixed per channel by P12)."""
    return run(spark, sf, ("pca", 2), two=True, scaling="global_mean").select(
        *KEYS, "t", *[rnd(F.abs(F.col("x")[i])).alias(f"y{i}") for i in range(2)])


def v3(spark, sf):
    return run(spark, sf, ("dpca", 5))


def stats(spark, sf, spec, **kw):
    """Length, variance and sign rule per run and channel."""
    y = run(spark, sf, spec, **kw).select(*KEYS, "t", F.posexplode("x").alias("channel", "v"))
    peak = F.max_by("v", F.struct(F.abs("v"), -F.col("t")))
    return y.groupBy(*KEYS, "channel").agg(F.count("*").alias("n"), rnd(F.var_samp("v"), 4).alias("variance"),
                                           (peak >= 0).alias("positive_peak"), F.max("t").alias("last_t"))


def v4_unit(spark, sf):
    return stats(spark, sf, ("cva", 2), two=True, numerics=Numerics(ridge=0.0))


def v4_one(spark, sf):
    """One channel: the variate is the standardised past value."""
    df = rows(spark, sf, True).withColumn("x", F.array(F.col("x")[0]))
    ctx = projections.Context(PipelineConfig((("cva", 1),), fix_signs=False, numerics=Numerics(ridge=0.0)), 1)
    y = projections.project(df, ("cva", 1), ctx)
    return y.select(*KEYS, "t", rnd(F.abs(F.col("x")[0])).alias("y"))


def v6_unit(spark, sf):
    return stats(spark, sf, ("ica", 2))


def uncorrelated(spark, sf, spec, **kw):
    """Largest correlation between two channels of a run, to three digits."""
    y = run(spark, sf, spec, **kw)
    k = len(projections.channel_names(spec))
    pairs = [F.abs(F.corr(F.col("x")[i], F.col("x")[j])) for i in range(k) for j in range(i)]
    return y.groupBy(*KEYS).agg(F.count("*").alias("n"), rnd(F.greatest(*pairs, F.lit(0.0)), 3).alias("most"))


def v6_apart(spark, sf):
    return uncorrelated(spark, sf, ("ica", 2))


def v7_apart(spark, sf):
    return uncorrelated(spark, sf, ("dycvda", 2, 3, 2, 4), numerics=Numerics(ridge=0.0))


def v5(spark, sf):
    return run(spark, sf, ("dyca", 2, 3))


def v7(spark, sf):
    return run(spark, sf, ("dycvda", 2, 3, 2, 4))


def v8_status(spark, sf):
    df = rows(spark, sf)
    ctx = projections.Context(PipelineConfig((("dyca", 2, 3),)), 4)
    return projections.status_of(df, ("dyca", 2, 3), ctx).groupBy("status").count()


def v9(spark, sf):
    """A user-defined projection: difference and sum of the first two channels."""
    def halves(df, spec, ctx):
        return df.select(*KEYS, "t", F.array(F.col("x")[0] - F.col("x")[1], F.col("x")[0] + F.col("x")[1]).alias("x")), None

    projections.add_kind("halves", projections.Projection(lambda s, p: projections.Layout("halves", ["h1", "h2"]), halves, signs=False))
    return run(spark, sf, ("halves",), two=True, scaling="global_mean").select(
        *KEYS, "t", *[rnd(F.col("x")[i]).alias(f"h{i + 1}") for i in range(2)])


def v3_total(spark, sf):
    """All components of the lag stack together keep its total variance."""
    y = run(spark, sf, ("dpca", 6), two=True, scaling="global_mean").select(*KEYS, "t", F.posexplode("x").alias("c", "v"))
    per = y.groupBy(*KEYS, "c").agg(F.var_samp("v").alias("s"), F.count("*").alias("n"))
    return per.groupBy(*KEYS).agg(F.max("n").alias("n"), rnd(F.sum("s")).alias("total"))


def v5_one(spark, sf):
    """One channel: the amplitude is the scaled signal, turned so that its peak is positive."""
    df = rows(spark, sf, True).withColumn("x", F.array(F.round(F.col("x")[0], 6)))
    ctx = projections.Context(PipelineConfig((("dyca", 1, 1),)), 1)
    return projections.project(df, ("dyca", 1, 1), ctx).select(*KEYS, "t", rnd(F.abs(F.col("x")[0])).alias("y"))


CUT = "cut AS (SELECT *, CAST(sample - 21 AS BIGINT) AS t FROM runs2 WHERE sample >= 21)"


def R2(body):
    return with_views("runs2", body)


QUERIES = {
    "v1_project_raw": (v1, R2(f"WITH {CUT}, m AS (SELECT {K}, avg((a+b)/2) AS m FROM cut GROUP BY 1,2) SELECT {K}, t, {q('a-m')} AS x0, {q('b-m')} AS x1 FROM cut JOIN m USING ({K})")),
    "v2_project_pca": (v2, R2(f"""WITH {CUT}, m AS (SELECT {K}, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS p, covar_pop(a,b) AS o, var_pop(b) AS s FROM cut GROUP BY 1,2),
e AS (SELECT *, (p+s)/2 + sqrt((p-s)*(p-s)/4+o*o) AS l FROM m), u AS (SELECT *, CASE WHEN abs(l-p) > abs(l-s) THEN o ELSE l-s END AS va, CASE WHEN abs(l-p) > abs(l-s) THEN l-p ELSE o END AS vb FROM e),
w AS (SELECT {K}, ma, mb, va/sqrt(va*va+vb*vb) AS c, vb/sqrt(va*va+vb*vb) AS d FROM u)
SELECT {K}, t, {q('abs((a-ma)*c+(b-mb)*d)')} AS y0, {q('abs((a-ma)*d-(b-mb)*c)')} AS y1 FROM cut JOIN w USING ({K})""")),
    "v3_project_dpca": (v3, None),
    "v3_dpca_total_variance": (v3_total, R2(f"""WITH {CUT}, l AS (SELECT {K}, a, b, lag(a) {OVER} AS a1, lag(b) {OVER} AS b1, lag(a,2) {OVER} AS a2, lag(b,2) {OVER} AS b2 FROM cut)
SELECT {K}, count(*) AS n, {q('var_samp(a)+var_samp(b)+var_samp(a1)+var_samp(b1)+var_samp(a2)+var_samp(b2)')} AS total FROM l WHERE a2 IS NOT NULL GROUP BY 1,2""")),
    "v5_dyca_one_channel": (v5_one, R2(f"WITH {CUT}, m AS (SELECT {K}, avg(round(a,6)) AS m FROM cut GROUP BY 1,2) SELECT {K}, t, {q('abs(round(a,6)-m)')} AS y FROM cut JOIN m USING ({K})")),
    "v4_project_cva": (v4_one, R2(f"""WITH {CUT}, l AS (SELECT {K}, t, lag(a) {OVER} AS p FROM cut), m AS (SELECT {K}, avg(p) AS m, stddev_samp(p) AS s FROM l GROUP BY 1,2)
SELECT {K}, t - 1 AS t, {q('abs((p-m)/s)')} AS y FROM l JOIN m USING ({K}) WHERE p IS NOT NULL""")),
    "v4_cva_unit_variance": (v4_unit, R2(f"WITH {CUT} SELECT {K}, c AS channel, count(*) - 1 AS n, 1.0::DOUBLE AS variance, true AS positive_peak, count(*) - 2 AS last_t FROM cut, (VALUES (0),(1)) v(c) GROUP BY {K}, c")),
    "v5_project_dyca": (v5, None),
    "v6_project_ica": (v6_unit, R2(f"WITH {CUT} SELECT {K}, c AS channel, count(*) AS n, {q('count(*)/(count(*)-1.0)', 4)} AS variance, true AS positive_peak, count(*) - 1 AS last_t FROM cut, (VALUES (0),(1)) v(c) GROUP BY {K}, c")),
    "v7_project_dycvda": (v7, None),
    "v6_ica_uncorrelated": (v6_apart, R2(f"WITH {CUT} SELECT {K}, count(*) AS n, 0.0::DOUBLE AS most FROM cut GROUP BY 1,2")),
    "v7_dycvda_uncorrelated": (v7_apart, R2(f"WITH {CUT} SELECT {K}, count(*) - 3 AS n, 0.0::DOUBLE AS most FROM cut GROUP BY 1,2")),
    "v8_project_status": (v8_status, R2(f"WITH {CUT} SELECT 'ok' AS status, count(*) AS count FROM (SELECT DISTINCT {K} FROM cut)")),
    "v9_registered_projection": (v9, R2(f"WITH {CUT} SELECT {K}, t, {q('a-b')} AS h1, {q('a+b')} AS h2 FROM cut")),
}
