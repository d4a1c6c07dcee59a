"""Feature ranking on the embedding matrix (64 features, 10 classes)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import ranking
from runlens.operators.values import ordered_counts, quantiles, range_sizes, value_counts

from .views import feature_long, q, rnd, vectors, with_gaps, with_views

LABELS = list(range(10))


def coarse(spark, sf):
    """Values rounded to two digits, which makes ties and one two-valued feature."""
    f = feature_long(spark, sf)
    two = F.when(F.col("value") > 0, 1.0).otherwise(0.0)
    return f.withColumn("value", F.when(F.col("feature") == "f63", two).when(F.col("feature") == "f62", 0.0)
                        .otherwise(F.floor(F.col("value") * 100) / 100))


def p8(spark, sf):
    return ranking.impute_range(with_gaps(feature_long(spark, sf))).select("run_id", "feature", rnd("value").alias("value"))


def p10(spark, sf):
    return ranking.drop_constant_features(coarse(spark, sf)).select("run_id", "feature", "value")


def a14_j7(spark, sf):
    f = ranking.anova_f(feature_long(spark, sf))
    names = coarse(spark, sf).select("feature").distinct()
    return names.join(f, "feature", "left").select("feature", rnd(F.coalesce("f_value", F.lit(0.0)), 5).alias("f_value"))


def w9(spark, sf):
    rows = coarse(spark, sf)
    ranks = ordered_counts(value_counts(rows, ["feature"]), ["feature"], per_bin=8)
    return ranks.select("feature", "value", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))


def a15_u(spark, sf):
    t = ranking.mann_whitney(ranking.rank_sums(coarse(spark, sf), LABELS)).where("values > 1")
    return t.select("feature", "label", "n1", F.col("u"), rnd("z").alias("z"))


def a15_relevance(spark, sf):
    t = ranking.relevance_table(coarse(spark, sf), LABELS)
    return t.select("feature", "n_significant", rnd("p_min").alias("p_min"))


def a15_plain(spark, sf):
    t = ranking.relevance_table(feature_long(spark, sf), LABELS)
    return t.select("feature", "n_significant", rnd("p_min").alias("p_min"))


def pseudo_p(spark, sf):
    """A p-like number in (0, 1) per (feature, class), from class means."""
    f = feature_long(spark, sf).groupBy("feature", "label").agg(F.avg("value").alias("m"))
    return f.select("feature", "label", (F.abs("m") * F.abs("m") * F.abs("m")).alias("p"))


def a16_by(spark, sf):
    return ranking.fdr_correct(pseudo_p(spark, sf)).select("feature", "label", "relevant")


def a16_bh(spark, sf):
    p = ranking.with_feature_block(pseudo_p(spark, sf), 20)
    return ranking.fdr_correct(p, dependent=False, block="block").select("feature", "label", "block", "relevant")


def rank_table(spark, sf):
    f = feature_long(spark, sf)
    return ranking.rank_features(f, LABELS)


def t1_blocks(spark, sf):
    """False discoveries controlled in blocks of 20 features."""
    rank = ranking.rank_features(feature_long(spark, sf), LABELS, block_cols=20)
    return rank.select("feature", "n_significant", rnd("f_value", 5).alias("f_value"))


def t1(spark, sf):
    return rank_table(spark, sf).select("feature", "n_significant", rnd("f_value", 5).alias("f_value"))


def t2(spark, sf):
    return ranking.top_k_features(rank_table(spark, sf), 20).select("feature", "place")


def f3_like_quantiles(spark, sf):
    o = ordered_counts(value_counts(feature_long(spark, sf), ["feature"]), ["feature"], per_bin=50)
    return quantiles(o, ["feature"], [0.1, 0.5, 0.9]).select("feature", *[rnd(F.col("q")[i]).alias(n) for i, n in
                                                                          enumerate(("q10", "q50", "q90"))])


def products(spark, sf):
    """2,080 derived features: products of two of the 64 values."""
    pairs = F.expr("flatten(transform(sequence(0, 63), i -> transform(sequence(i, 63), j -> named_struct("
                   "'feature', concat('p', lpad(cast(i as string), 2, '0'), '_', lpad(cast(j as string), 2, '0')), 'value', x[i] * x[j]))))")
    return vectors(spark, sf).select("run_id", "label", "split", F.explode(pairs).alias("e")).select("run_id", "label", "split", "e.*")


def t1_many(spark, sf):
    rank = ranking.rank_features(products(spark, sf), LABELS)
    return rank.select("feature", "n_significant", rnd("f_value", 5).alias("f_value"))


def w9_tails(spark, sf):
    """Ranks of exp(20 v): nearly all values lie in a tiny part of their range."""
    rows = feature_long(spark, sf).withColumn("value", F.exp(20 * F.col("value")))
    ranks = ordered_counts(value_counts(rows, ["feature"]), ["feature"], per_bin=2000)
    return ranks.select("feature", rnd(F.log("value"), 4).alias("log_value"), "n", "before", "total")


def w9_ranges(spark, sf):
    """The largest range against the even share of all values."""
    rows = feature_long(spark, sf).withColumn("value", F.exp(20 * F.col("value")))
    counts = value_counts(rows, ["feature"])
    sizes = range_sizes(ordered_counts(counts, ["feature"], per_bin=2000, keep_range=True))
    return sizes.agg(F.sum("rows").cast("bigint").alias("rows"), (F.max("rows") < 2 * 2000).alias("even"))


COARSE = """coarse AS (SELECT run_id, label, feature, CASE feature WHEN 'f63' THEN CASE WHEN value>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
 WHEN 'f62' THEN 0.0::DOUBLE ELSE floor(value*100)/100 END AS value FROM feat)"""
RANKS = """rk AS (SELECT feature, label, value, rank() OVER (PARTITION BY feature ORDER BY value)
 + (count(*) OVER (PARTITION BY feature, value) - 1)/2.0 AS r, count(*) OVER (PARTITION BY feature) AS n FROM {src}),
ti AS (SELECT feature, sum(c*c*c-c)::DOUBLE AS ties, count(*) AS vals FROM (SELECT feature, value, count(*)::DOUBLE AS c FROM {src} GROUP BY 1,2) GROUP BY 1),
mw AS (SELECT feature, label, max(n)::DOUBLE AS n, count(*) AS n1, sum(r) - count(*)*(count(*)+1)/2.0 AS u FROM rk GROUP BY 1,2),
zz AS (SELECT feature, label, n1, u::DOUBLE AS u, vals, n, (abs(u - n1*(n-n1)/2) - 0.5)/sqrt(n1*(n-n1)/12*((n+1) - ties/(n*(n-1)))) AS z
 FROM mw JOIN ti USING (feature) WHERE vals > 1)"""
# erfc by a 60-point midpoint rule of exp(-z^2/2 * (1 + tan^2)) (Craig's form of the normal tail); accurate far below 1e-6.
TAIL = """p AS (SELECT feature, label, vals, u, z, CASE WHEN z < 0 THEN 1.0 ELSE
 2*(SELECT sum(exp(-z*z/2/pow(sin((i+0.5)*pi()/2/400),2)))/400/2 FROM range(400) t(i)) END AS p FROM zz)"""
FDR = """k AS (SELECT *, row_number() OVER (PARTITION BY label{b} ORDER BY p, feature) AS k, count(*) OVER (PARTITION BY label{b}) AS m FROM {src}),
c AS (SELECT *, {c} AS c FROM k), l AS (SELECT *, max(CASE WHEN p <= k*0.05/(m*c) THEN k END) OVER (PARTITION BY label{b}) AS lastk FROM c),
fdr AS (SELECT *, coalesce(k <= lastk, false) AS relevant FROM l)"""
BY = "sum(1.0::DOUBLE/k) OVER (PARTITION BY label)"
PSEUDO = "ps AS (SELECT feature, label, abs(avg(value))*abs(avg(value))*abs(avg(value)) AS p FROM feat GROUP BY 1,2)"
ANOVA = """cell AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS s FROM feat GROUP BY 1,2),
gr AS (SELECT feature, sum(n*m)/sum(n) AS g FROM cell GROUP BY 1),
an AS (SELECT feature, (sum(n*(m-g)*(m-g))/(count(*)-1))/(sum(n*s)/(sum(n)-count(*))) AS f_value FROM cell JOIN gr USING (feature) GROUP BY 1)"""
RANKED = f"WITH {RANKS.format(src='feat')}, {TAIL}, {FDR.format(src='p', b='', c=BY)}, {ANOVA}, " \
    "rt AS (SELECT feature, CAST(sum(CAST(relevant AS INTEGER)) AS BIGINT) AS n_significant, max(f_value) AS f_value FROM fdr JOIN an USING (feature) GROUP BY 1)"

QUERIES = {
    "p8_impute_range": (p8, with_views("gaps", f"""
WITH g AS (SELECT feature, min(value) AS lo, max(value) AS hi, median(value) AS med FROM gaps WHERE isfinite(value) GROUP BY 1)
SELECT run_id, feature, {q("CASE WHEN value IS NULL OR isnan(value) THEN med WHEN value='inf'::DOUBLE THEN hi WHEN value='-inf'::DOUBLE THEN lo ELSE value END")} AS value FROM gaps JOIN g USING (feature)""")),
    "p10_drop_constant": (p10, with_views("feat", f"WITH {COARSE} SELECT run_id, feature, value FROM coarse WHERE feature IN (SELECT feature FROM coarse GROUP BY 1 HAVING stddev_pop(value) > 0)")),
    "a14_j7_anova_f": (a14_j7, with_views("feat", f"WITH {ANOVA} SELECT feature, {q('f_value', 5)} AS f_value FROM an")),
    "w9_rank_with_ties": (w9, with_views("feat", f"""WITH {COARSE}, r AS (SELECT feature, value, rank() OVER (PARTITION BY feature ORDER BY value) AS k FROM coarse)
SELECT feature, value, count(*) AS n, min(k)::DOUBLE + (count(*)-1)/2 AS rank FROM r GROUP BY 1,2""")),
    "w9_heavy_tails": (w9_tails, with_views("feat", f"""WITH r AS (SELECT feature, exp(20*value) AS v, value FROM feat),
c AS (SELECT feature, v, count(*) AS n FROM r GROUP BY 1,2)
SELECT feature, {q('ln(v)', 4)} AS log_value, n, CAST(sum(n) OVER (PARTITION BY feature ORDER BY v) - n AS BIGINT) AS before,
 CAST(sum(n) OVER (PARTITION BY feature) AS BIGINT) AS total FROM c""")),
    "w9_even_ranges": (w9_ranges, with_views("feat", "SELECT count(DISTINCT (feature, exp(20*value))) AS rows, true AS even FROM feat")),
    "a15_mann_whitney": (a15_u, with_views("feat", f"WITH {COARSE}, {RANKS.format(src='coarse')} SELECT feature, label, n1, u, {q('z')} AS z FROM zz")),
    "a15_relevance_table": (a15_relevance, None),
    "a15_relevance_values": (a15_plain, with_views("feat", f"WITH {RANKS.format(src='feat')}, {TAIL}, {FDR.format(src='p', b='', c=BY)} SELECT feature, CAST(sum(CAST(relevant AS INTEGER)) AS BIGINT) AS n_significant, {q('min(p)')} AS p_min FROM fdr GROUP BY 1")),
    "a16_fdr_dependent": (a16_by, with_views("feat", f"WITH {PSEUDO}, {FDR.format(src='ps', b='', c=BY)} SELECT feature, label, relevant FROM fdr")),
    "a16_fdr_blocks": (a16_bh, with_views("feat", f"WITH {PSEUDO}, pb AS (SELECT *, CAST((dense_rank() OVER (ORDER BY feature)-1)//20 AS INTEGER) AS block FROM ps), {FDR.format(src='pb', b=', block', c='1.0')} SELECT feature, label, block, relevant FROM fdr")),
    "t1_rank_features": (t1, with_views("feat", f"{RANKED} SELECT feature, n_significant, {q('f_value', 5)} AS f_value FROM rt")),
    "t1_rank_many_features": (t1_many, with_views("vec", f"""WITH v64 AS (SELECT run_id, label, split, i, CAST(embedding[i+1] AS DOUBLE) AS v FROM vec, (SELECT unnest(range(64)) AS i)),
feat AS (SELECT a.run_id, a.label, a.split, 'p' || lpad(CAST(a.i AS VARCHAR), 2, '0') || '_' || lpad(CAST(b.i AS VARCHAR), 2, '0') AS feature, a.v*b.v AS value
 FROM v64 a JOIN v64 b ON a.run_id=b.run_id AND a.i<=b.i), {RANKED[5:]} SELECT feature, n_significant, {q('f_value', 5)} AS f_value FROM rt""")),
    "t1_rank_features_blocks": (t1_blocks, with_views("feat", f"""WITH {RANKS.format(src='feat')}, {TAIL},
pb AS (SELECT *, CAST((dense_rank() OVER (ORDER BY feature)-1)//20 AS INTEGER) AS block FROM p),
{FDR.format(src='pb', b=', block', c=BY.replace('label', 'label, block'))}, {ANOVA},
rt AS (SELECT feature, CAST(sum(CAST(relevant AS INTEGER)) AS BIGINT) AS n_significant, max(f_value) AS f_value FROM fdr JOIN an USING (feature) GROUP BY 1)
SELECT feature, n_significant, {q('f_value', 5)} AS f_value FROM rt""")),
    "t2_top_k_features": (t2, with_views("feat", f"{RANKED} SELECT feature, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (ORDER BY n_significant DESC, f_value DESC, feature) - 1 AS place FROM rt) WHERE place < 20")),
    "value_bins_quantiles": (f3_like_quantiles, with_views("feat", f"SELECT feature, {q('quantile_cont(value,0.1)')} AS q10, {q('quantile_cont(value,0.5)')} AS q50, {q('quantile_cont(value,0.9)')} AS q90 FROM feat GROUP BY 1")),
}
