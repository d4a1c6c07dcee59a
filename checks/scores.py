"""Predictions, confusion tables, leaderboards, set operations on feature sets."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.operators import baselines, discriminants, metrics, models, neighbours, prep, reports, sets
from runlens.session import checkpoint_dir, cut_lineage

from .views import feature_long, q, rnd, table, typed_series, vectors, with_views

LABELS = list(range(10))
# Configs of the fixture: which of the 64 values a config uses.
CONFIGS = {"all": range(0, 64), "first": range(0, 8), "odd": range(1, 64, 2)}
MODELS = {"centroid": baselines.nearest_centroid, "bayes": baselines.gaussian_nb,
          "majority": baselines.majority_baseline}


def matrix(spark, sf, config):
    pos = ", ".join(f"x[{i}]" for i in CONFIGS[config])
    return vectors(spark, sf).withColumn("x", F.expr(f"array({pos})"))


def predict(spark, sf, config, model) -> DataFrame:
    m = matrix(spark, sf, config)
    return MODELS[model](m.where("split = 'train'"), m.where("split = 'test'")).withColumn("config", F.lit(config))


def preds(spark, sf) -> DataFrame:
    return reduce(DataFrame.unionByName, [predict(spark, sf, c, "centroid") for c in CONFIGS])


def cm(spark, sf):
    return metrics.confusion_counts(preds(spark, sf), LABELS)


FOLDS = 3
BOARDS: dict = {}


def board(spark, sf) -> DataFrame:
    """Leaderboard of configs x models by ``summary_rows``; cross-validation over the training rows for all but the majority."""
    preds_, cv, kept = [], [], []
    for c in CONFIGS:
        folded = models.fold_column(matrix(spark, sf, c).where("split = 'train'"), FOLDS).cache()
        kept.append(folded)
        for m, fit in MODELS.items():
            preds_.append(predict(spark, sf, c, m).withColumn("model", F.lit(m)))
            mean, std = ((F.avg("balanced_acc"), F.stddev_pop("balanced_acc")) if m != "majority"
                         else (F.lit(None).cast("double"), F.lit(None).cast("double")))
            scores = models.fold_scores(folded, fit, FOLDS, LABELS) if m != "majority" else spark.range(1)
            cv.append(scores.select(F.lit(c).alias("config"), F.lit(m).alias("model"), mean.alias("cv_mean"), std.alias("cv_std")))
    table_ = cut_lineage(reduce(DataFrame.unionByName, cv))  # one job for all folds, configs and models
    for folded in kept:
        folded.unpersist()
    return models.summary_rows(reduce(DataFrame.unionByName, preds_), table_, LABELS)


def boards(spark, sf) -> DataFrame:
    """The leaderboard, stored once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in BOARDS:
        path = f"{checkpoint_dir(spark)}/runlens-board-{uuid.uuid4().hex}"
        board(spark, sf).write.parquet(path)
        BOARDS[key] = path
    return spark.read.parquet(BOARDS[key]).select("config", "model", "balanced_acc", "macro_f1", "cv_mean")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: rnd(c, digits) for c in cols})


def _set_sql(config):
    s = CONFIGS[config]
    return f"""sel_{config} AS (SELECT run_id, label, split, i, CAST(embedding[i+1] AS DOUBLE) AS v FROM vec,
 (SELECT unnest(range({s.start},{s.stop},{s.step})) AS i))"""


def _centroid_sql(config):
    return f"""{_set_sql(config)}, cen_{config} AS (SELECT label, i, avg(v) AS m FROM sel_{config} WHERE split='train' GROUP BY 1,2),
dist_{config} AS (SELECT t.run_id, t.label AS y_true, c.label AS cand, sum((v-m)*(v-m)) AS d FROM sel_{config} t
 JOIN cen_{config} c USING (i) WHERE split='test' GROUP BY 1,2,3),
pred_{config} AS (SELECT '{config}' AS config, run_id, y_true, y_pred FROM (SELECT run_id, y_true, cand AS y_pred,
 row_number() OVER (PARTITION BY run_id ORDER BY d, cand) AS r FROM dist_{config}) WHERE r = 1)"""


def _bayes_sql(config):
    return f"""nbm_{config} AS (SELECT label, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM sel_{config} WHERE split='train' GROUP BY 1,2),
nbe_{config} AS (SELECT max(s)*1e-9 AS e FROM (SELECT i, var_pop(v) AS s FROM sel_{config} WHERE split='train' GROUP BY 1)),
nbt_{config} AS (SELECT sum(n) AS t FROM nbm_{config} WHERE i={CONFIGS[config].start}),
nbd_{config} AS (SELECT x.run_id, x.label AS y_true, c.label AS cand,
 sum(ln(2*pi()*(s+e)) + (v-m)*(v-m)/(s+e)) - 2*ln(max(n)/max(t)) AS d FROM sel_{config} x JOIN nbm_{config} c USING (i),
 nbe_{config}, nbt_{config} WHERE split='test' GROUP BY 1,2,3),
bay_{config} AS (SELECT '{config}' AS config, run_id, y_true, y_pred FROM (SELECT run_id, y_true, cand AS y_pred,
 row_number() OVER (PARTITION BY run_id ORDER BY d, cand) AS r FROM nbd_{config}) WHERE r = 1)"""


def _cv_sql(config):
    """Mean balanced accuracy over the folds: every fold is predicted from the other ones."""
    best = "row_number() OVER (PARTITION BY run_id ORDER BY d, cand)"
    score = lambda name, m: f"""SELECT '{config}' AS config, '{m}' AS model, avg(b) AS cv_mean, stddev_pop(b) AS cv_std FROM (SELECT f, avg(r) AS b FROM (
 SELECT f, label, avg(CASE WHEN cand=label THEN 1.0 ELSE 0.0 END) AS r FROM (SELECT *, {best} AS w FROM {name}_{config}) WHERE w=1 GROUP BY 1,2) GROUP BY 1)"""  # noqa: E731
    return f"""fs_{config} AS (SELECT s.run_id, s.label, i, v, fold FROM sel_{config} s JOIN fold USING (run_id)),
fm_{config} AS (SELECT f, label, i, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM fs_{config}, fno WHERE fold<>f GROUP BY 1,2,3),
fe_{config} AS (SELECT f, max(s)*1e-9 AS e FROM (SELECT f, i, var_pop(v) AS s FROM fs_{config}, fno WHERE fold<>f GROUP BY 1,2) GROUP BY 1),
ft_{config} AS (SELECT f, sum(n) AS t FROM fm_{config} WHERE i={CONFIGS[config].start} GROUP BY 1),
fc_{config} AS (SELECT c.f, x.run_id, x.label, c.label AS cand, sum((v-m)*(v-m)) AS d FROM fs_{config} x JOIN fm_{config} c ON c.f=x.fold AND c.i=x.i GROUP BY 1,2,3,4),
fb_{config} AS (SELECT c.f, x.run_id, x.label, c.label AS cand, sum(ln(2*pi()*(s+e)) + (v-m)*(v-m)/(s+e)) - 2*ln(max(n)/max(t)) AS d
 FROM fs_{config} x JOIN fm_{config} c ON c.f=x.fold AND c.i=x.i JOIN fe_{config} g ON g.f=c.f JOIN ft_{config} h ON h.f=c.f GROUP BY 1,2,3,4),
cv_{config} AS ({score('fc', 'centroid')} UNION ALL {score('fb', 'bayes')})"""


def _majority_sql(config):
    return f"""maj_{config} AS (SELECT '{config}' AS config, run_id, label AS y_true, (SELECT label FROM vec WHERE split='train'
 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) AS y_pred FROM vec WHERE split='test')"""


PRED_SQL = "WITH " + ",\n".join(_centroid_sql(c) for c in CONFIGS) + """,
pred AS (""" + " UNION ALL ".join(f"SELECT * FROM pred_{c}" for c in CONFIGS) + ")"
CM_SQL = PRED_SQL + """,
lab AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS l),
cm AS (SELECT c.config, a.l AS y_true, b.l AS y_pred, count(p.run_id) AS n FROM (SELECT DISTINCT config FROM pred) c, lab a, lab b
 LEFT JOIN pred p ON p.config=c.config AND p.y_true=a.l AND p.y_pred=b.l GROUP BY 1,2,3)"""
SC_SQL = CM_SQL + """,
act AS (SELECT config, y_true AS label, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN y_true=y_pred THEN n ELSE 0 END) AS BIGINT) AS tp FROM cm GROUP BY 1,2),
gue AS (SELECT config, y_pred AS label, CAST(sum(n) AS BIGINT) AS predicted FROM cm GROUP BY 1,2),
sc AS (SELECT config, label, support, tp, predicted, CASE WHEN predicted>0 THEN tp/predicted ELSE 0.0 END AS precision,
 CASE WHEN support>0 THEN tp/support ELSE 0.0 END AS recall, CASE WHEN support+predicted>0 THEN 2.0*tp/(support+predicted) ELSE 0.0 END AS f1
 FROM act JOIN gue USING (config, label))"""


def _board_sql():
    ctes = [_centroid_sql(c) for c in CONFIGS] + [_bayes_sql(c) for c in CONFIGS] + [_majority_sql(c) for c in CONFIGS]
    ctes += [f"fno AS (SELECT unnest(range({FOLDS})) AS f)", f"""fold AS (SELECT run_id, (row_number() OVER (PARTITION BY label ORDER BY run_id) - 1) % {FOLDS} AS fold
 FROM vec WHERE split='train')"""] + [_cv_sql(c) for c in CONFIGS]
    cv = " UNION ALL ".join(f"SELECT * FROM cv_{c}" for c in CONFIGS)
    names = {"centroid": "pred", "bayes": "bay", "majority": "maj"}
    union = " UNION ALL ".join(f"SELECT '{m}' AS model, config, y_true, y_pred FROM {names[m]}_{c}"
                               for c in CONFIGS for m in MODELS)
    return "WITH " + ",\n".join(ctes) + f""", p AS ({union}),
pc AS (SELECT config, model, y_true, y_pred, count(*) AS n FROM p GROUP BY 1,2,3,4),
pa AS (SELECT config, model, y_true AS l, sum(n) AS sup, sum(CASE WHEN y_true=y_pred THEN n ELSE 0 END) AS tp FROM pc GROUP BY 1,2,3),
pg AS (SELECT config, model, y_pred AS l, sum(n) AS gu FROM pc GROUP BY 1,2,3),
ps AS (SELECT config, model, l, coalesce(sup,0) AS sup, coalesce(tp,0) AS tp, coalesce(gu,0) AS gu FROM pa FULL JOIN pg USING (config, model, l)),
board AS (SELECT config, model, balanced_acc, macro_f1, cv_mean, cv_std FROM (SELECT config, model, avg(CASE WHEN sup>0 THEN tp/sup END) AS balanced_acc,
 avg(2.0*tp/(sup+gu)) AS macro_f1 FROM ps GROUP BY 1,2) LEFT JOIN ({cv}) USING (config, model))"""


BOARD_SQL = _board_sql()


def V(body):
    return with_views("vec", body)


def m4(spark, sf):
    return predict(spark, sf, "all", "majority")


def m5(spark, sf):
    return preds(spark, sf)


def m6_nb(spark, sf):
    return reduce(DataFrame.unionByName, [predict(spark, sf, c, "bayes") for c in CONFIGS])


def m6_knn(spark, sf):
    m = matrix(spark, sf, "all")
    return baselines.k_nearest(m.where("split = 'train'"), m.where("split = 'test'"), 5, tile=128)


def coarse(spark, sf):
    """Three values rounded down to quarters: many equal rows and many equal distances."""
    return vectors(spark, sf).withColumn("x", F.transform(F.slice("x", 1, 3), lambda v: F.floor(v * 8) / 8))


def m6_knn_ties(spark, sf):
    m = coarse(spark, sf)
    return neighbours.nearest_rows(m.where("split = 'train'"), m.where("split = 'test'"), 7, tile=32).select(
        "run_id", "near", "dist", "label", "place")


PAIR_MODELS = {"linear": discriminants.linear_discriminant, "quadratic": discriminants.quadratic_discriminant}


def pair(spark, sf):
    return vectors(spark, sf).withColumn("x", F.slice("x", 1, 2))


def m3_discriminants(spark, sf):
    m = pair(spark, sf)
    return reduce(DataFrame.unionByName, [
        fit(m.where("split = 'train'"), m.where("split = 'test'")).withColumn("model", F.lit(n)) for n, fit in PAIR_MODELS.items()])


def m7_discriminant_folds(spark, sf):
    folded = models.fold_column(pair(spark, sf).where("split = 'train'"), FOLDS)
    return reduce(DataFrame.unionByName, [
        rounded(models.fold_scores(folded, fit, FOLDS, LABELS), "balanced_acc").withColumn("model", F.lit(n))
        for n, fit in PAIR_MODELS.items()])


def m3_compare(spark, sf):
    """The leaderboard of both discriminants: test scores and cross-validation over three folds."""
    m = pair(spark, sf)
    board = models.compare_models(m.where("split = 'train'"), m.where("split = 'test'"), LABELS, "pair",
                                  ["LinearDiscriminantAnalysis", "QuadraticDiscriminantAnalysis"], cv_folds=FOLDS)[1]
    return rounded(board, "balanced_acc", "macro_f1", "cv_mean", "cv_std").drop("error")


V2 = "v2 AS (SELECT run_id, label, split, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM vec)"


def _pair_sql(p, learn, ask):
    """Predictions {p}q of both discriminants: per training set f class moments, pooled moments, and the scores of every row asked."""
    return f"""{p}learn AS ({learn}), {p}ask AS ({ask}),
{p}c AS (SELECT f, label, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a,b) AS ab FROM {p}learn GROUP BY 1,2),
{p}p AS (SELECT f, sum(n) AS t, sum(n*aa)/(sum(n)-count(*)) AS paa, sum(n*bb)/(sum(n)-count(*)) AS pbb, sum(n*ab)/(sum(n)-count(*)) AS pab FROM {p}c GROUP BY 1),
{p}s AS (SELECT k.f, k.run_id, k.label, c.label AS cand, k.a-ma AS x, k.b-mb AS y, ln(n/t) AS p, paa, pbb, pab, n/(n-1)*aa AS qaa, n/(n-1)*bb AS qbb, n/(n-1)*ab AS qab
 FROM {p}ask k JOIN {p}c c ON c.f=k.f JOIN {p}p r ON r.f=k.f),
{p}d AS (SELECT 'linear' AS model, f, run_id, label, cand, (pbb*x*x-2*pab*x*y+paa*y*y)/(paa*pbb-pab*pab)-2*p AS d FROM {p}s UNION ALL
 SELECT 'quadratic', f, run_id, label, cand, (qbb*x*x-2*qab*x*y+qaa*y*y)/(qaa*qbb-qab*qab)+ln(qaa*qbb-qab*qab)-2*p FROM {p}s),
{p}q AS (SELECT model, f, run_id, label AS y_true, cand AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY model, run_id ORDER BY d, cand) AS r FROM {p}d) WHERE r = 1)"""


SPLIT_SQL = _pair_sql("p", "SELECT 0 AS f, * FROM v2 WHERE split='train'", "SELECT 0 AS f, * FROM v2 WHERE split='test'")
FOLDS_SQL = f"""fd AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY run_id) - 1) % {FOLDS} AS fold FROM v2 WHERE split='train'),
""" + _pair_sql("g", f"SELECT f, fd.* FROM fd, (SELECT unnest(range({FOLDS})) AS f) WHERE fold <> f", "SELECT fold AS f, fd.* FROM fd") + """,
gb AS (SELECT model, f, avg(r) AS b FROM (SELECT model, f, y_true, avg(CASE WHEN y_true=y_pred THEN 1.0 ELSE 0.0 END) AS r FROM gq GROUP BY 1,2,3) GROUP BY 1,2)"""
PAIR_BOARD = f"""WITH {V2}, {SPLIT_SQL}, {FOLDS_SQL}, lb AS (SELECT CAST(unnest(range(10)) AS INTEGER) AS l), ml AS (SELECT DISTINCT model FROM pq),
cl AS (SELECT ml.model, l, count(CASE WHEN y_true=l THEN 1 END) AS sup, count(CASE WHEN y_pred=l THEN 1 END) AS gu, count(CASE WHEN y_true=l AND y_pred=l THEN 1 END) AS tp
 FROM ml JOIN lb ON true JOIN pq ON pq.model=ml.model GROUP BY 1,2)
SELECT 'pair' AS config, CASE cl.model WHEN 'linear' THEN 'LinearDiscriminantAnalysis' ELSE 'QuadraticDiscriminantAnalysis' END AS model, 'ok' AS status,
 {q('avg(CASE WHEN sup>0 THEN tp/sup END)')} AS balanced_acc, {q('avg(CASE WHEN sup+gu>0 THEN 2.0*tp/(sup+gu) END)')} AS macro_f1,
 any_value({q('cm')}) AS cv_mean, any_value({q('cs')}) AS cv_std
FROM cl JOIN (SELECT model, avg(b) AS cm, stddev_pop(b) AS cs FROM gb GROUP BY 1) c ON c.model=cl.model GROUP BY cl.model"""


def a5(spark, sf):
    return cm(spark, sf)


def a5_square(spark, sf):
    return metrics.confusion_square(cm(spark, sf), LABELS)


def a6(spark, sf):
    return rounded(metrics.normalize_rows(cm(spark, sf)), "share")


def a7(spark, sf):
    return rounded(metrics.balanced_accuracy(cm(spark, sf)), "balanced_acc")


def a8(spark, sf):
    return rounded(metrics.macro_f1(cm(spark, sf)), "macro_f1")


def a9(spark, sf):
    return rounded(metrics.classification_report(cm(spark, sf)), "precision", "recall", "f1")


def a10(spark, sf):
    return rounded(metrics.recall_table(cm(spark, sf), LABELS), *[f"recall_{v}" for v in LABELS])


def a11(spark, sf):
    return rounded(metrics.hardest_classes(cm(spark, sf), 5), "recall")


def t3(spark, sf):
    return rounded(metrics.top_confusions(cm(spark, sf), 8), "share")


def board_view(fn):
    def run(spark, sf):
        df = fn(boards(spark, sf))
        return rounded(df, *[c for c, t in df.dtypes if t == "double"])
    return run


def j8(spark, sf):
    results = metrics.scores(cm(spark, sf))
    return rounded(metrics.reconcile(results, boards(spark, sf), "bayes"), "macro_f1", "stored", "diff")


def run_sets(spark, sf):
    """Two run sets of different strictness over the short series: long enough for 6 and for 12 samples."""
    n = typed_series(spark, sf).groupBy("faultNumber", "simulationRun").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("x")[0]), 4).alias("s"), F.max(F.col("x")[0]).alias("m"))
    split = F.when(F.col("simulationRun") % 5 == 0, "test").otherwise("train")
    n = n.withColumn("split", split).withColumn("run_id", prep.run_key())
    a = n.where("n >= 6").withColumn("config", F.lit("A")).withColumn("values", F.array("s"))
    b = n.where("n >= 12").withColumn("config", F.lit("B")).withColumn("values", F.array("m"))
    return a, b


def a4(spark, sf):
    a, b = run_sets(spark, sf)
    return sets.class_distribution(a.unionByName(b), ["A", "B"])


def j1(spark, sf):
    a, b = run_sets(spark, sf)
    both = sets.combine_feature_sets([a, b])
    return both.select("faultNumber", "simulationRun", rnd(F.col("values")[0], 3).alias("s"), F.col("values")[1].alias("m"))


def j2(spark, sf):
    a, b = run_sets(spark, sf)
    both = a.unionByName(b)
    return sets.restrict(both, sets.common_runs(both, 2)).select("config", "split", "run_id")


def wanted(spark, names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, place int")


def p11(spark, sf):
    long = feature_long(spark, sf).where("feature <= 'f20'")
    return rounded(sets.align_features(long, wanted(spark, ["f03", "f61", "f00", "f20"])), "value").withColumn(
        "place", F.col("place").cast("int"))


def u3(spark, sf):
    long = feature_long(spark, sf).where("feature <= 'f20'")
    return sets.missing_features(long, wanted(spark, ["f03", "f61", "f00", "f20", "f21"]))


def u4(spark, sf):
    f = feature_long(spark, sf)
    a = f.where("feature < 'f40'").select("feature").distinct()
    b = f.where("feature > 'f10'").select("feature").distinct()
    return sets.same_sets(a, b)


def order_sets(spark, sf):
    """Customers' orders as runs of a status class: run numbers far beyond 1000."""
    o = table(spark, sf, "orders")
    n = o.groupBy(F.expr("CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END").alias("faultNumber"),
                  F.col("o_custkey").cast("int").alias("simulationRun")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("m"))
    n = n.withColumn("split", F.lit("train")).withColumn("run_id", prep.run_key())
    return n.where("n >= 2").withColumn("config", F.lit("A")), n.where("m > 1000").withColumn("config", F.lit("B"))


def j2_many(spark, sf):
    a, b = order_sets(spark, sf)
    kept = sets.common_runs(a.unionByName(b), 2)
    return prep.key_columns(kept).select("faultNumber", "simulationRun", "split")


def u2(spark, sf):
    a, b = run_sets(spark, sf)
    return a.select("split", "run_id").intersect(b.select("split", "run_id"))


def j9(spark, sf):
    f = feature_long(spark, sf)
    both = sets.concat_configs({"low": f.where("feature < 'f04'"), "high": f.where("feature > 'f60'")})
    return rounded(both, "value")


def j9_all(spark, sf):
    f = feature_long(spark, sf)
    both = sets.concat_configs({"low": f.where("feature < 'f32'"), "high": f.where("feature >= 'f32'")})
    return rounded(both, "value")


SETS_SQL = """WITH n AS (SELECT "faultNumber", "simulationRun", count(*) AS n, sum(v) AS s, max(v) AS m,
 CASE WHEN "simulationRun" % 5 = 0 THEN 'test' ELSE 'train' END AS split, "faultNumber"*4294967296+"simulationRun" AS run_id
 FROM series1c GROUP BY 1,2),
ab AS (SELECT 'A' AS config, * FROM n WHERE n >= 6 UNION ALL SELECT 'B', * FROM n WHERE n >= 12)"""


def S(body):
    return with_views("series1c", SETS_SQL + body)


QUERIES = {
    "m4_majority_baseline": (m4, V("WITH " + _majority_sql("all") + " SELECT * FROM maj_all")),
    "m5_nearest_centroid": (m5, V(PRED_SQL + " SELECT * FROM pred")),
    "m6_gaussian_nb": (m6_nb, V("WITH " + ",\n".join(_set_sql(c) + ",\n" + _bayes_sql(c) for c in CONFIGS) + " "
                                + " UNION ALL ".join(f"SELECT * FROM bay_{c}" for c in CONFIGS))),
    "m6_k_nearest": (m6_knn, V("WITH " + _set_sql("all") + """,
d AS (SELECT a.run_id, a.label AS y_true, b.run_id AS near, b.label, sum((a.v-b.v)*(a.v-b.v)) AS dist
 FROM sel_all a JOIN sel_all b USING (i) WHERE a.split='test' AND b.split='train' GROUP BY 1,2,3,4),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dist, near) AS r FROM d),
v AS (SELECT run_id, y_true, label, count(*) AS c FROM k WHERE r <= 5 GROUP BY 1,2,3)
SELECT run_id, y_true, label AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY c DESC, label) AS w FROM v) WHERE w = 1""")),
    "m6_k_nearest_ties": (m6_knn_ties, V("""WITH sel AS (SELECT run_id, label, split, i, floor(CAST(embedding[i+1] AS DOUBLE)*8)/8 AS v FROM vec, (SELECT unnest(range(3)) AS i)),
d AS (SELECT a.run_id, b.run_id AS near, b.label, sum((a.v-b.v)*(a.v-b.v)) AS dist FROM sel a JOIN sel b USING (i) WHERE a.split='test' AND b.split='train' GROUP BY 1,2,3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY dist, near) AS INTEGER) AS place FROM d) WHERE place <= 7""")),
    "m3_discriminants": (m3_discriminants, V(f"WITH {V2}, {SPLIT_SQL} SELECT model, run_id, y_true, y_pred FROM pq")),
    "m3_compare_discriminants": (m3_compare, V(PAIR_BOARD)),
    "m7_discriminant_folds": (m7_discriminant_folds, V(f"WITH {V2}, {FOLDS_SQL} SELECT model, 'fold' || f AS config, {q('b')} AS balanced_acc FROM gb")),
    "a5_confusion_counts": (a5, V(CM_SQL + " SELECT * FROM cm")),
    "a5_confusion_square": (a5_square, V(CM_SQL + " SELECT config, y_true, " + ", ".join(
        f"CAST(sum(CASE WHEN y_pred={v} THEN n END) AS BIGINT) AS pred_{v}" for v in LABELS) + " FROM cm GROUP BY 1,2")),
    "a6_normalize_rows": (a6, V(CM_SQL + f" SELECT config, y_true, y_pred, n, {q('CASE WHEN s>0 THEN n/s ELSE 0 END')} AS share FROM (SELECT *, sum(n) OVER (PARTITION BY config, y_true) AS s FROM cm)")),
    "a7_balanced_accuracy": (a7, V(SC_SQL + f" SELECT config, {q('avg(recall)')} AS balanced_acc FROM sc WHERE support>0 GROUP BY 1")),
    "a8_macro_f1": (a8, V(SC_SQL + f" SELECT config, {q('avg(f1)')} AS macro_f1 FROM sc WHERE support+predicted>0 GROUP BY 1")),
    "a9_classification_report": (a9, V(SC_SQL + f""" SELECT config, CAST(label AS VARCHAR) AS name, {q('precision')} AS precision, {q('recall')} AS recall, {q('f1')} AS f1, support FROM sc
UNION ALL SELECT config, 'accuracy', {q('sum(tp)/sum(support)')}, {q('sum(tp)/sum(support)')}, {q('sum(tp)/sum(support)')}, CAST(sum(support) AS BIGINT) FROM sc GROUP BY 1
UNION ALL SELECT config, 'macro avg', {q('avg(precision)')}, {q('avg(recall)')}, {q('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM sc GROUP BY 1
UNION ALL SELECT config, 'weighted avg', {q('sum(precision*support)/sum(support)')}, {q('sum(recall*support)/sum(support)')}, {q('sum(f1*support)/sum(support)')}, CAST(sum(support) AS BIGINT) FROM sc GROUP BY 1""")),
    "a10_recall_table": (a10, V(SC_SQL + " SELECT config, " + ", ".join(f"{q(f'sum(CASE WHEN label={v} THEN recall END)')} AS recall_{v}" for v in LABELS) + " FROM sc GROUP BY 1")),
    "a11_hardest_classes": (a11, V(SC_SQL + f" SELECT label, {q('avg(recall)')} AS recall FROM sc GROUP BY 1 ORDER BY avg(recall), label LIMIT 5")),
    "t3_top_confusions": (t3, V(CM_SQL + f""" SELECT * FROM (SELECT config, y_true, y_pred, n, {q('n/s')} AS share,
 CAST(row_number() OVER (PARTITION BY config ORDER BY n DESC, y_true, y_pred) AS INTEGER) AS place
 FROM (SELECT *, sum(n) OVER (PARTITION BY config, y_true) AS s FROM cm) WHERE y_true<>y_pred AND n>0) WHERE place<=8""")),
    "m8_summary_rows": (board_view(lambda b: b), V(BOARD_SQL + f" SELECT config, model, {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q('cv_mean')} AS cv_mean FROM board")),
    "t4_best_per_config": (board_view(reports.best_per_config), V(BOARD_SQL + f" SELECT config, model, {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q('cv_mean')} AS cv_mean FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY macro_f1 DESC, model) AS r FROM board) WHERE r=1")),
    "t5_cv_best_per_config": (board_view(reports.cv_best_per_config), V(BOARD_SQL + f" SELECT config, model, {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q('cv_mean')} AS cv_mean FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY cv_mean DESC, model) AS r FROM board WHERE cv_mean IS NOT NULL) WHERE r=1")),
    "t6_fixed_model_view": (board_view(lambda b: reports.fixed_model_view(b, ["odd", "all", "first"], "bayes")),
                            V(BOARD_SQL + f" SELECT config, model, {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q('cv_mean')} AS cv_mean, CASE config WHEN 'odd' THEN 1 WHEN 'all' THEN 2 ELSE 3 END AS place FROM board WHERE model='bayes'")),
    "t7_sort_leaderboard": (board_view(lambda b: reports.sort_leaderboard(b)), V(BOARD_SQL + f" SELECT config, model, {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q('cv_mean')} AS cv_mean FROM (SELECT * FROM board)")),
    "t7_strongest_without_cv": (board_view(reports.strongest_without_cv), V(BOARD_SQL + f" SELECT config, model, {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q('cv_mean')} AS cv_mean FROM (SELECT * FROM board WHERE cv_mean IS NULL ORDER BY balanced_acc DESC, config, model LIMIT 3)")),
    "t9_best_config": (board_view(lambda b: reports.best_config(b.where("model = 'centroid'"))), V(BOARD_SQL + f" SELECT config, {q('macro_f1')} AS macro_f1 FROM board WHERE model='centroid' ORDER BY macro_f1 DESC, config DESC LIMIT 1")),
    "t10_cv_gap": (board_view(reports.cv_gap), V(BOARD_SQL + f""", b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY macro_f1 DESC, model) AS r FROM board) WHERE r=1),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY cv_mean DESC, model) AS r FROM board WHERE cv_mean IS NOT NULL) WHERE r=1)
SELECT b1.config, b1.model AS best_model, {q('b1.macro_f1')} AS best, b2.model AS cv_model, {q('b2.macro_f1')} AS cv, {q('b1.macro_f1-b2.macro_f1')} AS gap FROM b1 JOIN b2 ON b1.config=b2.config""")),
    "j8_reconcile": (j8, V(BOARD_SQL + f""", d AS (SELECT a.config, a.macro_f1, b.macro_f1 AS stored, abs(a.macro_f1-b.macro_f1) AS diff
 FROM board a JOIN board b ON a.config=b.config AND a.model='centroid' AND b.model='bayes')
SELECT config, {q('macro_f1')} AS macro_f1, {q('stored')} AS stored, {q('diff')} AS diff, row_number() OVER (ORDER BY diff DESC, config)=1 AS largest FROM d""")),
    "a4_class_distribution": (a4, S(""" SELECT "faultNumber", """ + ", ".join(
        f"CAST(sum(CASE WHEN config='{c}' AND split='{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {c}_{s}" for c in "AB" for s in ("train", "test"))
        + ", " + ", ".join(f"CAST(sum(CASE WHEN split='{s}' THEN CASE config WHEN 'A' THEN 1 ELSE -1 END ELSE 0 END) AS BIGINT) AS loss_B_{s}" for s in ("train", "test")) + " FROM ab GROUP BY 1")),
    "j1_combine_feature_sets": (j1, S(f""" SELECT "faultNumber", "simulationRun", {q('s', 3)} AS s, m FROM n WHERE n >= 12""")),
    "j2_common_runs": (j2, S(" SELECT config, split, run_id FROM ab WHERE n >= 12")),
    "j2_common_runs_many": (j2_many, """SELECT "faultNumber", "simulationRun", 'train' AS split FROM (
SELECT CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS "faultNumber", CAST(o_custkey AS INTEGER) AS "simulationRun",
 count(*) AS n, max(o_totalprice) AS m FROM orders GROUP BY 1, 2) WHERE n >= 2 AND m > 1000"""),
    "p11_align_features": (p11, with_views("feat", f"""SELECT r.run_id, CAST(w.place AS INTEGER) AS place, w.feature, {q('coalesce(f.value, 0.0)')} AS value
FROM (SELECT DISTINCT run_id FROM feat) r CROSS JOIN (VALUES ('f03',0),('f61',1),('f00',2),('f20',3)) w(feature, place)
LEFT JOIN (SELECT * FROM feat WHERE feature <= 'f20') f ON f.run_id=r.run_id AND f.feature=w.feature""")),
    "u2_intersect_runs": (u2, S(" SELECT split, run_id FROM n WHERE n >= 12")),
    "u3_missing_features": (u3, with_views("feat", """SELECT * FROM (VALUES ('f03',0),('f61',1),('f00',2),('f20',3),('f21',4)) t(feature, place)
WHERE feature NOT IN (SELECT feature FROM feat WHERE feature <= 'f20')""")),
    "u4_same_sets": (u4, with_views("feat", """WITH a AS (SELECT DISTINCT feature FROM feat WHERE feature < 'f40'),
b AS (SELECT DISTINCT feature FROM feat WHERE feature > 'f10'), oa AS (SELECT count(*) AS n FROM (FROM a EXCEPT FROM b)), ob AS (SELECT count(*) AS n FROM (FROM b EXCEPT FROM a))
SELECT oa.n AS only_a, ob.n AS only_b, oa.n = 0 AND ob.n = 0 AS equal FROM oa, ob""")),
    "j9_concat_configs_all": (j9_all, with_views("feat", f"SELECT run_id, CASE WHEN feature<'f32' THEN 'low__' ELSE 'high__' END || feature AS feature, {q('value')} AS value FROM feat")),
    "j9_concat_configs": (j9, with_views("feat", f"SELECT run_id, CASE WHEN feature<'f04' THEN 'low__' ELSE 'high__' END || feature AS feature, {q('value')} AS value FROM feat WHERE feature<'f04' OR feature>'f60'")),
}
