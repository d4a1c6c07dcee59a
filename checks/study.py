"""Stored results, models and the complete studies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from runlens.operators import baselines, metrics, models, prep, reports
from runlens.plans import characterise as ch
from runlens.plans.study import Study
from runlens.schema import Learning, PipelineConfig, Ranking, SpectrumConfig, Window
from runlens.session import checkpoint_dir
from runlens.sources import store

from .scores import BOARD_SQL, V
from .spectra import CUT, K, SHARES
from .views import feature_long, q, rnd, run_values, runs, vectors, with_views

LABELS = list(range(10))
KEYS = ["faultNumber", "simulationRun"]


def fresh(spark) -> str:
    return f"{checkpoint_dir(spark)}/runlens-{uuid.uuid4().hex}"


def pca_cfg(**kw):
    return SpectrumConfig("pca", window=Window(21), **kw)


def two(spark, sf):
    return runs(spark, sf, two=True).drop("t")


def io5_io6(spark, sf):
    base = fresh(spark)
    per_run, _ = ch.characterise(two(spark, sf), pca_cfg(), 2, dense=True)
    store.write_spectra(per_run, base, pca_cfg(), "train")
    back = store.read_spectra(spark, base, pca_cfg(), "train")
    return back.select(*KEYS, rnd(F.col("values")[0]).alias("v1"))


def io5_csv(spark, sf):
    per_run, _ = ch.characterise(two(spark, sf), pca_cfg(), 2, dense=True)
    path = store.export_spectra(per_run, fresh(spark), pca_cfg(), "train", 2)
    back = spark.read.option("header", True).csv(path)
    return back.select(*[F.col(k).cast("int").alias(k) for k in KEYS],
                       *[rnd(F.col(f"lambda_{i}").cast("double")).alias(f"lambda_{i}") for i in (1, 2)])


def io7(spark, sf):
    base = fresh(spark)

    def build():
        return ch.characterise(two(spark, sf), pca_cfg(), 2, dense=True)[1]

    store.materialise(spark, base, "classes", pca_cfg(), build)
    again = store.materialise(spark, base, "classes", pca_cfg(), lambda: (_ for _ in ()).throw(RuntimeError("recomputed")))
    return again.select("faultNumber", "pos", rnd("mean").alias("mean"))


def io8(spark, sf):
    base = fresh(spark)
    rows = runs(spark, sf)

    def build(part):
        return part.groupBy(*KEYS).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x")[0]), 2).alias("total"))

    return store.extract_resumable(spark, rows, base, build, buckets=4, per_wave=2).select(*KEYS, "n", "total")


def matrix(spark, sf):
    m = models.feature_matrix(feature_long(spark, sf), [f"f{i:02d}" for i in range(64)])
    return m.where("split = 'train'"), m.where("split = 'test'")


def m1(spark, sf):
    tr, te = matrix(spark, sf)
    both = tr.unionByName(te)
    return both.select("run_id", "label", "split", *[rnd(F.col("x")[i]).alias(f"x{i}") for i in range(64)])


def m2(spark, sf):
    tr, te = matrix(spark, sf)
    return models.random_forest(tr, te, trees=20)


def m3(spark, sf):
    tr, te = matrix(spark, sf)
    names = ["DecisionTreeClassifier", "LogisticRegression", "GaussianNB", "NearestCentroid", "MajorityClassifier"]
    return models.compare_models(tr, te, LABELS, "all", names, cv_folds=0)[1]


def m7_fold(spark, sf):
    v = vectors(spark, sf).where("split = 'train'")
    return models.fold_column(v.select("run_id", "label"), 5, block=64)


def m7_cv(spark, sf):
    """Test scores and cross-validation over three folds; models without class probabilities have none."""
    v = vectors(spark, sf)
    tr, te = v.where("split = 'train'"), v.where("split = 'test'")
    board = models.compare_models(tr, te, LABELS, "all", ["NearestCentroid", "GaussianMoments"], cv_folds=3)[1]
    return reports.sort_leaderboard(board).select("config", "model", "status", *[rnd(c).alias(c) for c in (
        "balanced_acc", "macro_f1", "cv_mean", "cv_std")])


def characterise_cva(spark, sf):
    cfg = SpectrumConfig("cva", window=Window(21), scaling_mode="scaler")
    _, agg = ch.characterise(runs(spark, sf).drop("t"), cfg, 4, prep.fit_scaler(run_values(spark, sf)), dense=True)
    return agg


def classify_spectra(spark, sf):
    """Train spectra stored, test spectra computed on demand, both sets combined, forest confusion counts."""
    base = fresh(spark)
    cfgs = [pca_cfg(), SpectrumConfig("cva", window=Window(21))]
    df = runs(spark, sf).drop("t")
    train, test = df.where("simulationRun % 5 <> 0"), df.where("simulationRun % 5 = 0")
    for c in cfgs:
        store.write_spectra(ch.characterise(train, c, 4, dense=True)[0], base, c, "train")
    pairs = ch.combine(ch.spectra_sets(spark, base, cfgs, lambda: test, 4, Window(21), dense=True))
    board, cm = ch.classify_spectra(pairs, [0, 1, 2], ["NearestCentroid", "LogisticRegression"], cv_folds=0, trees=10)
    return metrics.scores(cm).join(board.groupBy("config").agg(F.max("macro_f1").alias("best_macro_f1")), "config")


def study(spark, sf, configs=(("raw",), ("pca", 2)), top_k=6):
    df = runs(spark, sf).drop("t")
    parts = {"train": df.where("simulationRun % 5 <> 0"), "test": df.where("simulationRun % 5 = 0")}
    cfg = PipelineConfig(configs, run_length=None, feature_set="minimal", ranking=Ranking(top_k=top_k), learning=Learning(folds=0), labels=(0, 1, 2))
    return Study(spark, cfg, lambda s: parts[s], fresh(spark), ["q", "p", "d", "x"], {"train": 21, "test": 21}, buckets=4, per_wave=2)


def m9(spark, sf):
    cm, scores = study(spark, sf, (("raw",),)).confusion(trees=10)
    return scores


def m10(spark, sf):
    s = study(spark, sf)
    return s.compare(["RandomForestClassifier", "NearestCentroid", "GaussianMoments"], trees=10)["best_per_config"]


def io9(spark, sf):
    s = study(spark, sf, (("raw",),))
    return s.summary(["NearestCentroid", "MajorityClassifier"])


def m9_centroid(spark, sf):
    """Features of all runs, ranking (all 40 kept), predictions and confusion counts of the centroid model."""
    cm, scores = study(spark, sf, (("raw",),), 40).confusion(estimator=baselines.nearest_centroid)
    return cm.join(scores, "config").select("config", "y_true", "y_pred", "n", rnd("balanced_acc").alias("balanced_acc"),
                                            rnd("macro_f1").alias("macro_f1"), "n_features", "n_train")


def io9_centroid(spark, sf):
    board = study(spark, sf, (("raw",),), 40).summary(["NearestCentroid", "MajorityClassifier"])
    return board.select("config", "model", "status", rnd("balanced_acc").alias("balanced_acc"), rnd("macro_f1").alias("macro_f1"))


def m10_centroid(spark, sf):
    views = study(spark, sf, (("raw",),), 40).compare(["NearestCentroid", "MajorityClassifier"])
    best = views["best_per_config"]
    return best.select("config", "model", rnd("balanced_acc").alias("balanced_acc"), rnd("macro_f1").alias("macro_f1"))


def io8_pruned(spark, sf):
    """Rows stored by run bucket: a wave reads the folders of its buckets, and every run is in one of them."""
    path = f"{fresh(spark)}/_rows"
    rows = runs(spark, sf).withColumn("run_bucket", store.run_bucket(4))
    rows.write.partitionBy("run_bucket").parquet(path)
    first, second = (store.wave_rows(spark, path, w).groupBy(*KEYS).agg(F.count("*").alias("n")) for w in ([0, 2], [1, 3]))
    return first.unionByName(second)


# Raw channels less the run's mean, ten plain statistics each, class means of the training runs, nearest class of the others.
STATS10 = ["sum(v)", "quantile_cont(v, 0.5)", "avg(v)", "count(*)", "stddev_pop(v)", "var_pop(v)", "sqrt(avg(v*v))", "max(v)", "max(abs(v))", "min(v)"]
STUDY = f"""ct AS (SELECT * FROM runs4 WHERE sample >= 21), me AS (SELECT {K}, avg((x0+x1+x2+x3)/4) AS m FROM ct GROUP BY 1,2),
lo AS ({" UNION ALL ".join(f"SELECT {K}, {c} AS ch, x{c} - m AS v FROM ct JOIN me USING ({K})" for c in range(4))}),
st AS (SELECT {K}, ch, {", ".join(f"CAST({e} AS DOUBLE) AS s{i}" for i, e in enumerate(STATS10))} FROM lo GROUP BY 1,2,3),
fe AS ({" UNION ALL ".join(f'SELECT "faultNumber" AS y, "simulationRun" AS r, ch*10+{i} AS p, s{i} AS v FROM st' for i in range(10))}),
ce AS (SELECT y AS cand, p, avg(v) AS m FROM fe WHERE r % 5 <> 0 GROUP BY 1,2),
di AS (SELECT y, r, cand, sum((v-m)*(v-m)) AS d FROM fe JOIN ce USING (p) WHERE r % 5 = 0 GROUP BY 1,2,3),
ma AS (SELECT y AS top, count(*) AS n FROM fe WHERE p = 0 AND r % 5 <> 0 GROUP BY 1 ORDER BY n DESC, top LIMIT 1),
pr AS (SELECT 'NearestCentroid' AS model, y, r, cand AS g FROM (SELECT *, row_number() OVER (PARTITION BY y, r ORDER BY d, cand) AS w FROM di) WHERE w = 1
 UNION ALL SELECT 'MajorityClassifier', y, r, top FROM fe JOIN ma ON true WHERE p = 0 AND r % 5 = 0),
la AS (SELECT CAST(unnest(range(3)) AS INTEGER) AS l), mo AS (SELECT DISTINCT model FROM pr),
cl AS (SELECT mo.model, l, count(CASE WHEN y=l THEN 1 END) AS sup, count(CASE WHEN g=l THEN 1 END) AS gu, count(CASE WHEN y=l AND g=l THEN 1 END) AS tp
 FROM mo JOIN la ON true JOIN pr ON pr.model=mo.model GROUP BY 1,2),
sc AS (SELECT model, avg(CASE WHEN sup>0 THEN tp/sup END) AS b, avg(CASE WHEN sup+gu>0 THEN 2.0*tp/(sup+gu) END) AS f FROM cl GROUP BY 1)"""

R2 = "runs2"
QUERIES = {
    "io5_io6_spectra_store": (io5_io6, with_views(R2, f"WITH {SHARES} SELECT {K}, {q('v1')} AS v1 FROM sh")),
    "io5_spectra_csv_export": (io5_csv, with_views(R2, f"WITH {SHARES} SELECT {K}, {q('v1')} AS lambda_1, {q('v2')} AS lambda_2 FROM sh")),
    "io7_materialise": (io7, with_views(R2, f'WITH {SHARES} SELECT "faultNumber", pos, {q("avg(v)")} AS mean FROM shl GROUP BY 1,2')),
    "io8_resumable": (io8, with_views("runs4", f"SELECT {K}, count(*) AS n, round(sum(x0),2) AS total FROM runs4 GROUP BY 1,2")),
    "io9_write_summary": (io9, None),
    "m1_feature_matrix": (m1, with_views("feat", f"SELECT run_id, label, split, " + ", ".join(
        f"{q(f'''sum(CASE WHEN feature='f{i:02d}' THEN value END)''')} AS x{i}" for i in range(64)) + " FROM feat GROUP BY 1,2,3")),
    "m2_random_forest": (m2, None),
    "m3_compare_models": (m3, None),
    "m7_fold_column": (m7_fold, with_views("vec", "SELECT run_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY run_id) - 1) % 5 AS INTEGER) AS fold FROM vec WHERE split='train'")),
    "m7_cross_validate": (m7_cv, V(BOARD_SQL + f""" SELECT config, CASE model WHEN 'bayes' THEN 'GaussianMoments' ELSE 'NearestCentroid' END AS model, 'ok' AS status,
 {q('balanced_acc')} AS balanced_acc, {q('macro_f1')} AS macro_f1, {q("CASE WHEN model='bayes' THEN cv_mean END")} AS cv_mean,
 {q("CASE WHEN model='bayes' THEN cv_std END")} AS cv_std FROM board WHERE config='all' AND model<>'majority'""")),
    "m9_confusion": (m9, None),
    "m9_confusion_centroid": (m9_centroid, with_views("runs4", f"""WITH {STUDY}
SELECT 'raw' AS config, a.l AS y_true, c.l AS y_pred, count(pr.y) AS n, any_value({q('b')}) AS balanced_acc, any_value({q('f')}) AS macro_f1,
 CAST(40 AS INTEGER) AS n_features, any_value((SELECT count(*) FROM fe WHERE p = 0 AND r % 5 <> 0)) AS n_train
FROM la a JOIN la c ON true JOIN sc ON model='NearestCentroid' LEFT JOIN pr ON pr.model='NearestCentroid' AND pr.y=a.l AND pr.g=c.l GROUP BY 2, 3""")),
    "io9_summary_centroid": (io9_centroid, with_views("runs4", f"""WITH {STUDY} SELECT 'raw' AS config, model, 'ok' AS status, {q('b')} AS balanced_acc, {q('f')} AS macro_f1 FROM sc""")),
    "m10_study_centroid": (m10_centroid, with_views("runs4", f"""WITH {STUDY} SELECT 'raw' AS config, model, {q('b')} AS balanced_acc, {q('f')} AS macro_f1 FROM sc ORDER BY f DESC, model LIMIT 1""")),
    "io8_stored_buckets": (io8_pruned, with_views("runs4", f"SELECT {K}, count(*) AS n FROM runs4 GROUP BY 1,2")),
    "m10_study": (m10, None),
    "plan_characterise_cva": (characterise_cva, None),
    "plan_classify_spectra": (classify_spectra, None),
}
