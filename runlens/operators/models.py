"""Feature matrices, the model zoo on pyspark.ml, deterministic cross-validation, leaderboard rows."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, FMClassifier, GBTClassifier, LinearSVC,
                                       LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage, side_by_side
from . import baselines, discriminants, forest, metrics
from .prep import nan_to_zero
from .windows import with_position

MAIN_MODEL = "RandomForestClassifier"
#: Deep trees are not sent to the tasks with every pass: each row keeps the number of its node (checkpointed). The trees are the same.
DEEP = {"cacheNodeIds": True}
#: Training rows of trees that pyspark.ml grows: it keeps all nodes in the driver, and grown trees have nearly as many as rows.
#: Beyond, ``forest`` grows them in the tasks.
DRIVER_ROWS = 1 << 14
TREES = (RandomForestClassifier, DecisionTreeClassifier)


def feature_matrix(long: DataFrame, names: list, keep=("run_id", "label", "split")) -> DataFrame:
    """Top-K features of each run as one array in the order of ``names``; missing or infinite → 0."""
    wanted = long.where(F.col("feature").isin(list(names)))
    wide = wanted.groupBy(*keep).pivot("feature", list(names)).agg(F.first("value"))
    cols = [nan_to_zero(F.coalesce(F.col(f"`{n}`"), F.lit(0.0))) for n in names]
    return wide.select(*keep, F.array(*cols).alias("x"))


def with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", array_to_vector(F.col("x"))).withColumn("target", F.col("label").cast("double"))


def zoo(width: int, classes: int, seed: int = 42, trees: int = 100, depth: int = 30) -> dict:
    """Estimators by name. Binary learners are wrapped one-vs-rest."""
    io = {"featuresCol": "features", "labelCol": "target"}

    def rest(estimator):
        return OneVsRest(classifier=estimator, featuresCol="features", labelCol="target", parallelism=4)

    return {
        MAIN_MODEL: RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, **DEEP, **io),
        "DecisionTreeClassifier": DecisionTreeClassifier(maxDepth=depth, seed=seed, **DEEP, **io),
        "LogisticRegression": LogisticRegression(maxIter=100, regParam=1e-3, **io),
        "GaussianNB": NaiveBayes(modelType="gaussian", **io),
        "MLPClassifier": MultilayerPerceptronClassifier(layers=[width, 2 * width, classes], seed=seed, maxIter=100, **io),
        "LinearSVC": rest(LinearSVC(maxIter=50, **io)),
        "GBTClassifier": rest(GBTClassifier(maxIter=20, seed=seed, **io)),
        "FMClassifier": rest(FMClassifier(seed=seed, maxIter=50, **io)),
    }


PLAIN_MODELS = {"MajorityClassifier": baselines.majority_baseline, "NearestCentroid": baselines.nearest_centroid,
                "GaussianMoments": baselines.gaussian_nb, "KNeighborsClassifier": baselines.k_nearest,
                "LinearDiscriminantAnalysis": discriminants.linear_discriminant,
                "QuadraticDiscriminantAnalysis": discriminants.quadratic_discriminant}
# Models that give class probabilities; the others get no cross-validation figures.
WITH_PROBABILITY = {MAIN_MODEL, "DecisionTreeClassifier", "LogisticRegression", "GaussianNB", "MLPClassifier",
                    "MajorityClassifier", "GaussianMoments", "KNeighborsClassifier", "LinearDiscriminantAnalysis",
                    "QuadraticDiscriminantAnalysis"}


def fit_predict(train: DataFrame, test: DataFrame, estimator) -> DataFrame:
    """Standard scaling and the estimator, fitted on all training rows: run_id, y_true, y_pred."""
    if callable(estimator):
        return estimator(train, test)
    checkpoint_dir(train.sparkSession)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True)
    if isinstance(estimator, TREES) and train.count() > DRIVER_ROWS:
        how = forest.Grown(estimator.getNumTrees() if isinstance(estimator, TREES[0]) else 1, estimator.getMaxDepth(),
                           estimator.getMaxBins(), estimator.getMinInstancesPerNode(), estimator.getSeed())
        train = cut_lineage(train.select("label", "x"))  # read by the scaler, the borders and the bins
        scaled = scaler.fit(with_vector(train))
        return forest.grow_and_predict(scaled.transform(with_vector(train)), scaled.transform(with_vector(test)), how)
    model = Pipeline(stages=[scaler, estimator]).fit(with_vector(train))
    return model.transform(with_vector(test)).select(
        "run_id", F.col("label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def random_forest(train: DataFrame, test: DataFrame, seed: int = 42, trees: int = 100, depth: int = 30) -> DataFrame:
    """The fixed model of the main comparison."""
    return fit_predict(train, test, RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="features",
                                                           labelCol="target", **DEEP))


def fold_column(df: DataFrame, k: int, block: int = 65536) -> DataFrame:
    """Stratified folds: position within the class by run_id, modulo k; classes of any size."""
    placed = with_position(df, ["label"], ["run_id"], F.expr(f"run_id div {block}"), name="_pos")
    return placed.withColumn("fold", F.expr(f"cast(_pos % {k} as int)")).drop("_pos")


def cross_validate(folded: DataFrame, estimator, k: int, labels) -> tuple:
    """Mean and population deviation of balanced accuracy over the k folds of ``folded`` (rows with their fold)."""
    if not k:
        return None, None
    row = fold_scores(folded, estimator, k, labels).agg(F.avg("balanced_acc").alias("m"),
                                                        F.stddev_pop("balanced_acc").alias("s")).first()
    return row["m"], row["s"]


def fold_scores(folded: DataFrame, estimator, k: int, labels) -> DataFrame:
    """Balanced accuracy of every fold (config fold0..), each predicted by a model of the other folds.

    Models made of moments take those of all rows less those of the fold, so the rows are read once for all folds; other
    models are fitted k times."""
    if hasattr(estimator, "by_folds"):
        got = estimator.by_folds(folded, k)
        pred = got.select("run_id", "y_true", "y_pred", F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("config"))
    else:
        parts = []
        for i in range(k):
            one = fit_predict(folded.where(F.col("fold") != i), folded.where(F.col("fold") == i), estimator)
            parts.append(one.withColumn("config", F.lit(f"fold{i}")))
        pred = reduce(DataFrame.unionByName, parts)
    return metrics.balanced_accuracy(metrics.confusion_counts(pred, labels))


def compare_models(train: DataFrame, test: DataFrame, labels, config: str, models=None, cv_folds: int = 5,
                   seed: int = 42, trees: int = 100, depth: int = 30) -> tuple:
    """(predictions, summary) of several models on one feature set.

    ``models`` lists names of the zoo and of PLAIN_MODELS. A model whose fit fails, or that leaves predictions out, has a
    summary row with its status, the error text and no scores. Folds only ever see training rows. Predictions are
    stored before the cached inputs go, so the summary does not fit or pivot anything again. Models are fitted side by side.
    """
    train, test = train.cache(), test.cache()
    width = len(train.select("x").first()["x"])
    table = {**zoo(width, max(labels) + 1, seed, trees, depth), **PLAIN_MODELS}
    folded = fold_column(train, cv_folds).cache() if cv_folds else None
    preds, cv_rows, failed = [], [], []

    def one(name):
        try:
            got = cut_lineage(fit_predict(train, test, table[name]))
            return got, cross_validate(folded, table[name], cv_folds if name in WITH_PROBABILITY else 0, labels)
        except Exception as exc:  # a model that cannot be fitted is a row of the summary
            return exc

    try:
        names = models or list(table)
        for name, result in zip(names, side_by_side(train.sparkSession, one, names)):
            if isinstance(result, Exception):
                failed.append((config, name, "failed", f"{type(result).__name__}: {str(result)[:500]}"))
                continue
            got, scores = result
            preds.append(got.withColumns({"config": F.lit(config), "model": F.lit(name)}))
            cv_rows.append((name, *scores))
    finally:
        for df in (train, test, folded):
            if df is not None:
                df.unpersist()
    if not preds:
        raise RuntimeError(f"no model could be fitted for {config!r}")
    pred = reduce(DataFrame.unionByName, preds)
    cv = train.sparkSession.createDataFrame(cv_rows, "model string, cv_mean double, cv_std double")
    board = summary_rows(pred, cv, labels)
    lost = train.sparkSession.createDataFrame(failed, "config string, model string, status string, error string")
    return pred, board.unionByName(lost, allowMissingColumns=True)


def summary_rows(pred: DataFrame, cv: DataFrame, labels) -> DataFrame:
    """One leaderboard row per config and model: scores, cross-validation, status and error. A model with a missing
    prediction has the status ``incomplete`` and no scores.

    The predictions are read once: their counts per config, model and pair of labels are stored, and all else comes from these."""
    counts = cut_lineage(pred.groupBy("config", "model", "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")))
    gaps = counts.groupBy("config", "model").agg(F.sum(F.when(F.col("y_pred").isNull(), F.col("n")).otherwise(0)).alias("gaps"))
    complete, rest = gaps.where("gaps = 0"), gaps.where("gaps > 0")
    tagged = counts.join(F.broadcast(complete.select("config", "model")), ["config", "model"], "left_semi") \
        .select(F.concat_ws("\t", "config", "model").alias("key"), "y_true", "y_pred", "n")
    scored = metrics.scores(metrics.on_all_pairs(tagged, labels, by="key"), by="key")
    parts = F.split("key", "\t")
    by = [c for c in ("config", "model") if c in cv.columns]
    good = scored.select(parts[0].alias("config"), parts[1].alias("model"), "balanced_acc", "macro_f1").join(cv, by) \
        .select("config", "model", "balanced_acc", "macro_f1", "cv_mean", "cv_std", F.lit("ok").alias("status"),
                F.lit(None).cast("string").alias("error"))
    bad = rest.select("config", "model", F.lit("incomplete").alias("status"),
                      F.concat(F.col("gaps").cast("string"), F.lit(" predictions are missing")).alias("error"))
    return good.unionByName(bad, allowMissingColumns=True)


__all__ = ["feature_matrix", "zoo", "fit_predict", "random_forest", "fold_column", "cross_validate", "compare_models",
           "summary_rows"]
