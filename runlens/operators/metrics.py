"""Scores of predictions, all derived from one pre-aggregated count per (true, predicted) pair.

``pred`` has columns config, y_true, y_pred. After the first ``groupBy`` every table here has at
most configs x labels x labels rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def label_array(labels) -> Column:
    return F.array(*[F.lit(int(v)) for v in labels])


def confusion_counts(pred: DataFrame, labels, by: str = "config") -> DataFrame:
    """Counts for every pair of the fixed label list, zero where nothing was predicted."""
    return on_all_pairs(pred.groupBy(by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n")), labels, by)


def on_all_pairs(counts: DataFrame, labels, by: str = "config") -> DataFrame:
    """The counts of (true, predicted) pairs on the whole square of labels; zeros are added up with the counts, nothing is joined."""
    labels = [int(v) for v in labels]
    spine = (counts.select(by).distinct()
             .select(by, F.explode_outer(label_array(labels)).alias("y_true"))
             .select(by, "y_true", F.explode_outer(label_array(labels)).alias("y_pred")))
    known = counts.where(F.col("y_true").isin(labels) & F.col("y_pred").isin(labels)).select(
        by, *[F.col(c).cast("int").alias(c) for c in ("y_true", "y_pred")], F.col("n").cast("bigint").alias("n"))
    return spine.withColumn("n", F.lit(0).cast("bigint")).unionByName(known).groupBy(by, "y_true", "y_pred").agg(F.sum("n").alias("n"))


def confusion_square(cm: DataFrame, labels, by: str = "config") -> DataFrame:
    """Square layout: one row per true class, one column per predicted class."""
    wide = cm.groupBy(by, "y_true").pivot("y_pred", list(labels)).agg(F.first("n"))
    return wide.select(by, "y_true", *[F.col(str(v)).alias(f"pred_{v}") for v in labels])


def normalize_rows(cm: DataFrame, by: str = "config") -> DataFrame:
    total = F.sum("n").over(W.partitionBy(by, "y_true"))
    return cm.withColumn("share", F.when(total > 0, F.col("n") / F.nullif(total, F.lit(0))).otherwise(0.0))


def _ratio(a, b) -> Column:
    return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))


def class_scores(cm: DataFrame, by: str = "config") -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    hits = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    none = F.lit(None).cast("bigint")
    sides = F.array(F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), hits.alias("tp"), none.alias("predicted")),
                    F.struct(F.col("y_pred").alias("label"), none.alias("support"), none.alias("tp"), F.col("n").alias("predicted")))
    sums = cm.select(by, F.explode_outer(sides).alias("e")).select(by, "e.*").groupBy(by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "tp", "predicted")])
    both = sums.where("label is not null and support is not null and predicted is not null")  # labels on both sides
    return (both.withColumn("precision", _ratio("tp", "predicted")).withColumn("recall", _ratio("tp", "support"))
            .withColumn("f1", F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("predicted"))
                                                      .cast("double")), F.lit(0.0))))


def balanced_accuracy(cm: DataFrame, by: str = "config") -> DataFrame:
    """Mean recall over the classes that occur in the truth."""
    return class_scores(cm, by).where("support > 0").groupBy(by).agg(F.avg("recall").alias("balanced_acc"))


def macro_f1(cm: DataFrame, by: str = "config") -> DataFrame:
    """Plain mean of F1 over the classes seen in truth or prediction."""
    return class_scores(cm, by).where("support + predicted > 0").groupBy(by).agg(F.avg("f1").alias("macro_f1"))


def scores(cm: DataFrame, by: str = "config") -> DataFrame:
    """Both headline scores in one pass over the class table."""
    recall = F.when(F.col("support") > 0, F.col("recall"))
    f1 = F.when(F.col("support") + F.col("predicted") > 0, F.col("f1"))
    return class_scores(cm, by).groupBy(by).agg(
        F.avg(recall).alias("balanced_acc"), F.avg(f1).alias("macro_f1"), F.sum("support").alias("n_test"))


def classification_report(cm: DataFrame, by: str = "config") -> DataFrame:
    """Class rows followed by accuracy, macro and weighted averages (column ``name``)."""
    per_class = class_scores(cm, by)
    rows = per_class.select(by, F.col("label").cast("string").alias("name"), "precision", "recall", "f1", "support")
    total = F.sum("support")
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.nullif(total, F.lit(0))).alias(c)
                for c in ("precision", "recall", "f1")]
    macro = per_class.groupBy(by).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], total.alias("support"))
    mean = per_class.groupBy(by).agg(*weighted, total.alias("support"))
    hit = F.try_divide(F.sum("tp").cast("double"), total.cast("double"))
    acc = per_class.groupBy(by).agg(hit.alias("precision"), hit.alias("recall"), hit.alias("f1"), total.alias("support"))
    cols = [by, "name", "precision", "recall", "f1", "support"]
    for part, name in ((acc, "accuracy"), (macro, "macro avg"), (mean, "weighted avg")):
        rows = rows.unionByName(part.withColumn("name", F.lit(name)).select(*cols))
    return rows


def recall_table(cm: DataFrame, labels, by: str = "config") -> DataFrame:
    """Configs by classes: the diagonal of the row-normalised matrix."""
    diagonal = normalize_rows(cm, by).where("y_true = y_pred")
    wide = diagonal.groupBy(by).pivot("y_true", list(labels)).agg(F.first("share"))
    return wide.select(by, *[F.col(str(v)).alias(f"recall_{v}") for v in labels])


def hardest_classes(cm: DataFrame, n: int, by: str = "config") -> DataFrame:
    """Classes of lowest recall, averaged over the configs."""
    diagonal = normalize_rows(cm, by).where("y_true = y_pred")
    return diagonal.groupBy(F.col("y_true").alias("label")).agg(F.avg("share").alias("recall")) \
        .orderBy("recall", "label").limit(n)


def top_confusions(cm: DataFrame, n: int = 8, by: str = "config") -> DataFrame:
    """Largest off-diagonal cells per config with their share of the true class."""
    w = W.partitionBy(by).orderBy(F.desc("n"), "y_true", "y_pred")
    wrong = normalize_rows(cm, by).where("y_true <> y_pred and n > 0")
    return wrong.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def reconcile(results: DataFrame, summary: DataFrame, model: str) -> DataFrame:
    """Macro-F1 of two code paths side by side, largest difference marked."""
    stored = summary.where(F.col("model") == model).select("config", F.col("macro_f1").alias("stored"))
    diff = results.select("config", "macro_f1").join(stored, "config").withColumn(
        "diff", F.abs(F.col("macro_f1") - F.col("stored")))
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("diff"), "config")
    return diff.withColumn("largest", F.row_number().over(w) == 1)
