"""Leaderboard views and class profiles. Leaderboards hold one row per (config, model)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAIN_MODEL = "RandomForestClassifier"


def best_per_config(summary: DataFrame) -> DataFrame:
    """Whole row with the highest test macro-F1 per config (selection on the test set)."""
    w = W.partitionBy("config").orderBy(F.desc_nulls_last("macro_f1"), "model")
    return summary.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def cv_best_per_config(summary: DataFrame) -> DataFrame:
    """Whole row with the highest cross-validation mean per config; empty when no row has one."""
    w = W.partitionBy("config").orderBy(F.desc("cv_mean"), "model")
    rows = summary.where("cv_mean is not null and not isnan(cv_mean)")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def in_order(df: DataFrame, order) -> DataFrame:
    """Sort by the position of the config in a given list."""
    return df.orderBy(F.array_position(F.lit(list(order)), F.col("config")))


def fixed_model_view(summary: DataFrame, order, model: str = MAIN_MODEL) -> DataFrame:
    rows = summary.where(F.col("model") == model)
    place = F.array_position(F.lit(list(order)), F.col("config")).cast("int")
    return rows.withColumn("place", place).orderBy("place")


def sort_leaderboard(summary: DataFrame) -> DataFrame:
    """By cross-validation mean, rows without one last."""
    return summary.orderBy(F.desc_nulls_last("cv_mean"), "config", "model")


def strongest_without_cv(summary: DataFrame, n: int = 3) -> DataFrame:
    return summary.where("cv_mean is null and balanced_acc is not null").orderBy(F.desc("balanced_acc"), "config", "model").limit(n)


def best_config(results: DataFrame) -> DataFrame:
    """The config with the highest macro-F1."""
    best = F.max(F.struct("macro_f1", "config")).alias("b")
    return results.agg(best).select("b.config", "b.macro_f1")


def cv_gap(summary: DataFrame) -> DataFrame:
    """Test score of the test-selected model minus that of the cv-selected one, per config."""
    best = best_per_config(summary).select("config", F.col("model").alias("best_model"), F.col("macro_f1").alias("best"))
    cv = cv_best_per_config(summary).select("config", F.col("model").alias("cv_model"), F.col("macro_f1").alias("cv"))
    return best.join(cv, "config").withColumn("gap", F.col("best") - F.col("cv"))


def aggregate_spectra(spectra: DataFrame, group: str = "faultNumber") -> DataFrame:
    """Mean and sample deviation of every spectrum value per class, long: (class, pos, mean, std)."""
    long = spectra.select(group, F.posexplode_outer("values").alias("pos", "v"))
    return long.groupBy(group, (F.col("pos") + 1).alias("pos")).agg(
        F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"))


def aggregate_wide(agg: DataFrame, prefix: str, width: int, group: str = "faultNumber") -> DataFrame:
    """The same with columns ``<prefix><i>_mean`` and ``<prefix><i>_std``."""
    wide = agg.groupBy(group).pivot("pos", list(range(1, width + 1))).agg(
        F.first("mean").alias("mean"), F.first("std").alias("std"))
    return wide.select(group, *[F.col(f"{i}_{s}").alias(f"{prefix}{i}_{s}")
                                for i in range(1, width + 1) for s in ("mean", "std")])


def coefficient_of_variation(agg: DataFrame) -> DataFrame:
    return agg.withColumn("cv", F.when(F.col("mean") > 0, F.col("std") / F.nullif("mean", F.lit(0.0))))


def reference_overlay(agg: DataFrame, k: int = 10, group: str = "faultNumber") -> DataFrame:
    """Every class next to class 0 for the first k components; the class-0 side has k rows."""
    ref = agg.where(F.col(group) == 0).select("pos", F.col("mean").alias("reference"))
    return agg.where(F.col("pos") <= k).join(F.broadcast(ref.where(F.col("pos") <= k)), "pos")
