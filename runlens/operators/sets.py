"""Combining feature sets and aligning runs and features between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEYS


def combine_feature_sets(tables: list, keys=KEYS) -> DataFrame:
    """Inner join on the run keys; value arrays are put one after another."""
    named = [t.select(*keys, F.col("values").alias(f"_v{i}")) for i, t in enumerate(tables)]
    joined = reduce(lambda a, b: a.join(b, list(keys), "inner"), named)
    return joined.select(*keys, F.concat(*[F.col(f"_v{i}") for i in range(len(tables))]).alias("values"))


def common_runs(table: DataFrame, n_configs: int) -> DataFrame:
    """Runs present in all configs, per split. ``table`` has config, split, run_id."""
    return table.groupBy("split", "run_id").agg(F.countDistinct("config").alias("k")) \
        .where(F.col("k") == n_configs).select("split", "run_id")


def restrict(table: DataFrame, runs: DataFrame) -> DataFrame:
    return table.join(runs, ["split", "run_id"], "left_semi")


def class_distribution(table: DataFrame, sets: list, group: str = "faultNumber") -> DataFrame:
    """Runs per class for every (set, split) and the loss against the first set."""
    columns = [f"{s}_{split}" for s in sets for split in ("train", "test")]
    counts = table.withColumn("col", F.concat_ws("_", "config", "split")).groupBy(group).pivot("col", columns).count()
    counts = counts.select(group, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in columns])
    losses = [(F.col(f"{sets[0]}_{split}") - F.col(f"{s}_{split}")).alias(f"loss_{s}_{split}")
              for split in ("train", "test") for s in sets[1:]]
    return counts.select("*", *losses)


def align_features(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted feature for every run, 0.0 where it was not produced.

    The runs are grouped with the features they have; missing names are added inside the row, so no
    runs x features product is built beforehand. ``wanted`` has (feature, place) and is top-K sized.
    """
    names = [r["feature"] for r in wanted.orderBy("place").select("feature").collect()]
    wanted_list = F.lit(names)
    per_run = long.withColumn("_keep", F.col("feature").isin(names)).groupBy("run_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_keep"), F.struct("feature", "value")))).alias("m"))
    return per_run.select("run_id", F.posexplode_outer(wanted_list).alias("place", "feature"), "m").select(
        "run_id", "place", "feature", F.coalesce(F.try_element_at("m", "feature"), F.lit(0.0)).alias("value"))


def missing_features(long: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested but not produced."""
    return wanted.join(long.select("feature").distinct(), "feature", "left_anti")


def same_sets(a: DataFrame, b: DataFrame, column: str = "feature") -> DataFrame:
    """One row: sizes of both differences and whether the sets are equal."""
    only_a = a.join(b, column, "left_anti").agg(F.count(F.lit(1)).alias("only_a"))
    only_b = b.join(a, column, "left_anti").agg(F.count(F.lit(1)).alias("only_b"))
    sides = only_a.select(F.lit(1).alias("k"), "only_a").join(only_b.select(F.lit(1).alias("k"), "only_b"), "k")
    return sides.select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))


def concat_configs(tables: dict) -> DataFrame:
    """Features of several configs side by side: names get the config as prefix."""
    parts = [t.select("run_id", F.concat_ws("__", F.lit(name), "feature").alias("feature"), "value")
             for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
