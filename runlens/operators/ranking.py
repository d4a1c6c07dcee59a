"""Scoring features by how well they separate the classes.

Input is long: run_id, label, feature, value. Work is keyed by (feature, value bin) or
(feature, class); only class- and feature-level tables are sorted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.special import fisher_p, normal_p
from ..session import cut_lineage
from .values import RANGE_ROWS, finite, ordered_counts, packed_values, quantiles, range_borders, salted_join, unplanes, value_counts

#: Features whose ends may be broadcast (a few numbers each); more are joined by shuffling.
BROADCAST_FEATURES = 1 << 16


def impute_range(long: DataFrame) -> DataFrame:
    """Per feature: +inf becomes the finite maximum, -inf the minimum, missing the median (0 if none).

    Only features with missing values are put in order: the others have no use for their median. Rows move only if very many
    features have something to fill in."""
    v, good = F.col("value"), F.when(finite("value"), F.col("value"))
    missing = v.isNull() | F.isnan(v)
    ends = cut_lineage(long.groupBy("feature").agg(F.min(good).alias("_min"), F.max(good).alias("_max"), F.count_if(missing).alias("_gaps"),
                                               F.count_if(missing | (F.abs(v) == float("inf"))).alias("_odd")))
    n = ends.agg(F.count_if(F.col("_gaps") > 0).alias("gaps"), F.count_if(F.col("_odd") > 0).alias("odd")).first()

    def meet(rows, side, how="inner"):
        return rows.join(F.broadcast(side), "feature", how) if n["odd"] <= BROADCAST_FEATURES else \
            salted_join(rows, side, ["feature"], F.col("run_id"), how)

    gappy = meet(long.where(finite("value")), ends.where("_gaps > 0").select("feature")) if n["gaps"] else long.where(F.lit(False))
    ordered = ordered_counts(value_counts(gappy, ["feature"]), ["feature"])
    middle = quantiles(ordered, ["feature"], [0.5]).select("feature", F.col("q")[0].alias("_med"))
    if not n["odd"]:
        return long.select("feature", *[c for c in long.columns if c != "feature"])
    rows = meet(long, ends.where("_odd > 0").drop("_gaps", "_odd").join(middle, "feature", "left"), "left")
    filled = (F.when(missing, F.col("_med")).when(v == float("inf"), F.col("_max"))
              .when(v == float("-inf"), F.col("_min")).otherwise(v))
    return rows.withColumn("value", F.coalesce(filled, F.lit(0.0))).drop("_min", "_max", "_med")


def varying_features(long: DataFrame) -> DataFrame:
    """Features with more than one value (minimum and maximum differ, so no rounding is involved)."""
    return long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi")) \
        .where("lo <> hi").select("feature")


def drop_constant_features(long: DataFrame) -> DataFrame:
    return salted_join(long, varying_features(long), ["feature"], F.col("run_id"))


def anova_f(long: DataFrame) -> DataFrame:
    """One-way F per feature from class counts, means and variances."""
    cells = long.groupBy("feature", "label").agg(F.count("value").alias("n"), F.avg("value").alias("m"),
                                                 F.var_pop("value").alias("s"))
    per = cells.groupBy("feature").agg(F.collect_list(F.struct("n", "m", "s")).alias("c"), F.sum("n").alias("N"),
                                       (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("M"))
    zero = F.lit(0.0)
    between = F.aggregate("c", zero, lambda a, e: a + e["n"] * (e["m"] - F.col("M")) * (e["m"] - F.col("M")))
    within = F.aggregate("c", zero, lambda a, e: a + e["n"] * e["s"])
    k = F.size("c")
    f = F.try_divide(F.try_divide(between, (k - 1).cast("double")), F.try_divide(within, (F.col("N") - k).cast("double")))
    return per.select("feature", F.coalesce(f, F.lit(0.0)).alias("f_value"))


def rank_sums(long: DataFrame, labels, most: int = RANGE_ROWS) -> DataFrame:
    """Per (feature, class): class size, rank sum with average ranks, tie term and number of values.

    Values move once, packed to some eight bytes each; a task orders one feature, or a range of at most about ``most`` of its
    values. Ranks start anew in every range: those of a class grow by the number of rows in earlier ranges."""
    labels = [int(v) for v in labels]
    k = len(labels)

    def order(group: pd.DataFrame) -> pd.DataFrame:
        key = np.concatenate([unplanes(b, np.int64) for b in group["keys"]])
        cls = np.concatenate([unplanes(b, np.int16) for b in group["classes"]])
        count = np.concatenate([unplanes(c, np.int64) if len(c) else np.ones(len(b) // 8, dtype=np.int64)
                                for b, c in zip(group["keys"], group["counts"])])
        at = np.argsort(key, kind="stable")
        key, cls, count = key[at], cls[at], count[at]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(starts, len(key)))
        n = np.add.reduceat(count, starts)
        rank = np.repeat(np.cumsum(n) - n + (n + 1) / 2.0, size)
        one, low = cls >= 0, (cls >= 0) & (np.arange(len(key)) < size[0])
        wide = n.astype(float)

        def whole(rows):
            return np.bincount(cls[rows], count[rows], k).astype(np.int64)

        return pd.DataFrame({"feature": [group["feature"].iloc[0]], "range": [group["range"].iloc[0]], "n": [n.sum()],
                             "ties": [(wide * wide * wide - wide).sum()], "values": [len(n)], "low": [n[0]], "n1": [whole(one)],
                             "r1": [np.bincount(cls[one], count[one] * rank[one], k)], "low1": [whole(low)]})

    packed = packed_values(long, labels, range_borders(long, most))
    kind = long.schema["feature"].dataType.simpleString()
    ranges = packed.groupBy("feature", "range").applyInPandas(
        order, f"feature {kind}, range int, n bigint, ties double, values bigint, low bigint, n1 array<bigint>, r1 array<double>, low1 array<bigint>")
    earlier = W.partitionBy("feature").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("_o", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sums = [F.struct(F.lit(v).alias("label"), F.sum(F.col("n1")[i]).alias("n1"), F.sum(F.col("r1")[i] + F.col("_o") * F.col("n1")[i]).alias("r1"),
                     F.min_by(F.col("low1")[i], "range").alias("low1")) for i, v in enumerate(labels)]
    per = ranges.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("ties").alias("ties"), F.sum("values").alias("values"),
                                        F.min_by("low", "range").alias("low"), F.array(*sums).alias("c"))
    return per.select("feature", "n", "ties", "values", "low", F.explode_outer("c").alias("c")).select(
        "feature", "n", "ties", "values", "low", "c.*").where("n1 > 0 and n1 < n")


def mann_whitney(sums: DataFrame) -> DataFrame:
    """U of the class against the rest and its normal deviate with tie and continuity correction."""
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n0 = n - n1
    var = n1 * n0 / 12.0 * ((n + 1.0) - F.col("ties") / (n * (n - 1.0)))
    rows = sums.withColumn("u", F.col("r1") - n1 * (n1 + 1.0) / 2.0)
    return rows.withColumn("z", F.try_divide(F.abs(F.col("u") - n1 * n0 / 2.0) - 0.5, F.sqrt(var)))


def class_p_values(long: DataFrame, labels) -> DataFrame:
    """One-vs-rest p per (feature, class): Mann-Whitney, Fisher's exact test for two-valued features."""
    rows = mann_whitney(rank_sums(long, labels)).where("values > 1")
    a, low, n1, n = F.col("low1"), F.col("low"), F.col("n1"), F.col("n")
    many = rows.where("values > 2").withColumn("p", normal_p("z"))
    two = rows.where("values = 2").withColumn("p", fisher_p(a, low - a, n1 - a, n - n1 - low + a))
    return many.unionByName(two).select("feature", "label", "u", "z", "p")


def fdr_correct(p_values: DataFrame, alpha: float = 0.05, dependent: bool = True, block: str | None = None) -> DataFrame:
    """Step-up false-discovery control within each class (and block of features).

    ``dependent=True`` is Benjamini-Yekutieli, else Benjamini-Hochberg. A window holds one class, i.e.
    as many rows as there are features.
    """
    part = ["label"] + ([block] if block else [])
    w = W.partitionBy(*part).orderBy("p", "feature")
    everything = W.partitionBy(*part)
    rows = p_values.withColumn("_k", F.row_number().over(w)).withColumn("_m", F.count(F.lit(1)).over(everything))
    c = F.sum(1.0 / F.col("_k")).over(everything) if dependent else F.lit(1.0)
    rows = rows.withColumn("_c", c)
    passed = F.col("p") <= F.col("_k") * F.lit(alpha) / (F.col("_m") * F.col("_c"))
    last = F.max(F.when(passed, F.col("_k"))).over(everything)
    return rows.withColumn("relevant", F.coalesce(F.col("_k") <= last, F.lit(False))).drop("_k", "_m", "_c")


def with_feature_block(p_values: DataFrame, block_cols: int) -> DataFrame:
    """Number features in name order and cut them into blocks of ``block_cols``."""
    names = p_values.select("feature").distinct()
    place = F.row_number().over(W.partitionBy(F.lit(1)).orderBy("feature")) - 1
    numbered = names.withColumn("block", (place / block_cols).cast("int"))
    return p_values.join(numbered, "feature")


def relevance_table(long: DataFrame, labels, alpha: float = 0.05, dependent: bool = True,
                    block_cols: int | None = None) -> DataFrame:
    """Per feature the number of classes it separates significantly and the smallest p."""
    p = class_p_values(long, labels)
    if block_cols:
        p = with_feature_block(p, block_cols)
    tested = fdr_correct(p, alpha, dependent, "block" if block_cols else None)
    return tested.groupBy("feature").agg(F.sum(F.col("relevant").cast("int")).alias("n_significant"),
                                         F.min("p").alias("p_min"))


def rank_features(long: DataFrame, labels, alpha: float = 0.05, dependent: bool = True,
                  block_cols: int | None = None, impute: bool = True) -> DataFrame:
    """Rank table: n_significant, then F, then name. Constant features drop out.

    The orderings behind medians and ranks are stored; the imputed values themselves are not, they are formed again for the F test.
    """
    rows = impute_range(long) if impute else long
    table = relevance_table(rows, labels, alpha, dependent, block_cols)
    joined = table.join(anova_f(rows), "feature", "left").withColumn("f_value", F.coalesce("f_value", F.lit(0.0)))
    return joined.orderBy(F.desc("n_significant"), F.desc("f_value"), "feature")


def top_k_features(rank: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """First k names (per config) with their place. A window holds one config's feature names."""
    part = [by] if by else [F.lit(1)]
    w = W.partitionBy(*part).orderBy(F.desc("n_significant"), F.desc("f_value"), "feature")
    return rank.withColumn("place", F.row_number().over(w) - 1).where(F.col("place") < k)
