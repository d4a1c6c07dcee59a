"""Classifiers that are plain aggregations: majority, nearest centroid, Gaussian naive Bayes.

Tables have run_id, label, x (array of doubles). A model is a table of class rows, cut into chunks of features and joined to the
test rows by chunk: no model passes through the driver or the plan, and it is broadcast only if classes times features are few.
Everything comes from moments per class; moments of folds
subtract, so the training moments of all k folds cost one aggregation of the rows (``by_folds``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .neighbours import k_nearest
from .values import salted_join

#: Features of one chunk of a model.
CHUNK = 512
#: Numbers of a model that may be broadcast (32 MB); a larger one is joined by (chunk, salt).
BROADCAST_NUMBERS = 1 << 22
FOLD = "fold"


def class_cells(train: DataFrame) -> DataFrame:
    """Per fold, class and feature: rows, mean and population variance."""
    long = train.select(FOLD, "label", F.posexplode_outer("x").alias("pos", "v"))
    return long.groupBy(FOLD, "label", "pos").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s"))


def leave_out(cells: DataFrame, k: int) -> DataFrame:
    """Training cells of each of k folds: the moments of all rows less those of the fold."""
    zero = F.lit(0.0)
    per = cells.groupBy("label", "pos").agg(F.collect_list(F.struct(FOLD, "n", "m", "s")).alias("f"))  # k entries
    per = per.withColumn("_n", F.aggregate("f", F.lit(0).cast("bigint"), lambda a, e: a + e["n"]))
    per = per.withColumn("_m", F.aggregate("f", zero, lambda a, e: a + e["n"] * e["m"]) / F.col("_n"))

    def scatter(e):
        return e["n"] * (e["s"] + (e["m"] - F.col("_m")) * (e["m"] - F.col("_m")))

    per = per.withColumn("_s", F.aggregate("f", zero, lambda a, e: a + scatter(e)))
    each = per.withColumn(FOLD, F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # A class need not be in every fold: then nothing is taken away.
    own = F.get(F.filter("f", lambda e: e[FOLD] == F.col(FOLD)), F.lit(0))
    each = each.withColumn("e", F.coalesce(own, F.struct(F.col(FOLD), F.lit(0).cast("bigint").alias("n"), zero.alias("m"), zero.alias("s"))))
    each = each.withColumn("n", F.col("_n") - F.col("e.n")).where("n > 0")
    each = each.withColumn("m", (F.col("_n") * F.col("_m") - F.col("e.n") * F.col("e.m")) / F.col("n"))
    gap = F.col("m") - F.col("_m")
    rest = (F.col("_s") - scatter(F.col("e"))) / F.col("n") - gap * gap
    return each.select(FOLD, "label", "pos", "n", "m", F.greatest(rest, zero).alias("s"))


def centroid_rows(cells: DataFrame) -> DataFrame:
    """fold, label, pos, a, b and const: the score of a class is const + sum of (x - a)^2 / b."""
    return cells.select(FOLD, "label", "pos", F.col("m").alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("const"))


def bayes_rows(cells: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """Class priors and per-class normal densities; variances get a share of the largest one added."""
    per = W.partitionBy(FOLD, "pos")
    rows = cells.withColumn("_n", F.sum("n").over(per)).withColumn("_m", F.sum(F.col("n") * F.col("m")).over(per) / F.col("_n"))
    gap = F.col("m") - F.col("_m")
    rows = rows.withColumn("_s", F.sum(F.col("n") * (F.col("s") + gap * gap)).over(per) / F.col("_n"))
    largest = rows.groupBy(FOLD).agg((F.max("_s") * smoothing).alias("_e"))
    rows = rows.join(F.broadcast(largest), FOLD).withColumn("b", F.col("s") + F.col("_e"))  # one row per fold
    # ln(2 pi b) of a feature belongs to that feature, so chunks add up; the prior goes with the first one.
    prior = F.when(F.col("pos") == 0, -2.0 * F.log(F.col("n") / F.col("_n"))).otherwise(F.lit(0.0))
    return rows.select(FOLD, "label", "pos", F.col("m").alias("a"), "b", (F.log(2.0 * F.pi() * F.col("b")) + prior).alias("const"))


def square_score(x: str, row) -> Column:
    part = F.zip_with(F.zip_with(x, row["a"], lambda v, a: (v - a) * (v - a)), row["b"], lambda v, b: v / b)
    return row["const"] + F.aggregate(part, F.lit(0.0), lambda s, v: s + v)


def linear_score(x: str, row) -> Column:
    return row["const"] + F.aggregate(F.zip_with(x, row["a"], lambda v, a: v * a), F.lit(0.0), lambda s, v: s + v)


def best_class(rows: DataFrame, test: DataFrame, shape: tuple, score: Callable = square_score, folds: int = 1) -> DataFrame:
    """Class of the smallest score of every test row (smallest label on ties): run_id, y_true, y_pred, fold.

    ``shape`` has the numbers of features and classes: with the folds they bound the model."""
    width, classes_ = shape
    classes = rows.withColumn("chunk", F.expr(f"pos div {CHUNK}").cast("int")).groupBy(FOLD, "chunk", "label").agg(
        F.sort_array(F.collect_list(F.struct("pos", "a", "b"))).alias("c"), F.sum("const").alias("const"))
    model = classes.groupBy(FOLD, "chunk").agg(F.sort_array(F.collect_list(F.struct(
        "label", "const", F.col("c.a").alias("a"), F.col("c.b").alias("b")))).alias("classes"))
    chunks = max(1, -(-width // CHUNK))
    pieces = test.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).withColumn(
        "_x", F.slice("x", F.col("chunk") * CHUNK + 1, F.lit(CHUNK))).select("run_id", "label", FOLD, "chunk", "_x")
    small = 2 * width * classes_ * folds <= BROADCAST_NUMBERS
    both = pieces.join(F.broadcast(model), [FOLD, "chunk"]) if small else salted_join(pieces, model, [FOLD, "chunk"], F.col("run_id"))
    scored = both.withColumn("_s", F.transform("classes", lambda r: F.struct(score("_x", r).alias("s"), r["label"].alias("l"))))
    if chunks > 1:
        each = scored.select("run_id", "label", FOLD, F.explode("_s").alias("e"))
        total = each.groupBy("run_id", "label", FOLD, F.col("e.l").alias("l")).agg(F.sum("e.s").alias("s"))
        scored = total.groupBy("run_id", "label", FOLD).agg(F.collect_list(F.struct("s", "l")).alias("_s"))
    return scored.select("run_id", F.col("label").alias("y_true"), F.array_min("_s")["l"].cast("int").alias("y_pred"), FOLD)


def whole(df: DataFrame) -> DataFrame:
    """The rows as one fold."""
    return df.select("run_id", "label", "x", F.lit(0).alias(FOLD))


def shape_of(train: DataFrame) -> tuple:
    """Numbers of features and classes."""
    row = train.agg(F.max(F.size("x")).alias("w"), F.count_distinct("label").alias("c")).first()
    if row["w"] is None:
        raise ValueError("no training rows")
    return row["w"], row["c"]


@dataclass(frozen=True)
class CellModel:
    """A classifier whose class rows come from per-feature moments."""

    rows: Callable

    def __call__(self, train: DataFrame, test: DataFrame) -> DataFrame:
        return best_class(self.rows(class_cells(whole(train))), whole(test), shape_of(train)).drop(FOLD)

    def __repr__(self) -> str:
        return self.rows.__name__  # names stored results, so it must not change from process to process

    def by_folds(self, folded: DataFrame, k: int) -> DataFrame:
        """Every fold predicted from the other ones; the rows are aggregated once."""
        return best_class(self.rows(leave_out(class_cells(folded), k)), folded, shape_of(folded), folds=k)


nearest_centroid = CellModel(centroid_rows)
gaussian_nb = CellModel(bayes_rows)


class Majority:
    """Most frequent class of the training rows (smallest label on ties)."""

    def __call__(self, train: DataFrame, test: DataFrame) -> DataFrame:
        top = train.groupBy("label").count().orderBy(F.desc("count"), "label").first()
        return test.select("run_id", F.col("label").alias("y_true"), F.lit(top["label"]).cast("int").alias("y_pred"))

    def by_folds(self, folded: DataFrame, k: int) -> DataFrame:
        counts = folded.groupBy(FOLD, "label").count().collect()  # folds x classes rows
        total: dict = {}
        for r in counts:
            total[r["label"]] = total.get(r["label"], 0) + r["count"]
        held = {(r[FOLD], r["label"]): r["count"] for r in counts}
        top = [min(total, key=lambda c: (held.get((i, c), 0) - total[c], c)) for i in range(k)]
        return folded.select("run_id", F.col("label").alias("y_true"), F.lit(top)[F.col(FOLD)].cast("int").alias("y_pred"), FOLD)


majority_baseline = Majority()

__all__ = ["majority_baseline", "nearest_centroid", "gaussian_nb", "k_nearest", "class_cells", "leave_out", "best_class"]
