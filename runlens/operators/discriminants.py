"""Classifiers over class covariances: linear and quadratic discriminants.

Moments per class come from the moment aggregation of the spectra (partial matrices per task, merged in two levels); those of
folds subtract. The linear model pools the covariances (divisor: rows less classes), leaves out directions whose variance is below
1e-8 of their scale, and becomes one weight vector per class. The quadratic one whitens each class (divisor: rows less one;
smaller variances count as 1e-8 of their scale); a block of test rows meets one class per task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import unpack
from .baselines import FOLD, best_class, linear_score, shape_of, whole
from .moments import moments

FLOOR = 1e-8
KEYS = [FOLD, "label"]
MOMENTS = "fold int, label int, n bigint, mean array<double>, cov array<double>"
#: Test rows that meet a class in one task.
BLOCK = 4096


def class_moments(train: DataFrame, width: int) -> DataFrame:
    """Per fold and class: rows, mean vector and population covariance (packed upper triangle)."""
    rows = train.select(F.col(FOLD).cast("int").alias(FOLD), F.col("label").cast("int").alias("label"),
                        F.lit(0).cast("bigint").alias("t"), F.col("x").alias("z"))
    return moments(rows, width, keys=KEYS, native=False).select(*KEYS, "n", "mean", "cov")


def leave_out(folds: DataFrame, k: int, width: int) -> DataFrame:
    """Training moments of each of k folds: those of all rows less those of the fold. A task holds k matrices of one class."""
    upper = np.triu_indices(width)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = {f: (n, np.asarray(m), unpack(c, width)) for f, n, m, c in zip(group[FOLD], group["n"], group["mean"], group["cov"])}
        total = sum(n for n, _, _ in parts.values())
        mean = sum(n * m for n, m, _ in parts.values()) / total
        scatter = sum(n * (c + np.outer(m - mean, m - mean)) for n, m, c in parts.values())
        out = []
        for f in range(k):
            n, m, c = parts.get(f, (0, mean, np.zeros((width, width))))
            left = total - n
            if left:
                rest = (total * mean - n * m) / left
                cov = (scatter - n * (c + np.outer(m - mean, m - mean))) / left - np.outer(rest - mean, rest - mean)
                out.append((f, int(group["label"].iloc[0]), left, rest, cov[upper]))
        return pd.DataFrame(out, columns=["fold", "label", "n", "mean", "cov"])

    return folds.groupBy("label").applyInPandas(run, MOMENTS)


def eigen(cov: np.ndarray):
    """Scale of every feature, eigenvalues and vectors of the matrix in these scales."""
    scale = np.sqrt(np.diag(cov))
    scale = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    return scale, values, vectors


def linear_rows(table: DataFrame, width: int) -> DataFrame:
    """fold, label, pos, a (weight), b, const: the class with the smallest const + a.x is chosen. A task holds the matrices of one fold."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy(dtype=float)
        mean = np.stack([np.asarray(m, dtype=float) for m in group["mean"]])
        if n.sum() <= len(n):
            raise ValueError("linear discriminant: no more rows than classes")
        pooled = sum(c * unpack(v, width) for c, v in zip(n, group["cov"])) / (n.sum() - len(n))
        scale, values, vectors = eigen(pooled)
        kept = values > FLOOR
        white = vectors[:, kept] / np.sqrt(values[kept]) / scale[:, None]
        weights = mean @ white @ white.T
        const = (weights * mean).sum(1) - 2.0 * np.log(n / n.sum())
        return pd.concat([pd.DataFrame({"fold": f, "label": c, "pos": np.arange(width), "a": -2.0 * w, "b": 1.0,
                                        "const": np.where(np.arange(width) == 0, k, 0.0)})
                          for f, c, w, k in zip(group[FOLD], group["label"], weights, const)])

    return table.groupBy(FOLD).applyInPandas(run, "fold int, label int, pos int, a double, b double, const double")


def quadratic_rows(table: DataFrame, width: int) -> DataFrame:
    """fold, label, white (width x width, flat), centre, const: score = const + |white (x - centre)|^2."""
    total = table.groupBy(FOLD).agg(F.sum("n").alias("_n"))

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                if r.n < 2:
                    raise ValueError(f"quadratic discriminant: class {r.label} has one row only")
                scale, values, vectors = eigen(unpack(r.cov, width) * (r.n / (r.n - 1.0)))
                values = np.maximum(values, FLOOR)
                white = (vectors / np.sqrt(values) / scale[:, None]).T
                const = np.log(values).sum() + 2.0 * np.log(scale).sum() - 2.0 * np.log(r.n / r.total)
                out.append((r.fold, r.label, white.ravel(), np.asarray(r.mean), const))
            yield pd.DataFrame(out, columns=["fold", "label", "white", "centre", "const"])

    return table.join(F.broadcast(total.withColumnRenamed("_n", "total")), FOLD).mapInPandas(  # one row per fold
        run, "fold int, label int, white array<double>, centre array<double>, const double")


def quadratic_best(model: DataFrame, test: DataFrame, width: int) -> DataFrame:
    """Class of the smallest score of every test row (smallest label on ties): run_id, y_true, y_pred, fold."""
    blocks = max(1, -(-test.count() // BLOCK))
    classes = sorted(r["label"] for r in model.select("label").distinct().collect())
    spread = F.expr(f"pmod(xxhash64(run_id), {blocks})").cast("int")
    left = test.select("run_id", "label", FOLD, "x", spread.alias("block"), F.explode(F.lit(classes)).alias("cand"))
    # Names of its own for the model: both sides may come from one table.
    right = model.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(
        F.col(FOLD).alias("_fold"), F.col("label").alias("_cand"), "_block", "white", "centre", "const")

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"run_id": [], "label": [], "fold": [], "cand": [], "s": []})
        white = np.asarray(b["white"].iloc[0]).reshape(width, width)
        x = np.stack([np.asarray(v, dtype=float) for v in a["x"]]) - np.asarray(b["centre"].iloc[0])
        s = b["const"].iloc[0] + ((x @ white.T) ** 2).sum(1)
        return pd.DataFrame({"run_id": a["run_id"], "label": a["label"], "fold": a["fold"], "cand": a["cand"], "s": s})

    key = [FOLD, "cand", "block"]
    scores = left.groupBy(key).cogroup(right.groupBy(["_fold", "_cand", "_block"])).applyInPandas(
        score, "run_id bigint, label int, fold int, cand int, s double")
    return scores.groupBy("run_id", "label", FOLD).agg(F.min(F.struct("s", "cand")).alias("w")).select(
        "run_id", F.col("label").alias("y_true"), F.col("w.cand").alias("y_pred"), FOLD)


def _linear(table, test, shape, folds=1):
    return best_class(linear_rows(table, shape[0]), test, shape, linear_score, folds)


def _quadratic(table, test, shape, folds=1):
    return quadratic_best(quadratic_rows(table, shape[0]), test, shape[0])


@dataclass(frozen=True)
class CovarianceModel:
    """A classifier over class moments: ``best`` (training moments, test rows, numbers of features and classes, folds) -> predictions."""

    best: Callable

    def __call__(self, train: DataFrame, test: DataFrame) -> DataFrame:
        shape = shape_of(train)
        return self.best(class_moments(whole(train), shape[0]), whole(test), shape).drop(FOLD)

    def __repr__(self) -> str:
        return self.best.__name__

    def by_folds(self, folded: DataFrame, k: int) -> DataFrame:
        """Every fold predicted from the other ones; the rows are aggregated once."""
        shape = shape_of(folded)
        rows = folded.select("run_id", F.col("label").cast("int").alias("label"), "x", F.col(FOLD).cast("int").alias(FOLD))
        return self.best(leave_out(class_moments(rows, shape[0]), k, shape[0]), rows, shape, k)


linear_discriminant = CovarianceModel(_linear)
quadratic_discriminant = CovarianceModel(_quadratic)
