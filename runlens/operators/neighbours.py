"""Exact k nearest training rows by metric partitions.

Training rows are placed in cells around pivots (a bounded sample of them); a cell knows its radius and number of rows. A test row
first asks the cells nearest to it that hold k rows; the kth distance found there bounds the second round, which asks every
other cell whose ball reaches into that distance (triangle inequality). What meets in a task are packs of neighbouring cells and blocks
of test rows: a test row is copied once per pack with a cell that it asks for, a pack once per block with such a row. Packs and blocks
are as large as a task may hold or as keeps all cores busy, so that copies stay few where nearly all pairs have to be compared. Of
a pack, only rows within the bound come back, k per test row at most.

Rows with equal vectors stand at one distance, so only the k of smallest id of each vector can be chosen: that many are kept,
exactly, before anything is placed (Spark limits them before the shuffle), and a vector that makes up a third of all rows
fills no cell. Ties in distance go to the smaller id, and every row at the kth distance takes part in that decision.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most cells; pivots, radii and sizes of this many cells travel with the tasks.
PIVOTS = 4096
#: Test rows whose distances to a pack are held at once, and most of these distances.
AT_ONCE, HELD = 256, 1 << 21
#: Most values of the rows of a pack or a block (8 MB), and pairs of them per core.
VALUES, PER_CORE = 1 << 20, 4
FOUND = "run_id bigint, near bigint, dist double, label int"


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a and b, up to rounding."""
    return (a ** 2).sum(1)[:, None] - 2.0 * a @ b.T + (b ** 2).sum(1)[None, :]


def slack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound of the rounding error of ``squared`` per row of a."""
    return 1e-13 * (a.shape[1] + 4) * ((a ** 2).sum(1) + (b ** 2).sum(1).max(initial=0.0))


def nearest_in_tile(xa: np.ndarray, xb: np.ndarray, ids: np.ndarray, k: int, limit: np.ndarray | None = None):
    """Per row of xa: places of the k nearest rows of xb and their squared distances, ties by id; ``limit`` bounds the squared distance
    of every row of xa, and what lies beyond may be left out."""
    kth = min(k, len(xb)) - 1
    step = max(1, min(AT_ONCE, HELD // len(xb)))
    for lo in range(0, len(xa), step):
        part = xa[lo:lo + step]
        d = squared(part, xb)
        # Whatever rounding may hide: all rows up to the kth distance and a margin, then exact distances.
        margin = 2.0 * slack(part, xb)
        reach = (np.partition(d, kth, axis=1)[:, kth] if limit is None else limit[lo:lo + step]) + margin
        for i, row in enumerate(d):
            pick = np.flatnonzero(row <= reach[i])
            if len(pick) > 4 * k:
                near = row[pick]
                pick = pick[near <= np.partition(near, k - 1)[k - 1] + margin[i]]
            exact = ((xb[pick] - part[i]) ** 2).sum(1)
            order = np.lexsort((ids[pick], exact))[:k]
            yield lo + i, pick[order], exact[order]


class Cells:
    """Pivots, and per cell the number of rows and the largest distance from its pivot."""

    def __init__(self, pivots: np.ndarray, sizes=None, radii=None):
        self.pivots, self.sizes, self.radii = pivots, sizes, radii

    def place(self, x: np.ndarray):
        """Nearest pivot of every row and the distance from it."""
        cell = np.concatenate([squared(x[lo:lo + AT_ONCE], self.pivots).argmin(1) for lo in range(0, len(x), AT_ONCE)])
        return cell, np.sqrt(((x - self.pivots[cell]) ** 2).sum(1))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.pivots - x) ** 2).sum(1))

    def first(self, x: np.ndarray, k: int) -> list:
        """The nearest cells that hold k rows together."""
        order = np.argsort(self.distances(x), kind="stable")
        order = order[self.sizes[order] > 0]
        enough = np.searchsorted(np.cumsum(self.sizes[order]), k) + 1
        return order[:enough].tolist()

    def reached(self, x: np.ndarray, within: float) -> list:
        """Cells whose ball comes as near as ``within`` (all of them where that is not known)."""
        d = self.distances(x)
        margin = 1e-9 * (1.0 + d + self.radii)
        near = d - self.radii <= within + margin if np.isfinite(within) else np.ones(len(d), dtype=bool)
        return np.flatnonzero(near & (self.sizes > 0)).tolist()

    def packs(self, rows: int) -> np.ndarray:
        """Number of the pack of every cell: cells near each other that hold at most ``rows`` rows, or one larger cell."""
        out, todo, n = np.zeros(len(self.pivots), dtype=np.int64), [np.arange(len(self.pivots))], 0
        while todo:
            part = todo.pop()
            if len(part) == 1 or self.sizes[part].sum() <= rows:
                out[part], n = n, n + 1
                continue
            x = self.pivots[part]
            order = part[np.argsort(x[:, np.ptp(x, axis=0).argmax()], kind="stable")]
            todo += [order[:len(order) // 2], order[len(order) // 2:]]
        return out


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def cells_of(train: DataFrame, k: int, tile: int) -> tuple:
    """(placed training rows with their cell, the cells)."""
    w = W.partitionBy("x").orderBy("run_id")
    kept = train.select("run_id", "label", "x").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
    kept = cut_lineage(kept)
    wanted = min(PIVOTS, max(1, -(-kept.count() // tile)))
    sample = kept.orderBy(F.xxhash64("run_id"), "run_id").limit(wanted).select("x").collect()
    if not sample:
        return kept, None
    cells = Cells(np.unique(_stack([r["x"] for r in sample]), axis=0))

    @F.pandas_udf("cell int, far double")
    def place(x: pd.Series) -> pd.DataFrame:
        cell, far = cells.place(_stack(x)) if len(x) else ([], [])
        return pd.DataFrame({"cell": cell, "far": far})

    placed = cut_lineage(kept.withColumn("p", place("x")).select("run_id", "label", "x", "p.cell", "p.far"))
    sizes, radii = np.zeros(len(cells.pivots), dtype=np.int64), np.zeros(len(cells.pivots))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["far"]
    return placed, Cells(cells.pivots, sizes, radii)


def visit(asked: DataFrame, placed: DataFrame, parts: list, k: int, blocks: int) -> DataFrame:
    """The k nearest rows of every part of a pack that a test row asks for: run_id, near, dist (squared), label.

    ``asked`` has run_id, x, an array ``packs`` and ``within``, the distance that bounds what is looked for (null: none); ``parts`` is the
    number of parts that each pack is cut into."""
    of = F.lit(parts)
    all_parts = F.explode(F.sequence(F.lit(0), of[F.col("pack")] - 1))
    left = asked.withColumn("block", F.expr(f"pmod(xxhash64(run_id, x), {blocks})").cast("int")).withColumn("pack", F.explode("packs"))
    wanted = left.select("pack", "block").distinct().withColumn("part", all_parts)
    left = left.withColumn("part", all_parts)
    own = F.pmod(F.xxhash64("run_id"), of[F.col("pack")]).cast("int")
    # Names of its own for the training side: both sides may come from one table.
    right = placed.withColumn("part", own).join(wanted, ["pack", "part"]).select(
        "pack", "part", "block", "run_id", "label", "x").toDF("_pack", "_part", "_block", "near", "label", "y")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        rows = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int32)]
        if len(a) and len(b):
            ids, labels, asker = b["near"].to_numpy(), b["label"].to_numpy(), a["run_id"].to_numpy()
            within = a["within"].to_numpy(dtype=float)
            limit = None if np.isnan(within).all() else np.where(np.isnan(within), np.inf, within ** 2 * (1.0 + 1e-12))
            found = list(nearest_in_tile(_stack(a["x"]), _stack(b["y"]), ids, k, limit))
            pick = np.concatenate([p for _, p, _ in found])
            rows = [np.repeat(asker, [len(p) for _, p, _ in found]), ids[pick], np.concatenate([d for *_, d in found]), labels[pick]]
        return pd.DataFrame(dict(zip(("run_id", "near", "dist", "label"), rows)))

    key = ["pack", "part", "block"]
    return left.select(*key, "run_id", "x", "within").groupBy(key).cogroup(
        right.groupBy(["_pack", "_part", "_block"])).applyInPandas(best, FOUND)


def rows_together(train: int, test: int, width: int, tile: int, cores: int) -> int:
    """Rows of a pack and of a block: so many that every core has some pairs of them, and no more than a task may hold."""
    return max(tile, min(VALUES // max(1, width), math.isqrt(train * test // (PER_CORE * cores))))


def nearest_rows(train: DataFrame, test: DataFrame, k: int = 5, tile: int = 4096) -> DataFrame:
    """Per test row its k nearest training rows: run_id, near (their run_id), dist (squared), label, place from 1.

    ``tile`` is the size of a cell, and the least size of what meets in a task."""
    placed, cells = cells_of(train, k, tile)
    by = W.partitionBy("run_id").orderBy("dist", "near")
    if cells is None:
        return test.sparkSession.createDataFrame([], f"{FOUND}, place int")
    n = test.count()
    rows = rows_together(int(cells.sizes.sum()), n, cells.pivots.shape[1], tile, test.sparkSession.sparkContext.defaultParallelism)
    blocks, pack = max(1, -(-n // rows)), cells.packs(rows)
    parts = [max(1, -(-int(m) // rows)) for m in np.bincount(pack, weights=cells.sizes)]

    @F.pandas_udf("array<int>")
    def first(x: pd.Series) -> pd.Series:
        return pd.Series([np.unique(pack[cells.first(np.asarray(v, dtype=float), k)]).tolist() for v in x])

    @F.pandas_udf("array<int>")
    def reached(x: pd.Series, within: pd.Series) -> pd.Series:
        return pd.Series([np.unique(pack[cells.reached(np.asarray(v, dtype=float), w)]).tolist() for v, w in zip(x, within)])

    placed = placed.withColumn("pack", F.lit(pack.tolist())[F.col("cell")].cast("int"))
    asked = cut_lineage(test.select("run_id", "x").withColumn("packs", first("x")))
    start = visit(asked.withColumn("within", F.lit(None).cast("double")), placed, parts, k, blocks)
    start = cut_lineage(start.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k))
    kth = start.where(F.col("place") == k).select("run_id", F.sqrt("dist").alias("within"))
    # Stored, for the filter and both sides of the visit read the packs.
    more = cut_lineage(asked.join(kth, "run_id", "left").withColumn(
        "packs", F.array_except(reached("x", F.coalesce("within", F.lit(float("inf")))), "packs")))
    rest = visit(more.where(F.size("packs") > 0).select("run_id", "x", "packs", "within"), placed, parts, k, blocks)
    return start.drop("place").unionByName(rest).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def k_nearest(train: DataFrame, test: DataFrame, k: int = 5, tile: int = 4096) -> DataFrame:
    """Class of most of the k nearest training rows, smallest label on ties: run_id, y_true, y_pred."""
    votes = nearest_rows(train, test, k, tile).groupBy("run_id", "label").count()
    winner = votes.groupBy("run_id").agg(F.min(F.struct(-F.col("count"), "label")).alias("w")).select(
        "run_id", F.col("w.label").alias("y_pred"))
    return test.select("run_id", F.col("label").alias("y_true")).join(winner, "run_id")
