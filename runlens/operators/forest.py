"""Classification trees of many rows, grown without the driver.

pyspark.ml keeps every node of every tree in the driver and passes over the rows once per level and group of nodes; fully grown trees
have nearly as many nodes as rows. Here the rows are cut into bins as there. Nodes of more than LOCAL rows are split by histograms
that tasks add up; the driver holds these few nodes only. The rows of a smaller node meet in one task, which grows everything below
it and sends the test rows that arrive there down to their leaves. Trees are not stored: what leaves the tasks is the class shares of
a test row per tree, as whole numbers, so sums do not depend on their order.

Same method as pyspark.ml's (Gini impurity, Poisson bootstrap, features drawn per node, borders from a sample of at least 10,000 rows,
equal sister leaves merged), other random numbers: predictions agree statistically.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Rows of a node (with their bootstrap weights) whose subtree one task grows.
LOCAL = 1 << 16
#: Numbers of all histograms of one pass (32 MB).
HISTOGRAMS = 1 << 22
#: Bytes of the packed rows that make one row of a shuffle.
PACK_BYTES = 2048
#: Whole votes of a tree for a test row, dealt over the classes.
VOTE = float(1 << 40)


@dataclass(frozen=True)
class Grown:
    """How trees grow: number, deepest level, bins, least rows of a child, seed."""

    trees: int
    depth: int
    bins: int = 32
    least: int = 1
    seed: int = 42

    def features(self, width: int) -> int:
        """Features tried per node: all for a single tree, else the root of their number."""
        return width if self.trees == 1 else int(np.ceil(np.sqrt(width)))


@dataclass
class Top:
    """The large nodes of one tree: feature (-1 where the distributed part ends), last bin of the left child, children, and
    the number of each node (root 1, children 2i and 2i + 1)."""

    feature: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [0])
    right: list = field(default_factory=lambda: [0])
    number: list = field(default_factory=lambda: [1])

    def split(self, at: int, feature: int, cut: int) -> tuple:
        self.feature[at], self.cut[at] = feature, cut
        self.left[at], self.right[at] = len(self.feature), len(self.feature) + 1
        for side in (0, 1):
            self.feature.append(-1)
            self.number.append(2 * self.number[at] + side)
            for column in (self.cut, self.left, self.right):
                column.append(0)
        return self.left[at], self.right[at]


def descend(bins: np.ndarray, feature, cut, left, right) -> np.ndarray:
    """Index of the node where each row ends."""
    feature, cut, left, right = (np.asarray(v) for v in (feature, cut, left, right))
    at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while True:
        rows = rows[feature[at[rows]] >= 0]
        if not len(rows):
            return at
        node = at[rows]
        at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])


def borders_of(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between bins of about equally many of the sampled values; all of them where values are few."""
    seen, count = np.unique(values[np.isfinite(values)], return_counts=True)
    if len(seen) < 2:
        return np.empty(0)
    after = np.arange(len(seen) - 1)
    if len(after) > bins - 1:
        total = np.cumsum(count)
        aim = total[-1] / bins * np.arange(1, bins)
        hi = np.clip(np.searchsorted(total, aim), 1, len(seen) - 1)
        after = np.unique(np.minimum(np.where(aim - total[hi - 1] < total[hi] - aim, hi - 1, hi), len(seen) - 2))
    return (seen[after] + seen[after + 1]) / 2.0


def find_borders(rows: DataFrame, n: int, how: Grown) -> list:
    """Borders of every feature, from a sample as pyspark.ml takes it; one task holds the sample."""
    wanted = max(how.bins * how.bins, 10_000)
    sample = rows.select("x") if n <= wanted else rows.select("x").sample(wanted / n, how.seed)

    def run(frames):
        held = [np.stack(pdf["x"].to_list()) for pdf in frames if len(pdf)]
        x = np.concatenate(held)
        yield pd.DataFrame({"pos": range(x.shape[1]), "b": [borders_of(x[:, i], how.bins) for i in range(x.shape[1])]})

    got = sample.repartition(1).mapInPandas(run, "pos int, b array<double>").collect()
    return [np.asarray(r["b"], dtype=np.float64) for r in sorted(got, key=lambda r: r["pos"])]


def binned(rows: DataFrame, borders: list, keep: list) -> DataFrame:
    """The rows with an id and their bins, one byte per feature; stored."""
    schema = rows.select(*keep).schema

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = np.empty(x.shape, dtype=np.uint8)
            for i, b in enumerate(borders):
                out[:, i] = np.searchsorted(b, x[:, i])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array([r.tobytes() for r in out], pa.binary())],
                                             [*keep, "bins"])

    done = rows.select(*keep, "x").mapInArrow(run, schema.add("bins", "binary"))
    return cut_lineage(done.withColumn("id", F.monotonically_increasing_id()))


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


#: Chances of drawing a row at most 0, 1, .. times.
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def draws(ids: np.ndarray, tree: int, how: Grown) -> np.ndarray:
    """How often each row is drawn for a tree; always the same for an id."""
    if how.trees == 1:
        return np.ones(len(ids), dtype=np.int64)
    start = _mixed(np.array([how.seed * 1_000_003 + tree + 1], dtype=np.uint64))[0]
    u = _mixed(_mixed(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + start)) >> np.uint64(11)
    return np.searchsorted(POISSON, u / float(1 << 53), side="right")


def chosen(how: Grown, width: int, tree: int, number: int) -> np.ndarray:
    """Features tried at a large node."""
    m = how.features(width)
    return np.arange(width) if m == width else np.sort(np.random.default_rng([how.seed, tree, number]).choice(width, m, replace=False))


def _arrays(batch, width):
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
    return bins, batch.column("id").to_numpy()


def gini_score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sum over both children of rows times sum of squared shares; the largest is the best split."""
    nl, nr = left.sum(-1), right.sum(-1)
    return (left * left).sum(-1) / np.maximum(nl, 1) + (right * right).sum(-1) / np.maximum(nr, 1)


def best_cut(hist: np.ndarray, least: int) -> tuple | None:
    """(place of the feature, last left bin, class counts left, right) of the best split of one histogram (features, bins, classes)."""
    total = hist[0].sum(0)
    left = np.cumsum(hist, axis=1)[:, :-1]
    right = total - left
    score = np.where((left.sum(-1) >= least) & (right.sum(-1) >= least), gini_score(left, right), -1.0)
    f, b = np.unravel_index(int(np.argmax(score)), score.shape)
    if score[f, b] <= (total * total).sum() / total.sum() + 1e-9:
        return None
    return int(f), int(b), left[f, b], right[f, b]


def split_large(train: DataFrame, width: int, classes: int, how: Grown) -> tuple:
    """(top of every tree, {(tree, index): class counts} of large nodes that stay leaves)."""
    tops = [Top() for _ in range(how.trees)]
    leaves: dict = {}
    m = how.features(width)
    step = max(1, HISTOGRAMS // (m * how.bins * classes))
    waiting = [(t, 0) for t in range(how.trees)]
    while waiting:
        part, waiting = waiting[:step], waiting[step:]
        places = {}
        for t, at in part:
            places.setdefault(t, []).append(at)
        tried = {(t, at): chosen(how, width, t, tops[t].number[at]) for t, at in part}

        def count(batches):
            sums = {node: np.zeros((m, how.bins, classes), dtype=np.int64) for node in tried}
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, ids = _arrays(batch, width)
                label = batch.column("label").to_numpy().astype(np.int64)
                for t, nodes in places.items():
                    top = tops[t]
                    w, end = draws(ids, t, how), descend(bins, top.feature, top.cut, top.left, top.right)
                    for at in nodes:
                        rows = np.flatnonzero((end == at) & (w > 0))
                        if not len(rows):
                            continue
                        for i, f in enumerate(tried[t, at]):
                            cell = bins[rows, f].astype(np.int64) * classes + label[rows]
                            sums[t, at][i] += np.bincount(cell, w[rows], how.bins * classes).astype(np.int64).reshape(how.bins, classes)
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in sums], pa.int32()), pa.array([at for _, at in sums], pa.int32()),
                                              pa.array([h.tobytes() for h in sums.values()], pa.binary())], ["tree", "at", "h"])

        def best(group: pd.DataFrame) -> pd.DataFrame:
            hist = sum(np.frombuffer(h, dtype=np.int64) for h in group["h"]).reshape(m, how.bins, classes)
            got = best_cut(hist, how.least)
            f, b, left, right = got if got else (-1, 0, hist[0].sum(0), np.zeros(classes, dtype=np.int64))
            return pd.DataFrame({"tree": [group["tree"].iloc[0]], "at": [group["at"].iloc[0]], "f": [f], "b": [b], "l": [left], "r": [right]})

        found = train.mapInArrow(count, "tree int, at int, h binary").groupBy("tree", "at").applyInPandas(
            best, "tree int, at int, f int, b int, l array<bigint>, r array<bigint>").collect()
        for r in sorted(found, key=lambda r: (r["tree"], r["at"])):
            t, at = r["tree"], r["at"]
            if r["f"] < 0:
                leaves[t, at] = r["l"]
                continue
            for child, counts in zip(tops[t].split(at, int(tried[t, at][r["f"]]), r["b"]), (r["l"], r["r"])):
                if sum(counts) <= LOCAL:
                    continue
                if tops[t].number[child].bit_length() > how.depth or max(counts) == sum(counts):
                    leaves[t, child] = counts
                else:
                    waiting.append((t, child))
    return tops, leaves


class Subtree:
    """A tree below one node, grown level by level over all nodes of a level at once."""

    def __init__(self, bins, label, weight, classes: int, how: Grown, tree: int, number: int):
        width, m = bins.shape[1], how.features(bins.shape[1])
        rng = np.random.default_rng([how.seed, tree, number, 1])
        self.feature, self.cut, self.left, self.right = ([] for _ in range(4))
        counts, level = [], []
        rows, node, depth, made = np.arange(len(label)), np.zeros(len(label), dtype=np.int64), number.bit_length() - 1, 0
        n = 1
        while n:
            made += n
            total = np.bincount(node * classes + label[rows], weight[rows], n * classes).reshape(n, classes)
            counts.append(total)
            level.append(n)
            for column in (self.feature, self.cut, self.left, self.right):
                column.append(np.full(n, -1, dtype=np.int64))
            open_ = (total.max(1) < total.sum(1)) & (depth < how.depth)
            keep = open_[node]
            rows, node = rows[keep], node[keep]
            if not len(rows):
                break
            tried = np.argsort(rng.random((n, width)), axis=1)[:, :m] if m < width else None
            score, f, b = self._best(bins, label, weight, rows, node, total, tried, width, m, classes, how)
            size = np.maximum(total.sum(1), 1)
            good = open_ & (score > (total * total).sum(1) / size + 1e-9)
            index = np.cumsum(good) - 1
            k = int(good.sum())
            for column, v in ((self.feature, f), (self.cut, b), (self.left, made + 2 * index), (self.right, made + 2 * index + 1)):
                column[-1][good] = v[good]
            keep = good[node]
            rows, node = rows[keep], node[keep]
            node = 2 * index[node] + (bins[rows, f[node]] > b[node])
            n, depth = 2 * k, depth + 1
        self.feature, self.cut, self.left, self.right = (np.concatenate(c) for c in (self.feature, self.cut, self.left, self.right))
        counts = np.concatenate(counts)
        self._merge(counts, level)
        shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
        self.votes = np.rint(shares * VOTE).astype(np.int64)

    @staticmethod
    def _best(bins, label, weight, rows, node, total, tried, width, m, classes, how):
        n = len(total)
        score, best_f, best_b = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        y, w = label[rows], weight[rows].astype(float)
        for j in range(m):
            f = tried[node, j] if tried is not None else j
            bin_ = bins[rows, f].astype(np.int64)
            cell = node * how.bins + bin_
            # Class counts of the cells that have rows; cells of a node follow each other.
            if n * how.bins <= 4 * len(rows):
                hist = np.bincount(cell * classes + y, w, n * how.bins * classes).reshape(-1, classes)
                at = np.flatnonzero(hist.any(1))
                hist = hist[at]
            else:
                at, back = np.unique(cell, return_inverse=True)
                hist = np.bincount(back * classes + y, w, len(at) * classes).reshape(-1, classes)
            owner = at // how.bins
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            left = np.cumsum(hist, axis=0)
            before = np.zeros((len(first), classes))
            before[1:] = left[first[1:] - 1]
            size = np.diff(np.append(first, len(at)))
            left -= np.repeat(before, size, axis=0)
            right = total[owner] - left
            ok = (left.sum(1) >= how.least) & (right.sum(1) >= how.least)
            s = np.where(ok, gini_score(left, right), -1.0)
            top = np.maximum.reduceat(s, first)
            hit = np.flatnonzero(s == np.repeat(top, size))
            who, place = np.unique(owner[hit], return_index=True)
            better = top > score[who]
            who, place, top = who[better], hit[place[better]], top[better]
            score[who], best_b[who] = top, at[place] % how.bins
            best_f[who] = tried[who, j] if tried is not None else j
        return score, best_f, best_b

    def _merge(self, counts, level):
        """Sister leaves of one class become one leaf."""
        said = counts.argmax(1)
        at = len(self.feature)
        for n in reversed(level):
            at -= n
            inner = np.arange(at, at + n)
            inner = inner[self.feature[inner] >= 0]
            a, b = self.left[inner], self.right[inner]
            same = (self.feature[a] < 0) & (self.feature[b] < 0) & (said[a] == said[b])
            self.feature[inner[same]] = -1

    def vote(self, bins: np.ndarray) -> np.ndarray:
        return self.votes[descend(bins, self.feature, self.cut, self.left, self.right)]


def packs(train: DataFrame, test: DataFrame, tops: list, leaves: dict, width: int, how: Grown) -> DataFrame:
    """Rows packed by tree and small node: (tree, number, kind 0 with label and weight or 1 with id, bins)."""
    per = max(1, PACK_BYTES // (width + 8))
    schema = "tree int, number bigint, kind int, a binary, b binary, bins binary"

    def run_for(kind):
        def run(batches):
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, ids = _arrays(batch, width)
                label = batch.column("label").to_numpy(zero_copy_only=False) if kind == 0 else None
                out = []
                for t, top in enumerate(tops):
                    end = descend(bins, top.feature, top.cut, top.left, top.right)
                    if kind == 0:
                        w = draws(ids, t, how)
                        closed = [at for tree, at in leaves if tree == t]
                        rows = np.flatnonzero((w > 0) & ~np.isin(end, closed))
                    else:
                        rows = np.arange(len(ids))
                    rows = rows[np.argsort(end[rows], kind="stable")]
                    cuts = np.flatnonzero(np.diff(end[rows])) + 1
                    for group in np.split(rows, cuts):
                        for lo in range(0, len(group), per):
                            g = group[lo:lo + per]
                            a, b = (label[g].astype(np.int32), w[g].astype(np.int64)) if kind == 0 else (ids[g].astype(np.int64), np.empty(0, np.int64))
                            out.append((t, top.number[end[g[0]]], kind, a.tobytes(), b.tobytes(), bins[g].tobytes()))
                if out:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                                     ["tree", "number", "kind", "a", "b", "bins"])
        return run

    made = train.mapInArrow(run_for(0), schema).unionByName(test.mapInArrow(run_for(1), schema))
    # A large leaf sends its class counts instead of its rows.
    known = [(t, tops[t].number[at], 0, bytearray(np.arange(len(c), dtype=np.int32).tobytes()), bytearray(np.asarray(c, dtype=np.int64).tobytes()),
              bytearray(len(c) * width)) for (t, at), c in leaves.items()]
    return made.unionByName(train.sparkSession.createDataFrame(known, schema)) if known else made


def votes(packed: DataFrame, width: int, classes: int, how: Grown) -> DataFrame:
    """Votes of every tree for every test row: the rows of a node come first, then the test rows that end there."""
    def run(batches):
        key, held, tree = None, [], None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (r["tree"], r["number"]) != key:
                    key, held, tree = (r["tree"], r["number"]), [], None
                bins = np.frombuffer(r["bins"], dtype=np.uint8).reshape(-1, width)
                if r["kind"] == 0:
                    held.append((bins, np.frombuffer(r["a"], dtype=np.int32), np.frombuffer(r["b"], dtype=np.int64)))
                    continue
                if tree is None:
                    x, y, w = (np.concatenate(c) for c in zip(*held))
                    held, tree = [], Subtree(x, y.astype(np.int64), w, classes, how, *key)
                out.append((np.frombuffer(r["a"], dtype=np.int64), tree.vote(bins)))
            if out:
                ids, v = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(ids), *[pa.array(v[:, c]) for c in range(classes)]],
                                                 ["id", *[f"v{c}" for c in range(classes)]])

    nodes = packed.repartition("tree", "number").sortWithinPartitions("tree", "number", "kind")
    return nodes.mapInArrow(run, "id bigint, " + ", ".join(f"v{c} bigint" for c in range(classes)))


def grow_and_predict(train: DataFrame, test: DataFrame, how: Grown) -> DataFrame:
    """run_id, y_true, y_pred of the test rows (``features`` is a vector in both); the smallest label wins ties."""
    train, test = (df.withColumn("x", vector_to_array("features")) for df in (train, test))
    seen = train.agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("known"), F.min("label").alias("lo"), F.max("label").alias("hi"),
                     F.max(F.size("x")).alias("width")).first()
    if seen["known"] < seen["n"] or seen["lo"] < 0:
        raise ValueError("labels must not be null or negative")
    width, classes = seen["width"], seen["hi"] + 1
    borders = find_borders(train, seen["n"], how)
    rows = binned(train, borders, ["label"])
    asked = binned(test, borders, ["run_id", "label"])
    tops, leaves = split_large(rows, width, classes, how) if seen["n"] > LOCAL else ([Top() for _ in range(how.trees)], {})
    all_votes = votes(packs(rows, asked, tops, leaves, width, how), width, classes, how)
    sums = all_votes.groupBy("id").agg(*[F.sum(f"v{c}").alias(f"v{c}") for c in range(classes)])
    shares = F.array(*[f"v{c}" for c in range(classes)])
    pred = sums.select("id", (F.array_position(shares, F.array_max(shares)) - 1).cast("int").alias("y_pred"))
    return asked.join(pred, "id").select("run_id", F.col("label").alias("y_true"), "y_pred")
