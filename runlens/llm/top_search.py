"""Exact top-k inner products: ball-tree branch and bound per shard, kth scores shared between waves of shards.

Components are taken as floor(256 * x), so scores are whole numbers. Vectors are dealt by hash into shards of at most about
`held` components; every shard becomes one ball tree, built once and stored. Queries are dealt into blocks of the same size, and
every block meets every shard in a task of its own: neither side is broadcast, and no list of pairs leaves a task but the k best
of a query. Inside a task the tree is descended from the root; a node goes when <q, centre> + |q| * radius is below the kth score,
and the leaves left are visited in the order of that bound, the kth score rising meanwhile.

Shards are searched in four waves (an eighth, an eighth, a quarter, half of them). After a wave the k best of every query over all
shards so far are stored, and the next wave starts from their kth score. The result is exact whatever the pruning saves.

A vector that stands in many rows is one point of its tree with its k + 1 smallest ids (one may be the query's own); a point's
further ids cannot be among the k best. Work is queries x vectors in the worst case (flat spectra hardly prune); a shard is
copied once per query block, a query once per shard.

Defined cases: null vectors, vectors with a null or non-finite component (also after scaling) and rows without id take no part;
rows of the same id and vector count once; rows of one id with several vectors are candidates each and queries each, and never
candidates of a query of their own id; vectors are compared with those of the same length only; the empty vector scores 0;
scores beyond a long are clamped to its ends; ties go to the smaller id; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runlens.llm.common import stored, table

SCALE = 256.0
LEAF = 64
#: Components that one shard or one block of queries holds (8 bytes each).
HELD = 1 << 19
#: Queries searched at once inside a task; bounds memory only.
AT_ONCE = 1024
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> dict:
    """Nodes of a ball tree over the rows of `points`: rows [start, end) of `order`, centre, radius, and two children or -1."""
    n = len(points)
    order, start, end, centre, radius, child = np.arange(n), [0], [n], [], [], []
    at = 0
    while at < len(start):
        own = order[start[at]:end[at]]
        x = points[own]
        middle = x.mean(0)
        off = ((x - middle) ** 2).sum(1)
        centre.append(middle)
        radius.append(np.sqrt(off.max(initial=0.0)))
        if len(own) <= leaf:
            child.append(-1)
        else:
            far = x[off.argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            half = len(own) // 2
            order[start[at]:end[at]] = own[np.argpartition(x @ (other - far), half)]
            child.append(len(start))
            start += [start[at], start[at] + half]
            end += [start[at] + half, end[at]]
        at += 1
    return {"order": order, "start": np.array(start), "end": np.array(end), "centre": np.array(centre),
            "radius": np.array(radius), "child": np.array(child)}


def shard_tree(x: np.ndarray, ids: np.ndarray, k: int) -> dict:
    """The tree over the different rows of `x`; each point keeps its k + 1 smallest ids."""
    if x.shape[1]:
        points, which = np.unique(x, axis=0, return_inverse=True)
    else:
        points, which = x[:1], np.zeros(len(x), dtype=int)
    by = np.lexsort((ids, which.ravel()))
    owner = which.ravel()[by]
    first = np.searchsorted(owner, np.arange(len(points)))
    kept = np.arange(len(by)) - first[owner] <= k
    tree = ball_tree(points)
    place = np.empty(len(points), dtype=int)
    place[tree["order"]] = np.arange(len(points))
    owner, named = place[owner[kept]], ids[by][kept]
    again = np.argsort(owner, kind="stable")
    return {**tree, "points": points[tree["order"]], "ids": named[again],
            "first": np.searchsorted(owner[again], np.arange(len(points) + 1))}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whole-number inner products of rows, exact; as Python numbers where doubles might round."""
    if not a.shape[1] or np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b).T, *LONG).astype(np.int64)


def _best(owner, score, ident, k):
    """The k best rows of each owner, in order."""
    by = np.lexsort((ident, ~score, owner))  # ~score falls as score rises, without overflow
    owner, score, ident = owner[by], score[by], ident[by]
    nth = np.arange(len(owner)) - np.searchsorted(owner, owner)
    keep = nth < k
    return owner[keep], score[keep], ident[keep], nth[keep]


def search(tree: dict, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, known: np.ndarray, k: int) -> tuple:
    """Candidates (query number, score, id), k at most per query and only scores of at least its `floor` where that is `known`.

    Also returns the numbers of visited leaves and of leaves in all (one count per query and leaf)."""
    floor, known = floor.copy(), known.copy()
    length = np.sqrt((queries ** 2).sum(1))

    def bound(q, node):
        c = tree["centre"][node]
        # A little more than <q, c> + |q| r, so that rounding never hides a point.
        slack = 1e-9 * length[q] * (1.0 + tree["radius"][node] + np.sqrt((c ** 2).sum(1)))
        return np.einsum("ij,ij->i", queries[q], c) + length[q] * tree["radius"][node] + slack

    def open_(q, ub):
        return ~known[q] | (ub >= floor[q])

    q, node = np.arange(len(queries)), np.zeros(len(queries), dtype=int)
    ub = bound(q, node)
    leaves = []
    while len(q):
        alive = open_(q, ub)
        q, node, ub = q[alive], node[alive], ub[alive]
        done = tree["child"][node] < 0
        leaves.append((q[done], node[done], ub[done]))
        q, below = q[~done], tree["child"][node[~done]]
        q, node = np.concatenate([q, q]), np.concatenate([below, below + 1])
        ub = bound(q, node)
    q, node, ub = (np.concatenate(part) for part in zip(*leaves))
    by = np.lexsort((-ub, q))
    q, node, ub = q[by], node[by], ub[by]
    nth = np.arange(len(q)) - np.searchsorted(q, q)
    top = (np.empty(0, dtype=int), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))
    visited, taken, width = 0, 0, 1
    while len(nth) and taken <= nth.max():
        # Each query's next leaves, best bound first; twice as many every round.
        now = (nth >= taken) & (nth < taken + width)
        now[now] = open_(q[now], ub[now])
        found = [top]
        rq, rn = q[now], node[now]
        visited += len(rq)
        for leaf in np.unique(rn):
            asked = rq[rn == leaf]
            lo, hi = tree["start"][leaf], tree["end"][leaf]
            score = products(queries[asked], tree["points"][lo:hi])
            good = np.ones(score.shape, dtype=bool)
            if hi - lo > k + 1:
                good = score >= np.partition(score, hi - lo - k - 1, axis=1)[:, hi - lo - k - 1][:, None]
            good &= ~known[asked][:, None] | (score >= floor[asked][:, None])
            a, p = np.nonzero(good)
            first, times = tree["first"][lo + p], np.diff(tree["first"])[lo + p]
            each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            ident, asker = tree["ids"][np.repeat(first, times) + each], np.repeat(asked[a], times)
            other = ident != own[asker]
            found.append((asker[other], np.repeat(score[a, p], times)[other], ident[other]))
        *top, rank = _best(*(np.concatenate(part) for part in zip(*found)), k)
        last = rank == k - 1
        floor[top[0][last]], known[top[0][last]] = top[1][last], True
        taken, width = taken + width, width * 2
    leaves_in_all = len(queries) * int((tree["child"] < 0).sum())
    return (*top, visited, leaves_in_all)


def packed(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as got:
        return {name: got[name] for name in got.files}


def _matrix(column) -> np.ndarray:
    return np.floor(SCALE * np.array([np.asarray(v, dtype=float) for v in column], dtype=float).reshape(len(column), -1))


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x, width): different rows that take part."""
    limit = F.lit(float(np.finfo(float).max / SCALE))
    fit = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= limit))
    return (rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
            .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.coalesce(fit, F.lit(False)))
            .dropDuplicates(["vec_id", "x"]).withColumn("width", F.size("x")))


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          held: int = HELD) -> DataFrame:
    """The k best candidates of every query row: query_id, rank from 1, vec_id, score.

    `is_query` is a condition on the column vec_id (the id as a long)."""
    vectors = stored(usable(rows, id_col, vector_col), "vectors")
    size = vectors.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"), F.max("width").alias("d")).first()
    per = max(1, held // max(1, size["d"] or 1))
    shards, blocks = max(1, -(-size["n"] // per)), max(1, -(-size["q"] // per))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = shard_tree(_matrix(group["x"]), group["vec_id"].to_numpy(), k)
        return pd.DataFrame({"width": group["width"].iloc[:1], "shard": group["shard"].iloc[:1], "tree": [packed(tree)]})

    own = F.xxhash64("vec_id", "x")
    trees = stored(vectors.withColumn("shard", F.pmod(own, F.lit(shards)).cast("int")).groupBy("width", "shard")
                   .applyInPandas(build, "width int, shard int, tree binary"), "ball-trees")
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), F.xxhash64("x").alias("query_key"), "x", "width",
                                             F.pmod(own, F.lit(blocks)).cast("int").alias("block"))

    def meet(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(shard):
            tree = unpacked(shard["tree"].iloc[0])
            for at in range(0, len(asked), AT_ONCE):
                part = asked.iloc[at:at + AT_ONCE]
                known = part["floor"].notna().to_numpy()
                floor = np.array([int(v) if ok else 0 for v, ok in zip(part["floor"], known)], dtype=np.int64)
                ids = part["query_id"].to_numpy()
                q, score, ident, *_ = search(tree, _matrix(part["x"]), ids, floor, known, k)
                out.append(pd.DataFrame({"query_id": ids[q], "query_key": part["query_key"].to_numpy()[q], "vec_id": ident,
                                         "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "query_key": [], "vec_id": [], "score": []}, dtype="int64")

    result = "query_id long, query_key long, vec_id long, score long"
    by = W.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best, start = None, 0
    for end in sorted({-(-shards // 8), -(-shards // 4), -(-shards // 2), shards}):
        asked = queries.withColumn("floor", F.lit(None).cast("string"))
        if best is not None:
            # As text: a null would turn the column into rounded doubles on its way to pandas.
            kth = best.where(F.col("rank") == k).select("query_id", "query_key", F.col("score").cast("string").alias("floor"))
            asked = queries.join(kth, ["query_id", "query_key"], "left")
        left = asked.withColumn("shard", F.explode(F.sequence(F.lit(start), F.lit(end - 1))))
        right = trees.where(F.col("shard").between(start, end - 1)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        key = ["width", "block", "shard"]
        found = left.groupBy(key).cogroup(right.groupBy(key)).applyInPandas(meet, result)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stored(found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k), "top-k")
        start = end
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""

QUERIES = {"op12_exact_top_k": (op12_exact_top_k, SQL)}
