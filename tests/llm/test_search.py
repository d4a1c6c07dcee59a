"""Exact top-k search against brute force in Python numbers: ties, copies, odd rows, many shards, pruning."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.llm import top_search

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("rank", T.StringType()),
                       T.StructField("score", T.StringType()), T.StructField("shard", T.StringType()),
                       T.StructField("x", T.StringType()), T.StructField("block", T.MapType(T.StringType(), T.StringType()))])


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", "s", "h", "x", {"a": "b"}) for i, v in rows], SCHEMA)


def truth(rows, every, k):
    """Every query's best by comparing it with all rows."""
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            seen[i, tuple(math.floor(256 * float(np.float32(c))) for c in v)] = tuple(float(np.float32(c)) for c in v)
    out = []
    for i, v in seen:
        if i % every == 0:
            found = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -2**63), 2**63 - 1), j)
                           for j, w in seen if j != i and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def got(df):
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in df.collect())


def test_top_k_on_awkward_rows(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([-0.5, -0.25, 0.0, 0.25, 0.5]) for _ in range(3)]) for i in range(300)]  # ties everywhere
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(300, 460)]  # one vector under many ids
    rows += [(10, [0.1, 0.2, 0.3]), (10, [0.1, 0.2, 0.3]), (5, [0.9, 0.9, 0.9]), (10, [1.5, 1.5, 1.5])]  # repeated ids
    rows += [(None, [9.0, 9.0, 9.0]), (500, None), (510, [None, 1.0, 1.0]), (520, [float("nan"), 1.0, 1.0]),
             (530, [float("inf"), 1.0, 1.0]), (540, []), (550, []), (560, [1.0]), (570, [2.0]), (580, [1.0, 2.0]),
             (-50, [0.3, -0.3, 0.7]), (590, [3e9, 3e9, -1e9, 4e9]), (600, [3e9, -3e9, 2e9, 4e9]), (610, [3e38, 3e38, 3e38, 3e38])]
    for held in (1 << 19, 64):
        df = top_search.top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, k=5, held=held)
        assert got(df) == truth(rows, 10, 5)


def test_empty_table_and_no_queries(spark):
    assert got(top_search.top_k(frame(spark, []), F.col("vec_id") % 50 == 0)) == []
    assert got(top_search.top_k(frame(spark, [(1, [1.0]), (2, [2.0])]), F.col("vec_id") % 50 == 0)) == []


def test_tree_search_prunes_and_keeps_the_best():
    r = np.random.default_rng(3)
    middles = r.normal(size=(40, 8)) * 400
    x = np.floor(middles[r.integers(0, 40, 4000)] + r.normal(size=(4000, 8)) * 10)
    ids = r.permutation(4000)
    tree = top_search.shard_tree(x, ids, 5)
    q = np.floor(middles[:20] + 3)
    own = np.full(20, -1)
    a, score, ident, visited, every = top_search.search(tree, q, own, np.zeros(20, dtype=np.int64), np.zeros(20, dtype=bool), 5)
    full = (q @ x.T).astype(int)
    for i in range(20):
        want = sorted(zip(-full[i], ids))[:5]
        assert [(-s, j) for s, j in zip(score[a == i], ident[a == i])] == want
    assert visited < every / 4
    # A kth score known from other shards leaves only what can still enter.
    kth = np.array([score[a == i][-1] for i in range(20)])
    *_, fewer, _ = top_search.search(tree, q, own, kth + 1, np.ones(20, dtype=bool), 5)
    assert fewer <= visited
