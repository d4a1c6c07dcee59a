"""Per-run moments: n, mean vector and population covariance (upper triangle), for any run length.

Up to NATIVE_WIDTH variables Spark's own covariance aggregates do the work. Beyond that, tasks
build partial (n, mean, scatter) triples from Arrow batches, and the triples of a run are merged one
after another from a sorted stream, so neither samples nor partial results of a run are gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.linalg import unpack
from ..schema import KEYS

NATIVE_WIDTH = 8
# Map tasks whose partial matrices of one run meet in one task of the first merge level.
TASKS_PER_GROUP = 128
PARTIAL_BYTES = 64 << 20


def moments(df: DataFrame, width: int, z: str = "z", keys=KEYS, native: bool | None = None) -> DataFrame:
    """Columns: keys, n, last_t, mean (array), cov (packed upper triangle)."""
    if native is None:
        native = width <= NATIVE_WIDTH
    return _native(df, width, z, list(keys)) if native else _partial_merge(df, width, z, list(keys))


def _native(df, width, z, keys):
    cells = df.select(*keys, "t", *[F.col(z)[i].alias(f"_z{i}") for i in range(width)])
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    got = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max("t").alias("last_t"),
        *[F.avg(f"_z{i}").alias(f"_m{i}") for i in range(width)],
        *[F.covar_pop(f"_z{i}", f"_z{j}").alias(f"_c{i}_{j}") for i, j in pairs])
    return got.select(*keys, "n", "last_t", F.array(*[f"_m{i}" for i in range(width)]).alias("mean"),
                      F.array(*[f"_c{i}_{j}" for i, j in pairs]).alias("cov"))


def merge(a, b):
    """Combine two (n, last_t, mean, scatter) results."""
    n = a[0] + b[0]
    gap = b[2] - a[2]
    return (n, max(a[1], b[1]), a[2] + gap * (b[0] / n), a[3] + b[3] + np.outer(gap, gap) * (a[0] * b[0] / n))


def _segments(columns) -> list:
    """Start and end of stretches with equal keys."""
    change = np.zeros(len(columns[0]), dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(change)
    return list(zip(starts, np.append(starts[1:], len(change))))


def _partial_merge(df, width, z, keys):
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", n bigint, last_t bigint, mean array<double>, cov array<double>"
    arrow_types = [pa.int64() if types[k] == "bigint" else pa.int32() if types[k] == "int" else pa.string() for k in keys]
    limit = max(4, PARTIAL_BYTES // (width * width * 8))
    upper = np.triu_indices(width)

    def to_batch(rows):
        cols = [pa.array([r[0][i] for r in rows], t) for i, t in enumerate(arrow_types)]
        cols += [pa.array([int(r[1][0]) for r in rows], pa.int64()), pa.array([int(r[1][1]) for r in rows], pa.int64()),
                 pa.array([r[1][2] for r in rows], pa.list_(pa.float64())),
                 pa.array([r[1][3][upper] for r in rows], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(cols, names=[*keys, "n", "last_t", "mean", "cov"])

    def partial(batches):
        held = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            t = batch.column("t").to_numpy(zero_copy_only=False)
            order = np.lexsort(cols[::-1])
            x, t, cols = x[order], t[order], [c[order] for c in cols]
            for lo, hi in _segments(cols):
                part = x[lo:hi]
                mean = part.mean(axis=0)
                centred = part - mean
                piece = (hi - lo, t[lo:hi].max(), mean, centred.T @ centred)
                key = tuple(c[lo].item() if hasattr(c[lo], "item") else c[lo] for c in cols)
                held[key] = merge(held[key], piece) if key in held else piece
            if len(held) > limit:
                yield to_batch(list(held.items()))
                held = {}
        if held:
            yield to_batch(list(held.items()))

    def combine(batches, last=True):
        key, acc, ready = None, None, []
        done = (lambda a: (a[0], a[1], a[2], a[3] / a[0])) if last else (lambda a: a)
        for batch in batches:
            for r in batch.to_pylist():
                k = tuple(r[c] for c in keys)
                piece = (r["n"], r["last_t"], np.array(r["mean"]), unpack(r["cov"], width))
                if k == key:
                    acc = merge(acc, piece)
                    continue
                if key is not None:
                    ready.append((key, done(acc)))
                key, acc = k, piece
                if len(ready) >= limit:
                    yield to_batch(ready)
                    ready = []
        if key is not None:
            ready.append((key, done(acc)))
        if ready:
            yield to_batch(ready)

    pieces = df.select(*keys, F.col("t").cast("bigint").alias("t"), F.col(z).alias("z")).mapInArrow(partial, schema)
    # Two levels: the matrices of a run that many tasks have read meet by groups of tasks first.
    near = (pieces.withColumn("_g", F.expr(f"spark_partition_id() div {TASKS_PER_GROUP}")).repartition(*keys, "_g")
            .sortWithinPartitions(*keys, "_g").drop("_g"))
    near = near.mapInArrow(lambda batches: combine(batches, False), schema)
    return near.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(combine, schema)


def scaled(mean: np.ndarray, cov: np.ndarray, d: int, mode: str, scaler, copies, derived=()):
    """Moments after scaling the run, without touching its samples.

    ``mean``/``cov`` describe stacks of ``copies`` samples of d channels each, of which those listed in
    ``derived`` are differences (no offset). Standard scaling is linear; the scalar mean of a run is the
    average of its channel means.
    """
    if mode == "scaler":
        std = np.tile(np.asarray(scaler.std), copies)
        offset = np.concatenate([np.zeros(d) if i in derived else np.asarray(scaler.mean) for i in range(copies)])
        return (mean - offset) / std, cov / np.outer(std, std)
    plain = [i for i in range(copies) if i not in derived]
    shift = np.concatenate([np.zeros(d) if i in derived else np.full(d, mean[plain[0] * d:(plain[0] + 1) * d].mean())
                            for i in range(copies)])
    return mean - shift, cov
