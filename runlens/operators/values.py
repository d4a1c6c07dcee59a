"""Value-ordered work on groups of any size: exact quantiles and ranks.

Equal values are counted before anything is sorted. The counted values are dealt into ranges of (group, value) whose borders Spark
samples, so ranges hold about equally many values however the values are spread; a sort covers one task, the counts before a
value run up inside its range, and only one total per (group, range) meets per group. The ranges are stored, so that every later
reader sees the same ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

SALTS = 16


def salted_join(rows: DataFrame, side: DataFrame, keys: list, spread: Column, how: str = "inner") -> DataFrame:
    """Join a small table to many rows of few keys; rows of one key are spread over SALTS partitions."""
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = side.withColumn("_salt", F.explode_outer(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def finite(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _changes(batch, group) -> np.ndarray:
    """Marks the rows of a sorted batch that begin a group."""
    out = np.ones(batch.num_rows, dtype=bool)
    out[1:] = False
    for name in group:
        c = batch.column(name)
        now, before = c.slice(1), c.slice(0, batch.num_rows - 1)
        differ = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False)
        out[1:] |= differ | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
    return out


def ordered_counts(counts: DataFrame, group: list, value: str = "value", per_bin: int | None = None,
                   keep_range: bool = False) -> DataFrame:
    """Adds to (group, value, n, ..): ``before`` = rows of the group with a smaller value, ``total``.

    ``counts`` holds one row per (group, value). There are as many tasks as shuffle partitions, whatever the number of values; a
    task's values are one range, or ranges of ``per_bin`` values. With ``keep_range`` the number of a row's range stays as ``range``.
    """
    order = [*group, value]
    ranged = counts.repartitionByRange(*order)

    def running(batches):
        part, key, carried, seen = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(_changes(batch, group))
            before = np.cumsum(n) - n
            size = np.diff(np.append(starts, batch.num_rows))
            inside = before - np.repeat(before[starts], size)
            if [batch.column(c)[0].as_py() for c in group] == key:
                inside[:size[0]] += carried
            key = [batch.column(c)[-1].as_py() for c in group]
            carried = int(inside[-1] + n[-1])
            added = [pa.array(np.full(len(n), part, dtype=np.int32)), pa.array(inside)]
            if keep_range:
                added.append(pa.array((part << 32) + (seen + np.arange(len(n), dtype=np.int64)) // (per_bin or 1 << 62)))
            seen += len(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *more])

    more = ["_p", "_i", "range"] if keep_range else ["_p", "_i"]
    schema = T.StructType([*counts.schema.fields, *[T.StructField(c, T.IntegerType() if c == "_p" else T.LongType()) for c in more]])
    rows = cut_lineage(ranged.sortWithinPartitions(*order).mapInArrow(running, schema))
    totals = rows.groupBy(*group, "_p").agg(F.sum("n").alias("_s"))
    earlier = W.partitionBy(*group).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*group, "_p", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_o"),
                            F.sum("_s").over(W.partitionBy(*group)).alias("total"))
    return rows.join(offsets, [*group, "_p"]).withColumn("before", F.col("_o") + F.col("_i")).drop("_p", "_i", "_o")


def range_sizes(ordered: DataFrame) -> DataFrame:
    """Values per range of ordered counts that kept their range."""
    return ordered.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))


def order_key(values: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Integers in the order that Spark gives doubles: nulls first, NaN last, both zeros equal."""
    v = np.asarray(values, dtype=np.float64) + 0.0
    bits = v.view(np.int64)
    key = bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
    key[np.isnan(v)] = np.iinfo(np.int64).max
    key[missing] = np.iinfo(np.int64).min
    return key


def planes(a: np.ndarray) -> bytes:
    """The bytes of an array, all first bytes before all second ones: those of sorted numbers compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unplanes(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(size, -1).T).view(kind).ravel()


#: Rows that a task holds before it passes them on packed, and values of one feature that meet in one task.
PACK_ROWS = 1 << 19
RANGE_ROWS = 1 << 21


def range_borders(long: DataFrame, most: int) -> dict:
    """{feature: borders} of features with more than ``most`` values; borders of all of them are fewer than rows / ``most`` x 2."""
    big = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).collect()}
    if not big:
        return {}
    pieces = {f: -(-n // most) for f, n in big.items()}
    parts = max(pieces.values())
    at = F.percentile_approx("value", F.lit([i / parts for i in range(1, parts)]), F.lit(max(10_000, 8 * parts)))
    got = long.where(F.col("feature").isin(list(big))).groupBy("feature").agg(at.alias("b")).collect()
    out = {}
    for r in got:
        step = max(1, parts // pieces[r["feature"]])
        held = np.asarray((r["b"] or [])[step - 1::step], dtype=np.float64)
        out[r["feature"]] = np.unique(order_key(held, np.zeros(len(held), dtype=bool)))
    return out


def packed_values(long: DataFrame, labels: list, borders: dict) -> DataFrame:
    """(feature, range, keys, classes, counts): the values of many rows as one row of sorted, packed arrays. Equal values of a class
    are counted; ``counts`` is empty where every value came once. ``classes`` are places in ``labels``, -1 for others."""
    known = np.asarray(sorted(labels), dtype=np.int64)
    place = np.asarray([labels.index(v) for v in known], dtype=np.int16)
    kind = long.schema["feature"].dataType

    def pack(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACK_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    def flush(held):
        table = pa.Table.from_batches(held)
        coded = table.column("feature").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        value, label = table.column("value"), table.column("label")
        key = order_key(value.to_numpy(), value.is_null().to_numpy())
        lab = pc.fill_null(label.cast(pa.int64()), np.iinfo(np.int64).min).to_numpy()
        where = np.minimum(np.searchsorted(known, lab), len(known) - 1)
        cls = np.where(known[where] == lab, place[where], -1).astype(np.int16)
        order = np.lexsort((cls, key, code))
        code, key, cls = code[order], key[order], cls[order]
        new = np.ones(len(code), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        starts = np.flatnonzero(new)
        count = np.diff(np.append(starts, len(code)))
        code, key, cls = code[starts], key[starts], cls[starts]
        out = [[], [], [], [], []]
        ends = np.flatnonzero(np.append(code[1:] != code[:-1], True)) + 1
        for lo, hi in zip(np.append(0, ends[:-1]), ends):
            cuts = borders.get(names[int(code[lo])].as_py())
            inner = np.searchsorted(key[lo:hi], cuts) + lo if cuts is not None else np.empty(0, dtype=np.int64)
            edges = [lo, *inner, hi]
            for r, (a, b) in enumerate(zip(edges, edges[1:])):
                if a < b:
                    once = (count[a:b] == 1).all()
                    for column, v in zip(out, (code[lo], r, planes(key[a:b]), planes(cls[a:b]), b"" if once else planes(count[a:b]))):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()),
                                          *[pa.array(c, pa.binary()) for c in out[2:]]], ["feature", "range", "keys", "classes", "counts"])

    schema = T.StructType([T.StructField("feature", kind), T.StructField("range", T.IntegerType()),
                           *[T.StructField(c, T.BinaryType()) for c in ("keys", "classes", "counts")]])
    return long.select("feature", F.col("value").cast("double").alias("value"), F.col("label").cast("bigint").alias("label")) \
        .where("feature is not null").mapInArrow(pack, schema)


def places(qs: list, total: Column) -> Column:
    """Positions (from 0) between which each quantile lies, ascending and without repeats."""
    low = F.transform(F.lit([float(q) for q in qs]), lambda q: F.floor(q * (total - 1)))
    return F.array_sort(F.array_distinct(F.concat(low, F.transform(low, lambda k: F.least(k + 1, total - 1)))))


def hit(at: str, value: str, before: Column, n: Column) -> Column:
    """What a row contributes to the quantiles: its value and those of the positions ``at`` that it holds; null for nearly all rows."""
    held = F.filter(at, lambda k: (before <= k) & (k < before + n))
    return F.when(F.size(held) > 0, F.struct(F.col(value).alias("v"), held.alias("k")))


def at_quantiles(hits: Column, qs: list, total: Column) -> Column:
    """Quantiles with linear interpolation from the collected hits of a group."""
    def value(k):
        return F.get(F.filter(hits, lambda h: F.array_contains(h["k"], k)), F.lit(0))["v"]

    def between(q):
        place = q * (total - 1)
        low = value(F.floor(place))
        return low + (value(F.least(F.floor(place) + 1, total - 1)) - low) * (place - F.floor(place))

    return F.transform(F.lit([float(q) for q in qs]), between)


def quantiles(ordered: DataFrame, group: list, qs: list, value: str = "value", name: str = "q") -> DataFrame:
    """Exact quantiles with linear interpolation as one array column per group."""
    # Every row knows the total, so it tells by itself whether it holds a wanted position; only such rows are grouped.
    rows = ordered.select(*group, value, "before", "n", F.col("total").alias("_t")).withColumn("_at", places(qs, F.col("_t")))
    got = rows.withColumn("_h", hit("_at", value, F.col("before"), F.col("n"))).where("_h is not null").groupBy(*group).agg(
        F.first("_t").alias("_t"), F.collect_list("_h").alias("_h"))
    return got.select(*group, at_quantiles(F.col("_h"), qs, F.col("_t")).alias(name))


def value_counts(df: DataFrame, group: list, value: str = "value", *more: Column) -> DataFrame:
    return df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), *more)
