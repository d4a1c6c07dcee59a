"""Time-series features of every (run, channel).

Samples move once: rows are grouped by (run, block) and turned into one value array per channel.
Statistics that need no order come from a map-side aggregation and are joined to the blocks on
(run, block), where the arrays already are. Order-dependent families are additive sums per block
(Arrow batches). For runs of one block everything after that shuffle is a row expression; longer runs sum their
block results, and take quantiles and repeated values from value counts. The few calculators that need a series in one
piece are defined for series of one block. Only what the requested features need is computed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import names as fn
from ..functions import partials as pt
from ..functions.kernels import KERNELS, series_features
from ..functions.spectral_sums import CELL_EDGES, most_lags
from ..schema import BLOCK, KEYS
from ..session import cut_lineage
from . import feature_sql as fs
from .values import at_quantiles, hit, ordered_counts, places, salted_join, value_counts
from .windows import block_column, with_halo

# Series whose block sums are held at once: the widest families have thousands of values.
SLICE = 256
BLK = "blk"
TOKEN = re.compile(r"[a-z_][a-z_0-9]*", re.IGNORECASE)
SUM_STATS = ("n", "mu", "var", "mn", "mx", "sa", "ss", "rv")


def _tokens(texts) -> set:
    return set().union(*[TOKEN.findall(t) for t in texts]) if texts else set()


def _needed(texts, table: dict) -> list:
    """Names of ``table`` used directly or through other entries, in table order."""
    want = _tokens(texts)
    for name in reversed(list(table)):
        if name in want:
            want |= _tokens([table[name][0] if isinstance(table[name], tuple) else table[name]])
    return [name for name in table if name in want]


class Plan:
    """What a list of features needs: native formulas, additive families, calculators of one piece.

    ``longest`` bounds the length of the series: neighbouring blocks lend as many samples as its unit-root regression has lags."""

    def __init__(self, features, longest: int = BLOCK):
        features = list(dict.fromkeys(features))
        finals = {f: fs.final(f) for f in features}
        self.native = [f for f in features if finals[f] is not None]
        rest = [f for f in features if finals[f] is None]
        self.summed = [f for f in rest if f.calculator in pt.FAMILY and pt.supported(f) or f.calculator == "linear_trend"]
        self.kernel = [f for f in rest if f.calculator in KERNELS]
        unknown = [f.suffix for f in rest if f not in self.summed and f not in self.kernel]
        if unknown:
            raise ValueError(f"unknown calculators: {unknown[:5]}")
        self.order = self.native + self.summed + self.kernel
        self.families = pt.in_order(dict.fromkeys(pt.FAMILY[f.calculator] for f in self.summed if f.calculator in pt.FAMILY))
        texts = [finals[f] for f in self.native]
        self.partial = {k: fs.NATIVE[k] for k in _needed(texts, fs.NATIVE)}
        inner = texts + [sql for sql, _ in self.partial.values()] + (["qs"] if "corridor" in self.families else []) + (
            ["dq"] if "drift" in self.families else [])
        self.whole = _needed(inner, fs.WHOLE)
        used = _tokens(inner + [fs.WHOLE[k] for k in self.whole])
        if self.summed:
            used |= set(SUM_STATS)
        self.plain = [k for k in fs.PLAIN if k in used or k in ("n", "mu", "var", "mn", "mx")]
        self.blocks = bool(self.partial or self.whole or self.kernel or self.families or self.summed)
        self.halo = pt.halo(self.families, max(0, most_lags(longest)) if "adf" in self.families else 0)
        self.finals = finals
        self.groups: list = []
        for f in self.kernel:
            if not self.groups or self.groups[-1][0] != f.calculator:
                self.groups.append((f.calculator, []))
            self.groups[-1][1].append(dict(f.params))

    @property
    def public(self) -> list:
        return [k for k in self.whole if k not in ("revals", "repoints", "sp")]


def plain_stats(long: DataFrame, wanted, keys) -> DataFrame:
    """Order-free statistics per (run, channel); partial sums are formed before the shuffle."""
    return long.groupBy(*keys, "channel").agg(*[F.expr(fs.PLAIN[k]).alias(k) for k in wanted],
                                              F.max("t").alias("last_t"))


def block_rows(rows: DataFrame, stats: DataFrame, plan: Plan, width: int, keys, block: int) -> DataFrame:
    """One row per (run, block, channel): value arrays next to the series statistics."""
    halo = with_halo(rows, *plan.halo, block).withColumnRenamed(block_column(block), BLK)
    got = halo.groupBy(*keys, BLK).agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("arr"))
    per_run = stats.groupBy(*keys).agg(
        F.max("last_t").alias("_last"), F.sort_array(F.collect_list(F.struct("channel", *plan.plain))).alias("st"))
    side = per_run.withColumn(BLK, F.explode_outer(F.expr(f"sequence(0L, _last div {block})"))).drop("_last")
    both = got.join(side, [*keys, BLK]).withColumns({
        "t0": F.col(BLK) * block,
        "o": F.expr(f"size(filter(arr, e -> e.t < {BLK} * {block}))"),
        "m": F.expr(f"size(filter(arr, e -> e.t div {block} = {BLK}))")})
    split = F.expr(f"zip_with(transform(sequence(0, {width - 1}), c -> transform(arr, e -> e.x[c])), st, "
                   "(v, q) -> named_struct('a', v, 'q', q))")
    flat = both.select(*keys, BLK, "t0", "o", "m", F.explode_outer(split).alias("z")).select(
        *keys, BLK, "t0", "o", "m", "z.a", "z.q.*")
    return flat.withColumn("w", F.slice("a", F.col("o") + 1, F.col("m")) if any(plan.halo) else F.col("a"))


def long_values(rows: DataFrame, keys, drift: bool = False) -> DataFrame:
    """Quantiles and repeated values of series with several blocks, from value counts; with ``drift`` also the borders of
    the drift cells, quantiles of all values but the last one. One ordering serves them all."""
    group = [*keys, "channel"]
    counts = value_counts(rows.select(*group, F.explode_outer("w").alias("value")), group)
    ordered = ordered_counts(counts, group)
    # One row per series: its length, last value, and the positions of its quantiles.
    ends = rows.where(F.col("t0") + F.col("m") == F.col("n")).select(
        *group, F.col("n").cast("bigint").alias("_t"), F.element_at("w", -1).alias("_last"))
    ends = ends.withColumn("_at", places(list(pt.PROBS), F.col("_t")))
    if drift:
        ends = ends.withColumn("_dat", places(list(CELL_EDGES), F.col("_t") - 1))
    ordered = salted_join(ordered, ends, group, F.col("value"))
    repeated, n, before = F.col("n") > 1, F.col("n"), F.col("before")
    hits = {"_q": hit("_at", "value", before, n)}
    aggs = [F.first("_t").alias("_t"), F.collect_list("_q").alias("_q"),
            F.count(F.lit(1)).alias("ndist"), F.sum(repeated.cast("bigint")).alias("nreval"),
            F.sum(F.when(repeated, n).otherwise(0)).alias("nrepoint"),
            F.sum(F.when(repeated, F.col("value")).otherwise(0.0)).alias("sreval"),
            F.sum(F.when(repeated, F.col("value") * n).otherwise(0.0)).alias("srepoint")]
    out = [at_quantiles(F.col("_q"), list(pt.PROBS), F.col("_t")).alias("qs")]
    if drift:
        # Without the last value: its count is one less, and one row less stands before the larger values.
        hits["_d"] = hit("_dat", "value", before - (F.col("value") > F.col("_last")).cast("bigint"),
                         n - (F.col("value") == F.col("_last")).cast("bigint"))
        aggs.append(F.collect_list("_d").alias("_d"))
        out.append(at_quantiles(F.col("_d"), list(CELL_EDGES), F.col("_t") - 1).alias("dq"))
    got = ordered.withColumns(hits).groupBy(*group).agg(*aggs)
    return got.select(*group, "ndist", "nreval", "nrepoint", "sreval", "srepoint", *out)


def mass_before(rows: DataFrame, keys) -> DataFrame:
    """Sum of |x| in earlier blocks of the series; one number per block."""
    sums = rows.select(*keys, "channel", BLK, F.expr(fs.total("transform(w, e -> abs(e))")).alias("_s"))
    w = W.partitionBy(*keys, "channel").orderBy(BLK).rowsBetween(W.unboundedPreceding, -1)
    return sums.select(*keys, "channel", BLK, F.coalesce(F.sum("_s").over(w), F.lit(0.0)).alias("base"))


FOLD = ("aggregate({col}, named_struct('cur', 0L, 'best', 0L, 'pre', 0L, 'open', true), (p, q) -> named_struct("
        "'cur', if(q.open, p.cur + q.cur, q.cur), "
        "'best', greatest(p.best, q.best, p.cur + q.pre), "
        "'pre', if(p.open, p.pre + q.pre, p.pre), "
        "'open', p.open and q.open))")
GROUP_OF_BLOCKS = 1024


def merge_blocks(rows: DataFrame, plan: Plan, keys) -> DataFrame:
    """Combine block results per series in two levels, so no task sees all blocks of a long series."""
    group = [*keys, "channel"]
    carried = [*plan.plain, *plan.public]

    def level(df, by, order):
        aggs = [F.first(c).alias(c) for c in carried] + [F.min(order).alias("_ord")]
        for k, (_, how) in plan.partial.items():
            if how in ("min", "max"):
                aggs.append(getattr(F, how)(k).alias(k))
            elif how == "top":
                aggs.append(F.slice(F.sort_array(F.flatten(F.collect_list(k)), False), 1, 7).alias(k))
            else:
                aggs.append(F.sort_array(F.collect_list(F.struct(F.col(order).alias("b"), F.col(k).alias("v")))).alias(k))
        out = df.groupBy(*by).agg(*aggs)
        folds = {k: F.expr(FOLD.format(col=f"transform({k}, e -> e.v)"))
                 for k, (_, how) in plan.partial.items() if how == "strike"}
        return out.withColumns(folds) if folds else out

    first = level(rows.withColumn("_g", F.expr(f"{BLK} div {GROUP_OF_BLOCKS}")), [*group, "_g"], BLK)
    return level(first, group, "_ord").drop("_ord")


def _vector(v):
    return np.asarray(v, dtype=float)


def _stats_frame(s: pd.DataFrame) -> dict:
    return {k: s[k].to_numpy(dtype=float) for k in SUM_STATS}


def _sums_of(s: pd.DataFrame, families) -> list:
    """The vector of every block row."""
    return [pt.block_sums(families, _vector(r.a), int(r.o), int(r.m), int(r.t0), int(r.n), r.mu, r.var, r.mn, r.mx, r.sa,
                          r.base, r.qs, r.dq) for r in s.itertuples(index=False)]


def _slices(n: int):
    return [slice(at, at + SLICE) for at in range(0, n, SLICE)]


# Bytes of vectors that a task holds before it passes them on, and map tasks whose vectors of a series meet first.
HELD_BYTES = 64 << 20
TASKS_PER_GROUP = 128


def series_sums(blocks: DataFrame, families, keys) -> DataFrame:
    """Per series the total of its block vectors (column ``sums``): added up inside the task that computes them, then
    over groups of tasks, then over all of them; one vector per task and series is all that moves."""
    group = [*keys, "channel"]
    types = {f.name: f.dataType.simpleString() for f in blocks.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in group) + ", sums array<double>"

    def out(held):
        return pd.DataFrame([(*k, v) for k, v in held.items()], columns=[*group, "sums"])

    def add(held, key, row):
        if key in held:
            held[key] += row
        else:
            held[key] = row

    def partial(frames):
        held, size = {}, 0
        for pdf in frames:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at:at + SLICE]
                for key, row in zip(part[group].itertuples(index=False, name=None), _sums_of(part, families)):
                    size += 0 if key in held else row.nbytes
                    add(held, key, row)
                if size > HELD_BYTES:
                    yield out(held)
                    held, size = {}, 0
        if held:
            yield out(held)

    def combine(frames):
        key, total = None, None
        for pdf in frames:
            ready = {}
            for k, v in zip(pdf[group].itertuples(index=False, name=None), pdf["sums"]):
                if k == key:
                    total = total + v
                    continue
                if key is not None:
                    ready[key] = total
                key, total = k, np.array(v)
            if ready:
                yield out(ready)
        if key is not None:
            yield out({key: total})

    got = blocks.select(*group, *INPUTS).mapInPandas(partial, schema)
    near = got.withColumn("_g", F.expr(f"spark_partition_id() div {TASKS_PER_GROUP}")).repartition(*group, "_g") \
        .sortWithinPartitions(*group, "_g").drop("_g").mapInPandas(combine, schema)
    return near.repartition(*group).sortWithinPartitions(*group).mapInPandas(combine, schema)


def finish_udf(features, families):
    """Features from summed values; a task holds those of one slice of series at a time."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for sums, s in batches:
            for at in _slices(len(s)):
                yield pd.Series(list(pt.finish(features, families, [_vector(x) for x in sums.iloc[at]], _stats_frame(s.iloc[at]))))
    return run


def one_block_udf(features, families, groups):
    """Summed features and calculators of one piece for series that fit one block, in one pass; a task holds those of one
    slice of series at a time, however many series an Arrow batch has."""
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for s in batches:
            for at in _slices(len(s)):
                part = s.iloc[at]
                got = pt.finish(features, families, _sums_of(part, families), _stats_frame(part)) if features else \
                    np.empty((len(part), 0))
                yield pd.Series(list(got) if not groups else [np.concatenate([g, series_features(_vector(a)[o:o + m], groups)])
                                                              for g, a, o, m in zip(got, part["a"], part["o"], part["m"])])
    return run


#: What the block sums read, in this order.
INPUTS = ["a", "o", "m", "t0", *SUM_STATS, "base", "qs", "dq"]


def with_inputs(df: DataFrame) -> DataFrame:
    """Adds the inputs of the block sums that a plan left out."""
    extra = {"base": F.lit(0.0), "qs": F.array(), "dq": F.array(), **{k: F.lit(0.0) for k in SUM_STATS}}
    return df.withColumns({c: e.cast("array<double>" if c in ("qs", "dq") else "double")
                           for c, e in extra.items() if c not in df.columns})


def extract_wide(rows: DataFrame, channels: list, features, keys=KEYS, block: int = BLOCK,
                 long_runs: bool | None = None) -> tuple:
    """(frame with keys, channel and array ``values``; feature list in array order).

    ``rows`` has keys, t and x (one entry per channel). ``long_runs=False`` states that no run exceeds
    one block (a fixed length does that; a longer run stops the job); None looks at the longest run first.
    """
    keys, group = list(keys), [*keys, "channel"]
    rows = rows.select(*keys, "t", "x")
    longest = block
    if long_runs is not False and Plan(features).blocks:
        longest = max(block, (rows.agg(F.max("t")).first()[0] or 0) + 1)
    plan = Plan(features, longest)
    stats = plain_stats(rows.select(*keys, "t", F.posexplode_outer("x").alias("channel", "v")), plan.plain, keys)
    native = F.array(*[F.expr(plan.finals[f]).cast("double") for f in plan.native])
    if not plan.blocks:
        return stats.select(*group, native.alias("values")), plan.order
    if long_runs is None:
        long_runs = longest > block
    base = block_rows(rows, stats, plan, len(channels), keys, block)
    if long_runs:  # several readers below: the gathered blocks are stored once
        base = cut_lineage(base)
    fits = F.col("n") == F.col("m")
    short = base.where(fits if long_runs else fits | F.raise_error(F.lit("a run exceeds one block")).cast("boolean"))
    table = short.withColumn("sw", F.expr("array_sort(w)")) if plan.whole else short
    for k in plan.whole:
        table = table.withColumn(k, F.expr(fs.WHOLE[k]))
    table = table.withColumns({k: F.expr(sql) for k, (sql, _) in plan.partial.items()}) if plan.partial else table
    parts = [native] if plan.native else []
    if plan.summed or plan.kernel:
        table = with_inputs(table)
        parts.append(one_block_udf(plan.summed, plan.families, plan.groups)(F.struct(*INPUTS)))
    values = F.concat(*parts) if len(parts) > 1 else parts[0]
    out = table.select(*group, values.alias("values"))
    if long_runs:
        out = out.unionByName(_long_part(base.where(F.col("n") > F.col("m")), plan, native, keys))
    return out, plan.order


def _long_part(far: DataFrame, plan: Plan, native: Column, keys) -> DataFrame:
    """The same values for series of several blocks: merged block results and value counts."""
    group = [*keys, "channel"]
    table = far.join(long_values(far, keys, "dq" in plan.whole).select(*group, *plan.public), group) if plan.whole else far
    if "mass" in plan.families:
        table = table.join(mass_before(far, keys), [*group, BLK])
    if plan.partial:
        table = table.withColumns({k: F.expr(sql) for k, (sql, _) in plan.partial.items()})
    done = merge_blocks(table, plan, keys)
    if plan.families:
        done = done.join(series_sums(with_inputs(table), plan.families, keys), group)
    parts = [native] if plan.native else []
    if plan.summed:
        sums = F.col("sums") if plan.families else F.array().cast("array<double>")
        parts.append(finish_udf(plan.summed, plan.families)(sums, F.struct(*[F.col(k) for k in SUM_STATS])))
    if plan.kernel:
        names = sorted({f.calculator for f in plan.kernel})
        parts.append(F.array(F.raise_error(F.lit(f"a series is longer than one block; not defined for it: {names}")).cast("double")))
    values = F.concat(*parts) if len(parts) > 1 else parts[0]
    return done.select(*group, values.alias("values"))


def extract_features(rows: DataFrame, channels: list, features="additive", keys=KEYS, block: int = BLOCK,
                     long_runs: bool | None = None) -> DataFrame:
    """Long result: keys, feature (full name), value (null where undefined)."""
    wanted = fn.SETS[features]() if isinstance(features, str) else list(features)
    wide, order = extract_wide(rows, channels, wanted, keys, block, long_runs)
    suffix = F.lit([f.suffix for f in order])
    label = F.lit(list(channels))
    cells = wide.select(*keys, "channel", F.posexplode_outer("values").alias("i", "value"))
    name = F.concat_ws("__", label[F.col("channel")], suffix[F.col("i")])
    value = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value"))
    return cells.select(*keys, name.alias("feature"), value.alias("value"))


def extract_selected(rows: DataFrame, channels: list, selected, keys=KEYS, block: int = BLOCK,
                     long_runs: bool | None = None) -> DataFrame:
    """Only the named features: channels and calculators nobody asked for are never computed.

    Channels that want the same calculators are extracted together; a channel with a list of its own gets its own pass.
    """
    wanted = fn.by_channel(selected)
    keep = [c for c in channels if c in wanted]
    if not keep:
        raise ValueError("none of the selected features belongs to a channel of these runs")
    alike: dict = {}
    for c in keep:
        alike.setdefault(tuple(sorted(wanted[c], key=lambda f: f.suffix)), []).append(c)
    parts = []
    for features, names in alike.items():
        x = F.array(*[F.col("x")[list(channels).index(c)] for c in names])
        parts.append(extract_features(rows.withColumn("x", x), names, list(features), keys, block, long_runs))
    return reduce(DataFrame.unionByName, parts)
