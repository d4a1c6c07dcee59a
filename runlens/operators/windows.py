"""Order-dependent operators that never need a whole run in one task.

Every run is addressed by a dense position ``t`` and cut into blocks of a fixed number of
positions. Neighbouring samples across a block border are copied (halo), so a window over
(run, block) sees at most ``block + halo`` rows however long the run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import BLOCK, FAULT, KEYS, SAMPLE



def block_column(block: int) -> str:
    """Name of the block number column; rows that carry it are already placed by (run, block)."""
    return f"blk_{block}"


def unplaced(df: DataFrame) -> DataFrame:
    """Without block numbers, which no longer hold once positions change."""
    return df.drop(*[c for c in df.columns if c.startswith("blk_")])


def with_position(df: DataFrame, keys=KEYS, order=(SAMPLE,), block: Column | None = None,
                  name: str = "t") -> DataFrame:
    """0-based position within each run, for any run length.

    ``block`` must grow with ``order``; rows are numbered inside (run, block) and shifted by the
    number of rows in earlier blocks, so only the small block counts meet per run.
    """
    keys, order = list(keys), list(order)
    block = F.expr(f"{SAMPLE} div {BLOCK}") if block is None else block
    rows = unplaced(df).withColumn("_pb", block)
    counts = rows.groupBy(*keys, "_pb").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_pb").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_pb", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(W.partitionBy(*keys, "_pb").orderBy(*order)) - F.lit(1)
    return (rows.withColumn("_i", inside).join(offsets, [*keys, "_pb"])
            .withColumn(name, (F.col("_o") + F.col("_i")).cast("bigint"))
            .drop("_pb", "_i", "_o"))


def dense_position(df: DataFrame, first: Column, name: str = "t") -> DataFrame:
    """Position by arithmetic where sample numbers have no gaps (see ``run_table`` for the check)."""
    return unplaced(df).withColumn(name, (F.col(SAMPLE) - first).cast("bigint"))


def run_table(df: DataFrame, keys=KEYS) -> DataFrame:
    """One row per run: length, last position and whether the sample numbers are gap-free."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("t").alias("last_t"),
        (F.max(SAMPLE) - F.min(SAMPLE) + 1 == F.count(F.lit(1))).alias("gap_free"))


def attach_per_run(rows: DataFrame, per_run: DataFrame, keys=KEYS, block: int = BLOCK,
                   last: str = "last_t") -> DataFrame:
    """Join run-level values to samples without gathering a long run in one partition.

    The run-level side is repeated once per block of its run (``last_t`` tells how many), and both
    sides meet on (run, block). The block column stays on the rows: samples that a window or an
    earlier join has placed by (run, block) are not shuffled again.
    """
    blk = block_column(block)
    side = (per_run.withColumn(blk, F.explode_outer(F.expr(f"sequence(0L, cast({last} as bigint) div {block})")))
            .drop(last))
    placed = rows if blk in rows.columns else rows.withColumn(blk, F.expr(f"t div {block}"))
    return placed.join(side, [*keys, blk])


def with_halo(df: DataFrame, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Assign every row to its block and copy rows near a border to the neighbouring block."""
    first, last = F.expr(f"greatest(t - {after}, 0L) div {block}"), F.expr(f"(t + {before}) div {block}")
    return df.withColumn(block_column(block), F.explode_outer(F.sequence(first, last)))


def with_neighbours(df: DataFrame, wanted: dict, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """Add columns holding another sample of the same run: ``{name: (column, offset)}``.

    Offset -1 is the previous sample, +1 the next one; null beyond the ends of the run.
    """
    before = max([0] + [-o for _, o in wanted.values()])
    after = max([0] + [o for _, o in wanted.values()])
    blk = block_column(block)
    w = W.partitionBy(*keys, blk).orderBy("t")
    rows = with_halo(df, before, after, block)
    rows = rows.withColumns({name: F.lag(c, -o).over(w) for name, (c, o) in wanted.items()})
    return rows.where(F.col(blk) == F.expr(f"t div {block}"))


def head_per_run(df: DataFrame, fault0: int | None, faulty: int | None) -> DataFrame:
    """First samples of each run, with a limit of its own for the fault-free class."""
    limit = F.when(F.col(FAULT) == 0, F.lit(fault0)).otherwise(F.lit(faulty)).cast("bigint")
    return df.where(limit.isNull() | (F.col("t") < limit))


def fixed_length(df: DataFrame, length: int, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """Cut every run to ``length`` samples; a run that lacks any of the positions 0..length-1 stops the job."""
    lengths = df.groupBy(*keys).agg(F.count_if(F.col("t").between(0, length - 1)).alias("_n"))
    checked = lengths.select(
        *keys,
        F.when(F.col("_n") == length, F.lit(length - 1)).otherwise(
            F.raise_error(F.concat(F.lit("run shorter than the fixed length or with gaps: "),
                                   F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
            .cast("int")).alias("_last"))
    kept = df.where(F.col("t") < length)
    return (attach_per_run(kept, checked, keys, block, last="_last"))


def require_gap_free(df: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    """The same rows; a run whose positions are not 0..n-1, each once, stops the job."""
    runs = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("t").alias("_f"), F.max("t").alias("_m"))
    good = (F.col("_f") == 0) & (F.col("_m") == F.col("_n") - 1)
    last = F.when(good, F.col("_m")).otherwise(F.raise_error(F.concat(
        F.lit("run with gaps: "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]))).cast("bigint"))
    return attach_per_run(df, runs.select(*keys, last.alias("_last")), keys, block, last="_last")


def min_samples(df: DataFrame, minimum: int, keys=KEYS, block: int = BLOCK):
    """Split into (rows of long enough runs, run table with status)."""
    runs = run_table(df, keys).withColumn(
        "status", F.when(F.col("n") < minimum, F.lit("skipped")).otherwise(F.lit("ok")))
    good = runs.where("status = 'ok'").select(*keys, "last_t")
    return attach_per_run(df, good, keys, block), runs


def lag_stack(df: DataFrame, lags: int, x: str = "x", keys=KEYS, block: int = BLOCK) -> DataFrame:
    """x_t becomes [x_t, x_(t-1), .., x_(t-lags)]; the first ``lags`` rows have no full stack."""
    names = {f"_l{i}": (x, -i) for i in range(1, lags + 1)}
    rows = with_neighbours(df, names, keys, block).where(F.col("t") >= lags)
    return rows.withColumn(x, F.concat(F.col(x), *names)).drop(*names)


def past_future_stack(df: DataFrame, past: int, future: int, x: str = "x", keys=KEYS,
                      block: int = BLOCK) -> DataFrame:
    """Columns ``p`` = [x_(t-1)..x_(t-past)] and ``f`` = [x_t..x_(t+future-1)], complete rows only."""
    names = {f"_p{i}": (x, -i) for i in range(1, past + 1)}
    names |= {f"_f{i}": (x, i) for i in range(1, future)}
    rows = with_neighbours(df, names, keys, block)
    rows = rows.where((F.col("t") >= past) & F.col(f"_f{future - 1}" if future > 1 else x).isNotNull())
    p = F.concat(*[F.col(f"_p{i}") for i in range(1, past + 1)])
    f = F.concat(F.col(x), *[F.col(f"_f{i}") for i in range(1, future)])
    return rows.withColumns({"p": p, "f": f}).drop(*names)


def derivative(df: DataFrame, x: str = "x", out: str = "dx", keys=KEYS, block: int = BLOCK) -> DataFrame:
    """Time derivative: central differences inside a run, one-sided at its two ends."""
    rows = with_neighbours(df, {"_a": (x, -1), "_b": (x, 1)}, keys, block)
    left = F.coalesce("_a", x)
    right = F.coalesce("_b", x)
    steps = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.lit(2.0)).otherwise(F.lit(1.0))
    return rows.withColumn("_s", steps).withColumn(
        out, F.zip_with(right, left, lambda b, a: (b - a) / F.col("_s"))).drop("_a", "_b", "_s")
