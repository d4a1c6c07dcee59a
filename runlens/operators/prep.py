"""Row-level preparation: keys, cutoffs, scaling, imputation, sign rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BLOCK, FAULT, KEYS, RUN, SAMPLE
from .windows import attach_per_run


def as_arrays(df: DataFrame, channels) -> DataFrame:
    """Wide channel columns become one array column ``x``; only keys and channels are read."""
    return df.select(FAULT, RUN, SAMPLE, F.array(*[F.col(c).cast("double") for c in channels]).alias("x"))


def as_columns(df: DataFrame, channels) -> DataFrame:
    keep = [c for c in df.columns if c != "x"]
    return df.select(*keep, *[F.col("x")[i].alias(c) for i, c in enumerate(channels)])


def to_long(df: DataFrame, channels=None, keep=(*KEYS, "t")) -> DataFrame:
    """One row per sample and channel (narrow, no shuffle).

    The outer generator keeps the optimizer from adding a non-empty filter that would compute the array twice.
    """
    long = df.select(*keep, F.posexplode_outer("x").alias("channel", "v"))
    if channels is None:
        return long
    names = F.array(*[F.lit(c) for c in channels])
    return long.withColumn("channel", names[F.col("channel")])


def run_id(fault=FAULT, run=RUN) -> Column:
    """fault*1000 + run, the number people read; unique only below run 1000 (see ``run_key``)."""
    return (F.col(fault) * 1000 + F.col(run)).cast("int")


def label_of(run_id_column: str) -> Column:
    return F.expr(f"cast({run_id_column} div 1000 as int)")


def run_key(fault=FAULT, run=RUN) -> Column:
    """Both key columns in one BIGINT, the class in the upper and the run in the lower 32 bits: unique for all INT pairs.

    Tables that go by one run column (matrices, common runs, predictions) use this; ``run_id`` is for display.
    """
    return F.shiftleft(F.col(fault).cast("bigint"), 32).bitwiseOR(F.col(run).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def key_columns(df: DataFrame, key: str = "run_id") -> DataFrame:
    """The two key columns back from a ``run_key``."""
    return df.withColumns({FAULT: F.shiftright(F.col(key), 32).cast("int"),
                           RUN: F.shiftright(F.shiftleft(F.col(key), 32), 32).cast("int")})


def first_runs(df: DataFrame, k: int | None) -> DataFrame:
    return df if k is None else df.where(F.col(RUN) <= k)


def drop_pre_fault(df: DataFrame, cutoff: int, uniform: bool = False) -> DataFrame:
    """Drop samples before the fault sets in; ``uniform`` cuts the fault-free class as well."""
    late = F.col(SAMPLE) >= cutoff
    return df.where(late if uniform else (late | (F.col(FAULT) == 0)))


def first_sample(cutoff: int, uniform: bool = False) -> Column:
    """Number of the first sample that ``drop_pre_fault`` keeps."""
    return F.lit(cutoff) if uniform else F.when(F.col(FAULT) == 0, F.lit(1)).otherwise(F.lit(cutoff))


def merge_faults(fault_free: DataFrame, faulty: DataFrame) -> DataFrame:
    """Classes 0..20 in one frame. No global sort: order matters inside runs only."""
    return fault_free.unionByName(faulty)


@dataclass(frozen=True)
class Scaler:
    """Per-channel mean and population deviation of normal operation (two short lists)."""

    mean: tuple
    std: tuple


def channel_stats(df: DataFrame) -> DataFrame:
    """Per channel: mean and population deviation over all given samples, 0 replaced by 1."""
    std = F.stddev_pop("v")
    return df.select(F.posexplode_outer("x").alias("channel", "v")).groupBy("channel").agg(
        F.avg("v").alias("mean"), F.when(std == 0, F.lit(1.0)).otherwise(std).alias("std"))


def fit_scaler(df: DataFrame) -> Scaler:
    """Statistics of the fault-free samples; the driver receives one row per channel."""
    rows = sorted(channel_stats(df.where(F.col(FAULT) == 0)).collect(), key=lambda r: r["channel"])
    return Scaler(tuple(r["mean"] for r in rows), tuple(r["std"] for r in rows))


def scale_standard(df: DataFrame, scaler: Scaler, x: str = "x") -> DataFrame:
    mean, std = F.lit(list(scaler.mean)), F.lit(list(scaler.std))
    centred = F.zip_with(F.col(x), mean, lambda v, m: v - m)
    return df.withColumn(x, F.zip_with(centred, std, lambda v, s: v / s))


def run_means(df: DataFrame, keys=KEYS) -> DataFrame:
    """One scalar mean per run over all samples and channels."""
    row_mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return df.groupBy(*keys).agg(F.avg(row_mean).alias("_m"), F.max("t").alias("last_t"))


def scale_global_mean(df: DataFrame, keys=KEYS, block: int = BLOCK) -> DataFrame:
    rows = attach_per_run(df, run_means(df, keys), keys, block)
    return rows.withColumn("x", F.transform("x", lambda v: v - F.col("_m"))).drop("_m")


def scale(df: DataFrame, mode: str, scaler: Scaler | None = None, keys=KEYS, block: int = BLOCK) -> DataFrame:
    if mode == "scaler":
        if scaler is None:
            raise RuntimeError("scaling mode 'scaler' needs a fitted scaler")
        return scale_standard(df, scaler)
    if mode != "global_mean":
        raise ValueError(f"unknown scaling mode {mode!r}")
    return scale_global_mean(df, keys, block)


#: Channels whose signs are turned by one formula.
WRITTEN_OUT = 8


def channel_signs(df: DataFrame, width: int, keys=KEYS) -> DataFrame:
    """Per run the sign of the value of largest magnitude in each channel (earliest on ties, 0 → +1)."""
    peaks = [F.max(F.struct(F.abs(F.col("x")[i]).alias("a"), (-F.col("t")).alias("o"),
                            F.col("x")[i].alias("v"))).alias(f"_k{i}") for i in range(width)]
    signs = [F.when(F.col(f"_k{i}.v") < 0, F.lit(-1.0)).otherwise(F.lit(1.0)) for i in range(width)]
    return df.groupBy(*keys).agg(*peaks, F.max("t").alias("last_t")).select(
        *keys, "last_t", F.array(*signs).alias("_sign"))


def flip_signs(df: DataFrame, width: int, keys=KEYS, block: int = BLOCK) -> DataFrame:
    rows = attach_per_run(df, channel_signs(df, width, keys), keys, block)
    turned = F.zip_with("x", "_sign", lambda v, s: v * s + F.lit(0.0))
    if width <= WRITTEN_OUT:  # compiled, unlike array functions
        turned = F.array(*[F.col("x")[i] * F.col("_sign")[i] + F.lit(0.0) for i in range(width)])
    return rows.withColumn("x", turned).drop("_sign")


def nan_to_zero(column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def spectrum_transform(values, mode: str) -> Column:
    """Display scale of a spectrum: linear, log10 with a floor, or relative to the first value."""
    c = F.col(values) if isinstance(values, str) else values
    if mode == "linear":
        return c
    if mode == "log":
        return F.transform(c, lambda v: F.log10(F.greatest(v, F.lit(1e-12))))
    if mode == "relative":
        return F.when(c[0] <= 0, c).otherwise(F.transform(c, lambda v: v / F.nullif(c[0], F.lit(0.0))))
    raise ValueError(f"unknown mode {mode!r}")


def first_components(values, k: int) -> Column:
    return F.slice(values, 1, k)
