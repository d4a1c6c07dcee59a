"""Reading labelled runs and preparing them for the two job families."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep, windows
from ..schema import BLOCK, CHANNELS, CUTOFF, FILES, KEYS, known, sample_schema


def read_runs(spark: SparkSession, path, channels=CHANNELS, runs_per_fault: int | None = None,
              fmt: str | None = None) -> DataFrame:
    """Samples of one or several files as keys plus channel array.

    The file must hold the three key columns and all channels; only these are read. CSV files are
    read by header so that extra columns (such as a written index) do no harm.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or (PurePosixPath(paths[0]).suffix.lstrip(".") or "parquet")
    schema = sample_schema(channels)
    if fmt == "csv":
        raw = spark.read.option("header", True).option("enforceSchema", True).csv(paths)
    else:
        raw = spark.read.format(fmt).load(paths)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"columns missing in {paths}: {missing[:5]}")
    typed = raw.select(*[raw[f.name].cast("double").cast(f.dataType).alias(f.name) for f in schema])
    return prep.first_runs(prep.as_arrays(typed, channels), runs_per_fault)


def read_split(spark: SparkSession, folder: str, split: str, channels=CHANNELS,
               runs_per_fault: int | None = None) -> DataFrame:
    """Fault-free and faulty file of one split, read lazily and put together."""
    normal, faulty = (f"{folder.rstrip('/')}/{name}" for name in FILES[split])
    return prep.merge_faults(read_runs(spark, normal, channels, runs_per_fault),
                             read_runs(spark, faulty, channels, runs_per_fault))


def prepare_runs(df: DataFrame, split: str = "train", cutoff: int | None = None, uniform: bool = True,
                 length: int | None = 480, dense: bool = False, block: int = BLOCK, shorter: str = "stop") -> DataFrame:
    """Cut the pre-fault part, number the samples from 0 and cut to one length.

    A run with fewer samples than ``length`` stops the job; with ``shorter="keep"`` it stays, with the samples it has.

    Samples are numbered by position. ``dense`` takes the sample numbers themselves, which saves the numbering shuffle;
    a run that turns out to have gaps then stops the job.
    """
    known(shorter, ("stop", "keep"), "treatment of shorter runs")
    cutoff = CUTOFF[split] if cutoff is None else cutoff
    kept = prep.drop_pre_fault(df, cutoff, uniform)
    rows = (windows.dense_position(kept, prep.first_sample(cutoff, uniform)) if dense
            else windows.with_position(kept))
    if length is not None and shorter == "stop":
        return windows.fixed_length(rows, length, KEYS, block)
    rows = windows.require_gap_free(rows, KEYS, block) if dense else rows
    return rows if length is None else rows.where(F.col("t") < length)
