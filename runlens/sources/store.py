"""Stored results: spectra, named tables keyed by all parameters, and resumable extraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spectra import method, wide_spectra
from ..schema import KEYS, SpectrumConfig, fingerprint
from ..session import release


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(spark: SparkSession, path: str) -> bool:
    """True for a completely written folder (any file system Spark can reach)."""
    p, fs = _path(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a stored folder, if it is there."""
    p, fs = _path(spark, path)
    fs.delete(p, True)


def spectra_path(base: str, cfg: SpectrumConfig, split: str) -> str:
    return f"{base}/method={cfg.method}/scaling={cfg.scaling_mode}/split={split}"


def csv_name(cfg: SpectrumConfig, split: str) -> str:
    suffix = "" if cfg.scaling_mode == "global_mean" else "_scaler"
    return f"{method(cfg.method).export.file}_{split}{suffix}.csv"


def write_spectra(spectra: DataFrame, base: str, cfg: SpectrumConfig, split: str) -> str:
    path = spectra_path(base, cfg, split)
    spectra.write.mode("overwrite").parquet(path)
    return path


def export_spectra(spectra: DataFrame, folder: str, cfg: SpectrumConfig, split: str, length: int) -> str:
    """Wide CSV folder under the established export name."""
    path = f"{folder}/{csv_name(cfg, split)}"
    wide_spectra(spectra, cfg, length).write.mode("overwrite").option("header", True).csv(path)
    return path


def read_spectra(spark: SparkSession, base: str, cfg: SpectrumConfig, split: str) -> DataFrame:
    path = spectra_path(base, cfg, split)
    if not stored(spark, path):
        raise FileNotFoundError(f"no spectra at {path}: run characterise() for {cfg.method!r} on {split!r} and store them")
    return spark.read.parquet(path)


def spectra_or_build(spark, base: str, cfg: SpectrumConfig, split: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Stored spectra if present, else computed and stored; input is only read in the second case."""
    if not stored(spark, spectra_path(base, cfg, split)):
        write_spectra(build(), base, cfg, split)
    return read_spectra(spark, base, cfg, split)


def materialise(spark: SparkSession, base: str, name: str, cfg, build: Callable[[], DataFrame], refit: bool = False,
                **extra) -> DataFrame:
    """A table that is computed once per set of parameters and read back from then on."""
    path = f"{base}/{name}/{fingerprint(cfg, **extra)}"
    if refit or not stored(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_bucket(buckets: int, keys=KEYS):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def extract_resumable(spark: SparkSession, rows: DataFrame | Callable[[], DataFrame], path: str, build: Callable[[DataFrame], DataFrame],
                      buckets: int = 64, per_wave: int = 16, keys=KEYS) -> DataFrame:
    """Run ``build`` over waves of run buckets; finished buckets are skipped after an interruption.

    The rows are computed once and stored by run bucket, so a wave reads its own buckets only and an interrupted job does not
    compute them again; they go when every bucket is done, shuffle files after every step. A wave writes its buckets in place (replacing what an
    interruption left) and marks them afterwards. ``build`` keeps the run keys. ``rows`` may be a function; it is called only
    when the stored rows are missing.
    """
    marks, source = f"{path}/_done", f"{path}/_rows"
    todo = [b for b in range(buckets) if not stored(spark, f"{marks}/{b}")]
    if todo and not stored(spark, source):
        given = rows() if callable(rows) else rows
        given.withColumn("run_bucket", run_bucket(buckets, keys)).write.mode("overwrite").partitionBy("run_bucket").parquet(source)
        del given
        release(spark)
    if todo and not _folders(spark, source):
        raise RuntimeError(f"no run to extract from for {path}")
    for lo in range(0, len(todo), per_wave):
        wave = todo[lo:lo + per_wave]
        part = build(wave_rows(spark, source, wave))
        marked = part.withColumn("run_bucket", run_bucket(buckets, keys))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_bucket").parquet(path)
        del part, marked
        release(spark)
        for b in wave:
            mark, fs = _path(spark, f"{marks}/{b}/_SUCCESS")
            fs.create(mark).close()
    if todo:
        drop(spark, source)
    filled = [f"{path}/run_bucket={b}" for b in range(buckets) if _has_rows(spark, f"{path}/run_bucket={b}")]
    if not filled:
        raise RuntimeError(f"no run produced a result under {path}")
    return spark.read.option("basePath", path).parquet(*filled)


def wave_rows(spark: SparkSession, source: str, wave: list) -> DataFrame:
    """Stored rows of some run buckets: only their folders are read."""
    return spark.read.parquet(source).where(F.col("run_bucket").isin([int(b) for b in wave])).drop("run_bucket")


def _folders(spark, path: str) -> list:
    p, fs = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]


def _has_rows(spark, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p) and any(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(p))
