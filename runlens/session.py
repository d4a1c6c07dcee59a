"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


FOLDERS: list = []
#: Jobs of one step that the driver submits at the same time.
SIDE_BY_SIDE = 4


def build_session(name: str = "runlens", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Feature batches are small in bytes and heavy in work: keep them spread over the cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints of earlier steps go as soon as nothing refers to them.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_session(name: str = "runlens-local", cores: int | str = 8) -> SparkSession:
    return build_session(
        name,
        f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.execution.pythonUDF.arrow.enabled": "true",
        },
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints, taken from the session; a local session may get its own."""
    context = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        own = tempfile.TemporaryDirectory(prefix="runlens-checkpoint-", ignore_cleanup_errors=True)
        FOLDERS.append(own)  # removed when the interpreter ends
        current = own.name
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs go on from stored rows when an executor is lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Shuffle files of finished steps go: Spark deletes them when the driver collects the plans they belong to, and a driver with
    little to do hardly ever collects by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def side_by_side(spark: SparkSession, job: Callable, items) -> list:
    """Results of ``job`` for every item, in their order. The jobs are independent of each other and small ones leave most cores
    idle, so that a few of them are submitted at a time."""
    items = list(items)
    if len(items) < 2:
        return [job(item) for item in items]
    with ThreadPoolExecutor(min(len(items), SIDE_BY_SIDE)) as pool:
        # Wrapped one by one: every thread needs local properties of its own.
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(job), item) for item in items]]
