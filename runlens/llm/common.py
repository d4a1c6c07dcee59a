"""Shared helpers of the text operators: words, stored tables, row shapes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from runlens.session import checkpoint_dir

#: Words of the text operators: runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: Rows handled at once inside Python tasks, and the text they may hold; both only bound memory.
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20

#: Everything but lower-case letters, digits and bytes of non-ASCII characters separates words; A-Z are lowered.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
             for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def stored_path(spark: SparkSession, label: str) -> str:
    """A new folder in the shared checkpoint folder, deleted when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/runlens-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, label: str, rows: int | None = None, per_file: int = 1 << 18) -> DataFrame:
    """Write `df` to the shared folder and read it back: later steps neither recompute it nor lose it with an executor.

    `rows`, an upper bound of its rows, gives small tables few files; the work before keeps its own partitions."""
    spark = df.sparkSession
    path = stored_path(spark, label)
    if rows is not None:
        df = df.repartition(max(1, -(-rows // per_file)))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of text that one Arrow batch may hold; a table of long texts would else fill an executor's memory.
BATCH_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_ROWS rows (the session's setting is lowered to that, never raised)."""
    conf = df.sparkSession.conf
    now = int(conf.get(ARROW_ROWS))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(ARROW_ROWS, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


#: Rows of a few numbers that may be broadcast (some 30 MB as a hash table); beyond it the join shuffles.
BROADCAST_ROWS = 1 << 19


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored, narrow table after counting it; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def extended(schema: StructType, columns) -> StructType:
    """`schema` and further (name, type) columns, for operators that add columns to every row."""
    return StructType([*schema.fields, *DataType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in columns)).fields])


def slices(batch, column: str = "text"):
    """Cut an Arrow batch into pieces of bounded rows and bytes, so that Python objects stay small."""
    at, sizes = 0, batch.column(batch.schema.get_field_index(column))
    lengths = [0 if v is None else v for v in _lengths(sizes)]
    while at < batch.num_rows:
        end, held = at, 0
        while end < batch.num_rows and end - at < SLICE_ROWS and (end == at or held + lengths[end] <= SLICE_BYTES):
            held += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


def _lengths(array):
    import pyarrow.compute as pc

    return pc.binary_length(array).to_pylist()
