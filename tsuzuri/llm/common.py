"""Shared helpers: table access, and tables kept in the folder that the whole cluster sees."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where shared tables go when a session on one machine names no folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tsuzuri"

#: Rows taken out of an Arrow batch at a time, so that few Python strings live at once.
SLICE = 128

#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20

#: Rows that a task's Parquet reader decodes at a time; it holds all their texts at once, in arrays of up to twice the size.
READ_ROWS = 256

#: Bytes of a row group of the tables between steps: what a task's Parquet writer gathers, and what its reader fetches at once.
GROUP_BYTES = 16 << 20


def read_few(spark: SparkSession) -> None:
    """Lower the session's Parquet batches to ``READ_ROWS`` where they are larger, as whole texts of the usual 4096 rows fill a small heap."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > READ_ROWS:
        spark.conf.set(name, READ_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    read_few(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Where the setting is unset, a session on one machine gets a local folder, and one on a cluster an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = LOCAL_SHARED
    path = f"{base.rstrip('/')}/tsuzuri-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    read_few(spark)
    path = shared_dir(spark)
    df.write.mode("errorifexists").option("parquet.block.size", GROUP_BYTES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with Arrow batches of ``BATCH_BYTES`` or one row, so that long texts take little memory at once.

    The session's own setting is lowered where it is larger, as Spark reads it when the query starts.
    """
    read_few(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(conf.get(name).rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def mix_hash(*cols: Column | str, salt: int = 0) -> Column:
    """A reproducible number in [0, 1) for each row."""
    h = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in cols], F.lit(salt))
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def shuffle_width(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spare(columns: Iterable[str], name: str) -> str:
    """``name``, lengthened until no column has it (in either case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def trim() -> None:
    """Give freed memory of a Python worker back to the machine, as workers live on for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
