"""Frames that several steps read: written once to the folder that all executors share, and read back."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame


def once(df: DataFrame) -> DataFrame:
    """``df`` as a table below ``spark.checkpoint.dir``, deleted when the driver ends; on one machine a local folder will do.

    Steps that use matches several times then read a small table instead of searching all sentences again,
    and a lost executor costs only the files it was reading.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints/tsuzuri"
    path = f"{base.rstrip('/')}/once-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
