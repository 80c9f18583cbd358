"""What the operators share: reading tables, the shared folder, grouped Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a folder of our own where that is unset (tests)."""
    if where := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return where
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    where = tempfile.mkdtemp(prefix="shelfwise-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{where}")
    return f"file://{where}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and go on from the files: lineage ends here, and a lost executor costs nothing already written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/shelfwise/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written once, with the column __row: a number for each row, whatever other columns repeat or lack."""
    return written(df.withColumn("__row", F.monotonically_increasing_id()), name)


def give_back() -> None:
    """Return free memory to the system: Python workers live on after a task, and the next stage may need what this one has freed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library has no such call
        pass
