"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches hold at most so many rows and, but for a longer row, so many bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset, and the master is local, a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="passagelake-"))
        root = spark.sparkContext.getCheckpointDir()
    if not urlparse(root).scheme:
        root = f"file://{os.path.abspath(root)}"
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/passagelake/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # the default codec holds buffers off the heap until a collection
    out = spark.read.schema(df.schema).parquet(path)
    out._passagelake_path = path  # for discard()
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that materialize() wrote and nothing will read again."""
    path = getattr(df, "_passagelake_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is executed inside gives its shuffle files back when it ends; else they stay until the driver collects its garbage.
    Only for frames that are not executed again: theirs would be made anew."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for heavy maps over a table that came as a few files.
    A table that already fills the cores is not moved."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, unless the session already asks for smaller ones. The session keeps these settings, as jobs that
    read what an operator returns run after it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(key)).removesuffix("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))
