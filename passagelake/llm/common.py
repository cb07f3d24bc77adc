"""Shared helpers of the training-data operators: scratch tables, ordering, text constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import BATCH_BYTES, BATCH_ROWS, discard, materialize, scratch_path, scratch_root, small_batches  # noqa: F401

#: A word of the contracts: a run of anything but the ASCII white space 09-0D and 20.
WORD = r"[^\x20\x09-\x0D]+"
def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_parts(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `_part`, rising along the order; sorted inside each part; written to the shared folder.

    A range exchange deals the rows evenly, so no key, however frequent, is gathered in one task as
    long as the order's last column tells its rows apart. The result is written because the bounds
    of the ranges are sampled: a second evaluation may draw others.
    """
    n = partitions(df.sparkSession)
    dealt = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    return materialize(dealt.sortWithinPartitions(*order), name)


def before(totals: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """totals (a row a part, or a row a part and group) with the sum of `value` over earlier parts.

    The window sees one row for each range part (and group), never a row for each input row.
    """
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)))


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null id is in no held-out fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))
