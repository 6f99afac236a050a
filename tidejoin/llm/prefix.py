"""Running sums over tables of any size: sums of buckets first, then windows inside each bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows, about, of a bucket; bits of the fewest and the most buckets. Each bucket is a window of its own.
BUCKET_ROWS, FEWEST, MOST = 1 << 16, 10, 22


def bucket_bits(rows: int) -> int:
    """Bits of the buckets that a table of so many rows is spread over."""
    return min(MOST, max(FEWEST, (rows // BUCKET_ROWS).bit_length()))


def bucket_of(hash_: Column, bits: int) -> Column:
    """Upper bits of a 64-bit hash, so order by bucket and hash is one order."""
    return F.shiftrightunsigned(hash_, 64 - bits).cast("int")


def running(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one.

    Order is by ``bucket`` (a whole number, a column of df), then by ``order``; equal rows follow in any order.
    ``group`` columns must not be null.
    """
    sums = df.groupBy(*group, "bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group, F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*group, "bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return local.join(offsets, [*group, "bucket"]).withColumn(out, F.col("_local") + F.col("_offset")).drop("_local", "_offset")
