"""Running aggregates over tables with a gapless ordinal, by blocks: no task holds more than a block or a row a block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals of a block. A table of 10**9 rows has some 15,000 blocks.
SPAN = 1 << 16


def running(df: DataFrame, at: str, value: str, how: Callable[[str], Column], combine: Callable[[Column, Column], Column], out: str, before: bool = False) -> DataFrame:
    """Adds ``out``: ``how`` (F.sum, F.max) of ``value`` over the rows up to this one, or before it, in the order of ``at``.

    Aggregates of blocks come first, then windows inside a block; ``combine`` joins the two. Null where nothing precedes.
    """
    placed = df.withColumn("_block", F.floor(F.col(at) / SPAN))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each SPAN ordinals
    sums = placed.groupBy("_block").agg(how(value).alias("_sum")).select("_block", how("_sum").over(earlier).alias("_offset"))
    inside = Window.partitionBy("_block").orderBy(at).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    local = placed.withColumn("_local", how(value).over(inside)).join(sums, "_block")
    both = combine(F.col("_offset"), F.col("_local"))
    return local.withColumn(out, F.coalesce(both, "_offset", "_local")).drop("_block", "_local", "_offset")


def running_sum(df: DataFrame, at: str, value: str, out: str, before: bool = False) -> DataFrame:
    return running(df, at, value, F.sum, lambda a, b: a + b, out, before).withColumn(out, F.coalesce(out, F.lit(0)).cast("long"))


def running_max(df: DataFrame, at: str, value: str, out: str) -> DataFrame:
    return running(df, at, value, F.max, lambda a, b: F.greatest(a, b), out)
