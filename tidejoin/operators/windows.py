"""Count windows as columns.

Lazy: batches join when both sides hold a window's tuples; a window takes whole batches, and the incomplete last one
never joins. Eager: each batch joins what its window holds so far, and the batch that would complete the window opens
the next one instead, so a window holds 2 * touched - 1 batches of both sides in arrival order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import JoinSpec


def arrival() -> Column:
    """Batches arrive alternately: left 0, right 0, left 1, ..."""
    return 2 * F.col("batch") + F.when(F.col("side") == "R", 1).otherwise(0)


def assign_windows(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """tuples (side, batch, nb, ...) with win and arr; tuples of no window are dropped."""
    placed = tuples.withColumn("arr", arrival())
    if spec.progress == "EAGER":
        return placed.withColumn("win", F.floor(F.col("arr") / spec.length).cast("long"))
    spare = spec.touched - spec.whole
    windows = F.greatest(F.lit(0), F.floor((F.col("nb") - spare) / spec.whole))
    return placed.withColumn("win", F.floor(F.col("batch") / spec.whole).cast("long")).where(F.col("win") < windows)


def sides(tuples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left and right tuples, with the columns lkey, lval, ... and rkey, rval, ..."""
    names = ("key", "val", "ts", "seq", "arr")
    part = lambda s, p: tuples.where(F.col("side") == s).select("win", *(F.col(c).alias(f"{p}{c}") for c in names))
    return part("L", "l"), part("R", "r").withColumnRenamed("win", "rwin")
