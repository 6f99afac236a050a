"""Aggregates and analytic steps around the join."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import JoinSpec
from ..operators.join import count_by_window, histogram, window_join
from ..operators.windows import assign_windows
from .running import running_sum

#: Rows of room for each expected match.
ROOM = {"NLJ": 10.0, "HJ": 1.125, "SMJ": 1.125}
RING = 1024


def progress(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """The progress curve: arr (ordinal of the emitting batch), win, matches, cumulative matches, closed flag.

    Eager: a row for every batch, with the matches whose later batch it is; the flag marks the first batch of a later
    window, which finds an empty state and so has none. Lazy: a row for every executed window, at the batch that
    completes it, always closed. Rows without a match are kept.
    """
    placed = assign_windows(tuples, spec)
    sides = placed.groupBy("win", "key", "arr").agg(F.count("*").alias("n"))  # left batches have even arr
    left = F.when(F.col("arr") % 2 == 0, F.col("n"))
    right = F.when(F.col("arr") % 2 == 1, F.col("n"))
    if spec.progress == "LAZY":
        by_key = sides.groupBy("win", "key").agg((F.coalesce(F.sum(left), F.lit(0)) * F.coalesce(F.sum(right), F.lit(0))).alias("matches"))
        key, arr, closed = "win", 2 * (F.col("win") * spec.whole + spec.touched) - 1, F.lit(True)
    else:
        # An arriving batch matches what the other side holds of each key so far; a key has a row a batch of its window.
        before = Window.partitionBy("win", "key").orderBy("arr").rowsBetween(Window.unboundedPreceding, -1)
        other = F.when(F.col("arr") % 2 == 0, F.sum(right).over(before)).otherwise(F.sum(left).over(before))
        by_key = sides.withColumn("matches", F.col("n") * F.coalesce(other, F.lit(0)))
        key, arr, closed = "arr", F.col("arr"), (F.col("arr") > 0) & (F.col("arr") % spec.length == 0)
    matches = F.when(F.col("key").isNotNull(), F.col("matches")) if spec.algorithm != "EMPTY" else F.lit(None).cast("long")
    rows = by_key.groupBy(*dict.fromkeys((key, "win"))).agg(F.coalesce(F.sum(matches), F.lit(0)).alias("matches"))
    summed = running_sum(rows, key, "matches", "current_matches")
    return summed.select(arr.alias("arr"), "win", "matches", "current_matches", closed.alias("is_window_closed"))


def prefix_sums(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Histogram of each side and window with the exclusive running sum of its keys."""
    before = Window.partitionBy("side", "win").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return histogram(tuples, spec).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Place of each tuple in its side and window sorted by key; equal keys in arrival order."""
    order = Window.partitionBy("side", "win").orderBy("key", "seq")
    return assign_windows(tuples, spec).select("side", "win", "key", "val", (F.row_number().over(order).cast("long") - 1).alias("slot"))


def estimated_capacity(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Rows to set aside for each window if every key were equally frequent: room * ceil(l * r / distinct keys)."""
    placed = assign_windows(tuples, spec)
    distinct = placed.agg(F.countDistinct("key").alias("d"))
    each = lambda s: F.count(F.when(F.col("side") == s, 1))
    sizes = placed.groupBy("win").agg((each("L") * each("R")).alias("possible")).crossJoin(F.broadcast(distinct))  # one row
    return sizes.select("win", F.ceil(ROOM[spec.algorithm] * F.ceil(F.col("possible") / F.col("d"))).cast("long").alias("capacity"), (1.0 / F.col("d")).alias("estimated_selectivity"))


def latest_results(tuples: DataFrame, spec: JoinSpec, size: int = RING) -> DataFrame:
    """The last ``size`` matches by window and positions, in their ring slots: a match's number modulo ``size``."""
    last = window_join(tuples, spec).orderBy(F.desc("win"), F.desc("lseq"), F.desc("rseq")).limit(size)
    back = F.row_number().over(Window.orderBy(F.desc("win"), F.desc("lseq"), F.desc("rseq")))  # of at most size rows
    total = count_by_window(tuples, spec).agg(F.coalesce(F.sum("matches"), F.lit(0))).scalar()
    return last.select(((total - back) % size).alias("slot"), "win", "lseq", "rseq", "lval", "rval")


def median(values: list[float]) -> float:
    """Middle value; of an even number, the whole-number mean of the middle two."""
    v = sorted(values)
    if not v:
        return math.nan
    k = len(v) // 2
    return v[k] if len(v) % 2 else (v[k - 1] + v[k]) // 2
