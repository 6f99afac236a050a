"""Deterministic arrival order of two streams: a position in each side, and the batch that holds it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Tables of up to SMALL_ROWS tuples are numbered by one window a side; larger ones by ranges of the arrival order, of
#: about RANGE_ROWS each. SMALL_BYTES decides nothing any more: compressed bytes don't bound rows. A test still sets it.
#: MOST_RANGES is the default of spark.shuffle.sort.bypassMergeThreshold: a task that deals to more partitions first holds
#: all that it read, which is a whole file if that is one row group. So from 52 M tuples on ranges grow instead; each is
#: one sort, which spills.
SMALL_BYTES, SMALL_ROWS, RANGE_ROWS, MOST_RANGES = 4 << 20, 1 << 20, 1 << 18, 200

LEFT_EVENTS = ("click", "view")


def event_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as input tuples: key, val, ts, side (L: clicks and views, R: all others)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = F.when(F.col("event_type").isin(*LEFT_EVENTS), "L").otherwise("R")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("val"), "ts", side.alias("side"))


def line_tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as input tuples: key (the supplier), val, ts (the shipping date), side (L: odd line numbers)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    side = F.when(F.col("l_linenumber") % 2 == 1, "L").otherwise("R")
    return lines.select(F.col("l_suppkey").alias("key"), (8 * F.col("l_orderkey") + F.col("l_linenumber")).alias("val"), F.col("l_shipdate").alias("ts"), side.alias("side"))


def _ranges(tuples: DataFrame) -> int:
    """Ranges that a table is numbered by; 0 for one window a side.

    Rows decide, never bytes: a steady stream of millions of tuples may take a few kilobytes of Parquet. Tables whose
    rows the plan itself bounds (generated ones, limits) aren't counted unless the bound is larger.
    """
    bound = tuples._jdf.queryExecution().optimizedPlan().maxRows()
    if (bound.isDefined() and bound.get() <= SMALL_ROWS) or (n := tuples.count()) <= SMALL_ROWS:
        return 0
    return min(MOST_RANGES, max(8, -(-n // RANGE_ROWS)))


def _windowed(tuples: DataFrame) -> DataFrame:
    at = F.row_number().over(Window.partitionBy("side").orderBy("ts", "val"))
    return tuples.withColumn("seq", at.cast("long") - 1)


def number(tuples: DataFrame, ranges: int) -> tuple[DataFrame, dict[str, int], str]:
    """tuples with seq, tuples of each side, and the written table's path.

    A range is a task of one sort, whose tuples are numbered as they are written; the ranges' counts by side, two rows a
    range at most, give what to add. So no task orders a whole side, tuples of one time may lie in several ranges, and
    nothing is numbered again however often the result is read.
    """
    spark = tuples.sparkSession
    inside = (F.monotonically_increasing_id() % (1 << 33)).alias("_at")
    dealt = tuples.repartitionByRange(ranges, "side", "ts", "val").sortWithinPartitions("side", "ts", "val")
    written, path = cut(dealt.select("*", F.spark_partition_id().alias("_part"), inside), "sequence")
    found = written.groupBy("side", "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first")).orderBy("_part").collect()
    upto, shifts = {}, []
    for r in found:
        shifts.append((r["side"], r["_part"], upto.get(r["side"], 0) - r["first"]))
        upto[r["side"]] = upto.get(r["side"], 0) + r["n"]
    table = F.broadcast(spark.createDataFrame(shifts, "side string, _part int, _shift long"))  # two rows a range
    placed = written.join(table, ["side", "_part"])
    return placed.select(*tuples.columns, (F.col("_at") + F.col("_shift")).alias("seq")), upto, path


def sequence(tuples: DataFrame, ranges: int | None = None) -> DataFrame:
    """Adds seq, the position from 0 in its side by (ts, val). Large tables are numbered once, in a written table."""
    ranges = _ranges(tuples) if ranges is None else ranges
    return number(tuples, ranges)[0] if ranges else _windowed(tuples)


def batched(tuples: DataFrame, batch: int, ranges: int | None = None) -> DataFrame:
    """Adds seq, batch, and nb, the number of whole batches that both sides have. Later tuples are dropped.

    A small table is counted in one window, under which a filter on the side isn't pushed, so that both sides of a join
    share one scan and one exchange; a large one is counted as it is numbered.
    """
    ranges = _ranges(tuples) if ranges is None else ranges
    if ranges:
        placed, upto, _ = number(tuples, ranges)
        placed = placed.withColumn("nb", F.lit(min(upto.get(s, 0) // batch for s in ("L", "R"))).cast("long"))
    else:
        whole = F.least(*(F.floor(F.count(F.when(F.col("side") == s, 1)).over(Window.partitionBy()) / batch) for s in ("L", "R"))).cast("long")
        placed = _windowed(tuples.withColumn("nb", whole))
    return placed.withColumn("batch", F.floor(F.col("seq") / batch).cast("long")).where("batch < nb")
