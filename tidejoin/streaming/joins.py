"""Structured Streaming forms: a symmetric hash join in event-time windows or between count windows, and its progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.join import RESULT
from ..sources.sequence import LEFT_EVENTS, sequence

DELAY = "1 hour"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """Event files as a stream of input tuples; a limit on files a trigger takes the place of back-pressure."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    side = F.when(F.col("event_type").isin(*LEFT_EVENTS), "L").otherwise("R")
    return events.select(F.col("user_id").alias("key"), F.col("event_id").alias("val"), F.col("ts").cast("timestamp").alias("ts"), side.alias("side"))


def _side(stream: DataFrame, side: str, p: str, delay: str, *more: str) -> DataFrame:
    """One side, with its event time under the watermark apart from the plain timestamp."""
    names = ("key", "val", "ts", *more)
    return stream.where(F.col("side") == side).select(*(F.col(c).alias(f"{p}{c}") for c in names), F.col("ts").alias(f"{p}time")).withWatermark(f"{p}time", delay)


def tumbling_stream_join(stream: DataFrame, width: str, delay: str = DELAY) -> DataFrame:
    """Both sides of a stream joined in aligned windows. State is dropped once the watermark passes a window; later
    tuples are dropped with it."""
    left = _side(stream, "L", "l", delay).withColumn("lw", F.window("ltime", width)).drop("ltime")
    right = _side(stream, "R", "r", delay).withColumn("rw", F.window("rtime", width)).drop("rtime")
    return left.join(right, (F.col("lw") == F.col("rw")) & (F.col("lkey") == F.col("rkey"))).select(F.col("lw.start").alias("start"), *RESULT)


def number_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A query that numbers each side's tuples in ``seq``, by (ts, val) inside a micro-batch, and writes them to ``out``.

    Micro-batches are folders of their own, ``tuples/batch_no=k`` and ``totals/batch_no=k``, written anew if one is
    repeated, so numbers are the same after a restart. Totals carry on from the micro-batch before, a row a side, and
    nothing older is read. ``read_numbered`` reads the tuples as a stream.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark, totals = batch.sparkSession, "side string, upto long"
        before = spark.read.schema(totals).parquet(f"{out}/totals/batch_no={number - 1}") if number else spark.createDataFrame([], totals)
        counts = batch.groupBy("side").agg(F.count("*").alias("upto")).unionByName(before)
        counts.groupBy("side").agg(F.sum("upto").alias("upto")).coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch_no={number}")
        placed = sequence(batch).join(F.broadcast(before), "side", "left").withColumn("seq", F.col("seq") + F.coalesce("upto", F.lit(0)))  # a row a side
        placed.select(*batch.columns, F.col("seq").cast("long")).write.mode("overwrite").parquet(f"{out}/tuples/batch_no={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def read_numbered(spark: SparkSession, out: str, files_per_trigger: int = 1) -> DataFrame:
    """The tuples that number_stream() has written, as a stream."""
    schema = "key long, val long, ts timestamp, side string, seq long, batch_no long"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{out}/tuples").drop("batch_no")


def count_stream_join(stream: DataFrame, batch: int, window: int, span: str, delay: str = DELAY) -> DataFrame:
    """Eager count windows on a stream whose tuples are numbered by side in ``seq``, as read_numbered() gives them.

    Count windows have no time bound, so ``span`` must cover the longest window; it lets state be dropped.
    """
    length = 2 * -(-window // batch) - 1
    left, right = _side(stream, "L", "l", delay, "seq"), _side(stream, "R", "r", delay, "seq")
    win = lambda seq, shift: F.floor((2 * F.floor(F.col(seq) / batch) + shift) / length)
    left, right = left.withColumn("win", win("lseq", 0)), right.withColumn("rwin", win("rseq", 1))
    near = F.expr(f"rtime BETWEEN ltime - INTERVAL {span} AND ltime + INTERVAL {span}")
    return left.join(right, (F.col("win") == F.col("rwin")) & (F.col("lkey") == F.col("rkey")) & near).select("win", *RESULT)


def start(joined: DataFrame, name: str, checkpoint: str, sink: str = "memory", **options) -> StreamingQuery:
    """A query to a sink: memory, noop, parquet and so on. Restarts go on from the checkpoint."""
    writer = joined.writeStream.format(sink).queryName(name).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.options(**options).start()


def progress_rows(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, input rows, cumulative input rows) of the batches so far."""
    out, total = [], 0
    for p in query.recentProgress:
        total += p["numInputRows"]
        out.append((p["batchId"], p["numInputRows"], total))
    return out
