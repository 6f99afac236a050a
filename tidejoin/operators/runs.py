"""Sorted runs kept on disk: both sides of a windowed join, bucketed and sorted by window and key, for repeated joins.

write_runs() deals the tuples once; every join of them afterwards reads bucket beside bucket, merges what is already
sorted, and shuffles and sorts nothing. Each bucket is one file, which is what lets Spark trust its order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..model import JoinSpec
from ..sources.scratch import scratch
from .windows import assign_windows, sides

BUCKETS = 8
#: Scans of bucketed tables report their order (one file a bucket), and small ones aren't broadcast instead.
READING = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def write_runs(tuples: DataFrame, spec: JoinSpec, buckets: int = BUCKETS) -> tuple[str, str]:
    """Both sides as tables in the shared folder; their names. Null keys match nothing and are left out."""
    left, right = sides(assign_windows(tuples, spec))
    names = []
    for df, win, key in ((left, "win", "lkey"), (right, "rwin", "rkey")):
        name = f"runs_{uuid.uuid4().hex}"
        dealt = df.where(f"{key} is not null").repartition(buckets, win, key).sortWithinPartitions(win, key)
        dealt.write.format("parquet").option("path", scratch(df.sparkSession, name)).bucketBy(buckets, win, key).sortBy(win, key).saveAsTable(name)
        names.append(name)
    return names[0], names[1]


def reader(spark: SparkSession) -> SparkSession:
    """A session beside this one that reads runs in order; this one's settings stay as they are."""
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    for k, v in READING.items():
        other.conf.set(k, v)
    return other


def join_runs(spark: SparkSession, runs: tuple[str, str]) -> DataFrame:
    """Matches of two written sides: win, lkey, lval, lts, lseq, larr, rkey, ..."""
    other = reader(spark)
    left, right = other.table(runs[0]), other.table(runs[1])
    same = (left["win"] == right["rwin"]) & (left["lkey"] == right["rkey"])
    return left.join(right.hint("merge"), same).drop("rwin")


def drop_runs(spark: SparkSession, runs: tuple[str, str]) -> None:
    """Forget the tables; their files stay until the shared folder is cleared."""
    for name in runs:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
