"""Synthetic streams: steady or bursty timestamps, uniform or Zipf keys, from row numbers and a seed alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEFT_SEED, RIGHT_SEED = 123, 456
STEADY, BURST = "STEADY", "BURST"
PRIME = 2147483647
#: Distinct values, at most, that sorted_by() lays out.
VALUES = 1 << 14
#: Weights of a burst's period, whole numbers so that sums are exact: a sine a degree a tuple, above zero.
PERIOD = 360
BURST_WEIGHTS = [math.floor(1_000_000 * (math.sin(k * 3.14159 / 180) + 1)) + 1 for k in range(PERIOD)]


def steady_ts(id_: Column, count: int, upper: int) -> Column:
    """count / upper tuples share a timestamp; the rest spills past upper - 1."""
    if count <= upper:
        raise ValueError("steady timestamps need more tuples than timestamps")
    return F.floor(id_ / (count // upper)).cast("long")


def burst_ts(id_: Column, count: int, upper: int) -> Column:
    """The place of id / count in the running share of the weights, modulo upper. Unsorted.

    Weights repeat after PERIOD, so the place follows from one period's running sums and needs no pass over tuples.
    """
    before = [sum(BURST_WEIGHTS[:k]) for k in range(PERIOD + 1)]
    total = (count // PERIOD) * before[-1] + before[count % PERIOD]
    at = F.floor(id_.cast("decimal(38,0)") * total / count).cast("long")
    rest = at % before[-1]
    sums = F.expr("array(" + ",".join(f"{b}L" for b in before[:-1]) + ")")
    place = F.floor(at / before[-1]) * PERIOD + F.size(F.filter(sums, lambda b: b <= rest)) - 1
    return (place % upper).cast("long")


def uniform(id_: Column, seed: int) -> Column:
    """Reproducible numbers in [0, 1): squares modulo a prime, so any SQL engine gives the same."""
    x = (id_ * 48271 + seed * 16807 + 11) % PRIME
    x = (x * x + id_ + seed) % PRIME
    x = (x * x + 7 * id_ + 3 * seed) % PRIME
    return x / F.lit(float(PRIME))


def zeta(spark: SparkSession, n: int, theta: float) -> float:
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.lit(1.0) / F.col("id"), F.lit(theta)))).first()[0]


def zipf_key(spark: SparkSession, u: Column, distinct: int, theta: float) -> Column:
    """Key 0 to distinct - 1 of a uniform number, by the closed form of Gray et al. (1994); theta 0 is uniform."""
    if not 0 <= theta < 1:
        raise ValueError("theta must be in [0, 1)")
    if theta == 0 or distinct < 3:
        return F.floor(u * distinct).cast("long")
    total, two = zeta(spark, distinct, theta), 1 + 0.5**theta
    alpha = 1 / (1 - theta)
    eta = (1 - (2 / distinct) ** (1 - theta)) / (1 - two / total)
    tail = F.floor(distinct * F.pow(eta * u - eta + 1, F.lit(alpha)))
    key = F.when(u * total < 1, 0).when(u * total < two, 1).otherwise(tail)
    return F.least(key.cast("long"), F.lit(distinct - 1).cast("long"))


def generate(spark: SparkSession, count: int, theta: float = 0.0, mode: str = STEADY, distinct: int = 1000, seed: int = LEFT_SEED, upper: int = 1000) -> DataFrame:
    """id, key, val (equal to key), ts in milliseconds. Timestamps ascend along the ids, bursts too."""
    if mode not in (STEADY, BURST):
        raise ValueError(f"unknown timestamp mode {mode!r}")
    key = zipf_key(spark, uniform(F.col("id"), seed), distinct, theta)
    ts = (steady_ts if mode == STEADY else burst_ts)(F.col("id"), count, upper)
    made = spark.range(count).select("id", key.alias("key"), key.alias("val"), ts.alias("ts"))
    if mode == STEADY:
        return made
    return made.drop("ts").join(sorted_by(made, "ts"), "id").select("id", "key", "val", "ts")


def sorted_by(generated: DataFrame, column: str) -> DataFrame:
    """id and the values of ``column``, in ascending order along the ids 0, 1, ...

    A generator's values are few (timestamps under ``upper``, keys under ``distinct``): their counts give each value's
    stretch of ids, which a binary search in one array finds, and no tuple is moved. More than VALUES are refused.
    """
    counts = generated.groupBy(column).agg(F.count("*").alias("n"))
    upto = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)  # a row a value
    ends = counts.select(F.col(column).alias("value"), F.sum("n").over(upto).alias("end")).orderBy("value").limit(VALUES + 1).collect()
    if len(ends) > VALUES:
        raise ValueError(f"{column} has more than {VALUES} values")
    ids = generated.select("id")
    if not ends:
        return ids.withColumn(column, F.lit(None).cast("long"))
    literal = lambda xs: F.expr("array(" + ",".join(f"{x}L" for x in xs) + ")")
    jumps = F.array(*(F.lit(1 << k) for k in reversed(range(len(ends).bit_length()))))
    bounds = literal([r["end"] for r in ends])
    step = lambda p, j: F.when((p + j < len(ends)) & (F.get(bounds, F.least(p + j, F.lit(len(ends))) - 1) <= F.col("id")), p + j).otherwise(p)
    return ids.select("id", F.get(literal([r["value"] for r in ends]), F.aggregate(jumps, F.lit(0), step)).alias(column))


def stream_pair(spark: SparkSession, count: int, **options) -> DataFrame:
    """Both sides as input tuples: key, val (the position), ts, side."""
    sides = [generate(spark, count, seed=seed, **options).select("key", F.col("id").alias("val"), "ts", F.lit(side).alias("side")) for side, seed in (("L", LEFT_SEED), ("R", RIGHT_SEED))]
    return sides[0].unionByName(sides[1])
