"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these. Edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), integers of any order, to (node, root): the smallest node that each non-root reaches.

    Roots and nodes without a link are not listed. Every round is a table in the shared folder. Self-links and nulls
    are dropped.
    """
    ordered = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = cut(ordered, "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        after, new = cut(_small_star(_large_star(now)), "stars")
        n, total = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now.sparkSession, path)
        now, path = after, new
        if before == (n, total):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, total)
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
