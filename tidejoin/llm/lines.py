"""Line dedup by distinct-site spread.

A line that stands on SITES or more distinct sites (the ``source`` column) is boilerplate and is removed everywhere.
Rows of each line hash are counted first, which rules out lines with fewer rows than SITES; for the others HyperLogLog
sketches of sites merge by aggregation: tasks sketch the rows they have, so a line is shuffled as often as it has tasks,
not sites. Lines whose estimates are near the threshold, within BAND, are counted again, exactly, so only lines that are
clearly above or below rest on a sketch.

A line is compared without leading and trailing spaces; blank lines are always kept. Defined results: a null text is
the empty one (one blank line); a null source is no site; equal rows count as rows, but their site once; rows with one
doc_id are cleaned alike; other columns are ignored; no line is cut, however long; an empty table gives an empty result.
Lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SITES = 5
#: log2 of a sketch's registers: 4096, a standard error of 1.6 %. BAND is six of these, and two sites at least.
LG_K, BAND = 12, 0.1


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def boilerplate(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs (text, source) to (line, n_sites): hashes of the lines to remove; n_sites is exact near the threshold."""
    lines = docs.select("source", F.explode(split_lines(F.col("text"))).alias("t")).where(F.trim("t") != "").select("source", line_hash(F.col("t")).alias("line"))
    often, _ = cut(lines.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("line"), "often")
    sited = lines.where("source is not null")
    sketches = sited.join(often, "line", "left_semi").groupBy("line").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"))
    spread, _ = cut(sketches.select("line", F.hll_sketch_estimate("sketch").alias("n_sites")), "spread")
    width = max(2, sites * BAND)
    near = F.col("n_sites").between(sites - width, sites + width)
    exact = sited.join(spread.where(near).select("line"), "line", "left_semi").groupBy("line").agg(F.countDistinct("source").alias("n_sites"))
    return spread.where(~near).unionByName(exact).where(F.col("n_sites") >= sites)


def remove_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs (doc_id, text, source) to doc_id, n_lines, n_removed, kept_text."""
    found, _ = cut(boilerplate(docs, sites), "boilerplate")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    lines = docs.select(key.alias("key"), F.explode(F.array_distinct(F.transform(split_lines(F.col("text")), line_hash))).alias("line"))
    hits, _ = cut(lines.join(found, "line", "left_semi").distinct().groupBy("key").agg(F.collect_list("line").alias("hits")), "hits")
    # The hits grow with the input, so the plan that shuffles both sides is taken at every size.
    body = docs.select(key.alias("key"), F.col("doc_id").cast("long"), "text").join(hits.hint("merge"), "key", "left").withColumn("lines", split_lines(F.col("text")))
    kept = body.select("doc_id", "lines", F.when(F.col("hits").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("hits", line_hash(x)))).alias("kept"))
    return kept.select("doc_id", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_removed"), F.array_join("kept", "\n").alias("kept_text"))
