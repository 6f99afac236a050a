"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Targets: sources in code point order (null last) weigh WEIGHTS, repeating, and share EPOCHS times all words; a target
stops at MAX_REPEAT times its source's words and the excess is reshared by weight until none is above.

Draw: each source's documents lie on an axis of words in a seeded permutation, and are cut into blocks of documents.
A source's draw is every block as often as the target holds its words whole, and for the rest, blocks in a permuted order
until the rounded target is reached. A tree halves the set of output shards again and again; at each node every source's
quota of drawn blocks splits by a multivariate hypergeometric draw, so each shard's quotas are exact block counts. Shards
then take disjoint stretches of each source's drawn blocks in another permuted order, and a hash orders the documents of
a shard. What a document gives to the mix is what its drawn blocks hold of it.

The multivariate draw is itself a tree: sources, by number, are halved again and again, and each half's share of its
range's draws is a hypergeometric draw by inversion. So quotas stay a row a source and node, in joins.

The last block of a draw may be taken in part, and its last document (its first words), so a source's words equal its
rounded target. Defined results: null texts have size 0; documents without words are never taken; a source without words
has target 0; equal rows are separate documents; a text of any length lies in one block; other columns are ignored; an
empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, word_count
from .prefix import bucket_bits, bucket_of, running

WEIGHTS = (3, 1, 2)
EPOCHS, MAX_REPEAT = 1.5, 2
SHARDS = 8
#: A block begins at each so many words of an axis, at every size of the corpus.
BLOCK_WORDS = 4096
SEED = 42


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) to source_no, source, source_size, weight, target. A row for each source."""
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    weighed = numbered.withColumn("weight", weights[(F.col("source_no") - 1) % len(WEIGHTS)]).withColumn("cap", F.col("source_size") * float(MAX_REPEAT))
    # By growing cap per weight: a source is capped if the level that remains for it and the later ones exceeds it.
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    before, every = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (EPOCHS * F.sum("source_size").over(every) - earlier("cap")) / (F.sum("weight").over(every) - earlier("weight"))
    levels = weighed.withColumn("rank", F.row_number().over(rank)).withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    held = levels.withColumn("final", F.min(F.when(F.col("open"), F.struct("rank", "level"))).over(every))
    target = F.when(F.col("final").isNull() | (F.col("rank") < F.col("final.rank")), F.col("cap")).otherwise(F.col("final.level") * F.col("weight"))
    return held.select("source_no", "source", "source_size", "weight", target.alias("target"))


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Inversion: how many of ``draws`` items out of ``total`` are among the ``good``; u uniform in [0, 1).

    Weights run from 12 deviations below the mean to 12 above, relative to the first, by the ratio of neighbours;
    what lies outside weighs less than a double's precision. All arguments are doubles holding whole numbers.
    """
    mean = draws * good / F.greatest(total, F.lit(1.0))
    share = good / F.greatest(total, F.lit(1.0))
    spread = 12 * F.sqrt(mean * (1 - share) * (total - draws) / F.greatest(total - 1, F.lit(1.0))) + 12
    lo = F.greatest(F.lit(0.0), draws - (total - good), F.floor(mean - spread).cast("double"))
    hi = F.least(good, draws, F.ceil(mean + spread).cast("double"))
    steps = F.sequence(lo.cast("long"), F.greatest(lo, hi).cast("long"))
    ratio = lambda x: (good - x) * (draws - x) / ((x + 1) * F.greatest(total - good - draws + x + 1, F.lit(1.0)))
    start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
    sums = F.aggregate(steps, start, lambda s, x: F.struct((s["w"] * ratio(x.cast("double"))).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"])
    first = F.struct(F.lit(1.0).alias("w"), (u * sums).alias("left"), lo.alias("x"))
    # Walk while the remaining share isn't used up; x stays at the value on which it ends.
    walk = lambda s, x: F.struct((s["w"] * ratio(x.cast("double"))).alias("w"), (s["left"] - s["w"]).alias("left"), F.when(s["left"] >= 0, x.cast("double")).otherwise(s["x"]).alias("x"))
    return F.aggregate(steps, first, walk, lambda s: s["x"])


def _multivariate(nodes: DataFrame, quotas: DataFrame, levels: int) -> DataFrame:
    """nodes (lo, hi, draws), quotas (lo, hi, source_no, n) to (lo, hi, source_no, x): how the draws fall on the sources.

    One multivariate hypergeometric draw for each node; 2 ** levels exceeds the largest source_no.
    """
    total = quotas.groupBy("lo", "hi").agg(F.sum("n").alias("total"))
    ranges = nodes.join(total, ["lo", "hi"]).select("lo", "hi", F.lit(0).cast("long").alias("range"), "total", "draws")
    for level in reversed(range(levels)):
        half = F.floor(F.col("source_no") / (1 << level)).cast("long")
        lower = quotas.groupBy("lo", "hi", half.alias("half")).agg(F.sum("n").alias("good")).where("half % 2 = 0").select("lo", "hi", (F.col("half") / 2).cast("long").alias("range"), "good")
        u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "lo", "hi", F.lit(level), "range"), 11) / F.lit(float(1 << 53))
        joined = ranges.join(lower, ["lo", "hi", "range"], "left").withColumn("good", F.coalesce("good", F.lit(0.0)))
        drawn = joined.withColumn("x", F.least(hypergeometric(F.col("total"), F.col("good"), F.col("draws"), u), F.col("good")))
        first = F.struct((2 * F.col("range")).alias("range"), F.col("good").alias("total"), F.col("x").alias("draws"))
        second = F.struct((2 * F.col("range") + 1).alias("range"), (F.col("total") - F.col("good")).alias("total"), (F.col("draws") - F.col("x")).alias("draws"))
        ranges = drawn.select("lo", "hi", F.explode(F.array(first, second)).alias("r")).select("lo", "hi", "r.*").where("total > 0")
    return ranges.select("lo", "hi", F.col("range").alias("source_no"), F.col("draws").alias("x"))


def splitting_tree(quotas: DataFrame, shards: int) -> DataFrame:
    """quotas (source_no, n), n a double, to (source_no, shard, n): a row for each source and shard."""
    now, path = cut(quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("source_no").cast("long"), F.col("n").cast("double")), "quotas")
    levels = int(now.agg(F.coalesce(F.max("source_no"), F.lit(0))).first()[0]).bit_length()
    for _ in range((shards - 1).bit_length()):
        open_, whole = now.where("hi - lo > 1"), now.where("hi - lo = 1")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        nodes = open_.groupBy("lo", "hi").agg(F.sum("n").alias("total")).select("lo", "hi", F.floor(F.col("total") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo"))).cast("double").alias("draws"))
        split = open_.join(_multivariate(nodes, open_, levels), ["lo", "hi", "source_no"], "left").withColumn("x", F.coalesce("x", F.lit(0.0)))
        low = F.struct("lo", mid.alias("hi"), F.col("x").alias("n"))
        high = F.struct(mid.alias("lo"), "hi", (F.col("n") - F.col("x")).alias("n"))
        halves = split.select("source_no", F.explode(F.array(low, high)).alias("h")).select("h.lo", "h.hi", "source_no", "h.n")
        after, new = cut(halves.unionByName(whole), "quotas")
        drop(now.sparkSession, path)
        now, path = after, new
    return now.select("source_no", F.col("lo").alias("shard"), "n")


def _in_order(rows: DataFrame, seed: int, value: str, out: str, *by: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the source before this one, in the permuted order of a seed."""
    hashed = rows.withColumn("hash", F.xxhash64(F.lit(seed), "source_no", *by))
    placed = hashed.withColumn("bucket", bucket_of(F.col("hash"), bucket_bits(rows.count())))
    return running(placed, ["source_no"], ["hash", *by], value, out).drop("hash", "bucket")


def _drawn_blocks(blocks: DataFrame) -> DataFrame:
    """blocks (source_no, block, words, source_size, draw) to (source_no, block, pass, take): what is drawn, and how often."""
    whole = F.floor(F.col("draw") / F.col("source_size"))
    ordered = _in_order(blocks, SEED, "words", "before", "block")
    rest = F.col("draw") - whole * F.col("source_size") - F.col("before")
    ready = ordered.withColumn("whole", whole.cast("int")).withColumn("rest", F.greatest(F.lit(0), F.least("words", rest)))
    passes = F.transform(F.sequence(F.lit(0), F.col("whole")), lambda p: F.struct(p.alias("pass"), F.when(p < F.col("whole"), F.col("words")).otherwise(F.col("rest")).alias("take")))
    return ready.select("source_no", "block", F.explode(passes).alias("p")).select("source_no", "block", "p.*").where("take > 0")


def mix(docs: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text, source) to its documents and its draws.

    documents: doc_id, size, source_no, source_size, target, start (on the source's axis), a row for each of docs.
    draws: source_no, start, doc_id, size, pass, words, block, shard, key (order in the shard).
    """
    spark = docs.sparkSession
    sized, sized_path = cut(docs.select(F.col("doc_id").cast("long"), "source", word_count(F.col("text")).alias("size")), "sizes")
    per_source, _ = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    named = sized.join(per_source, sized["source"].eqNullSafe(per_source["source"])).select("doc_id", "size", "source_no", "source_size", "target")
    hashed = named.withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id", "size")).withColumn("bucket", bucket_of(F.col("hash"), bucket_bits(sized.count())))
    placed, _ = cut(running(hashed, ["source_no"], ["hash", "doc_id", "size"], "size", "start").drop("bucket", "hash"), "axis")
    drop(spark, sized_path)

    draw = F.round("target").cast("long")
    documents = placed.where("size > 0").withColumn("block", F.floor(F.col("start") / BLOCK_WORDS))
    blocks = documents.groupBy("source_no", "block").agg(F.sum("size").alias("words"), F.min("start").alias("first"))
    blocks, _ = cut(blocks.join(per_source.select("source_no", "source_size", draw.alias("draw")), "source_no"), "blocks")
    drawn, _ = cut(_drawn_blocks(blocks), "drawn")
    tree = splitting_tree(drawn.groupBy("source_no").agg(F.count("*").cast("double").alias("n")), shards)
    ends = tree.withColumn("end", F.sum("n").over(Window.partitionBy("source_no").orderBy("shard"))).groupBy("source_no").agg(F.sort_array(F.collect_list("end")).alias("ends"))  # an end a shard
    dealt = _in_order(drawn.withColumn("one", F.lit(1)), SEED + 2, "one", "at", "pass", "block").join(ends, "source_no").select("source_no", "block", "pass", "take", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard"))
    dealt = dealt.join(blocks.select("source_no", "block", "first"), ["source_no", "block"])
    words = F.least(F.col("size"), F.col("take") - (F.col("start") - F.col("first")))
    draws = documents.select("source_no", "block", "start", "doc_id", "size").join(dealt, ["source_no", "block"]).withColumn("words", words).where("words > 0")
    draws = draws.select("source_no", "start", "doc_id", "size", "pass", "words", "block", "shard")
    return placed, draws.withColumn("key", F.xxhash64(F.lit(SEED + 1), "shard", "doc_id", "pass"))


def taken_words(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards that the document's draws went to, in ascending order."""
    placed, draws = mix(docs, shards)
    key = ["source_no", "start", "doc_id", "size"]
    whole = [F.coalesce(F.col(k), F.lit(-1)).alias(f"_{k}") if k == "doc_id" else F.col(k).alias(f"_{k}") for k in key]
    took = draws.groupBy(*key).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards")).select(*whole, "taken", "shards")
    joined = placed.join(took, (F.col("source_no") == F.col("_source_no")) & (F.col("start") == F.col("_start")) & (F.col("size") == F.col("_size")) & (F.coalesce("doc_id", F.lit(-1)) == F.col("_doc_id")), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.coalesce("shards", F.expr("cast(array() as array<int>)")).alias("shards"))
