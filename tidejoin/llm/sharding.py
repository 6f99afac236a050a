"""Sharding by balanced label propagation, in DataFrame operations only. The law is ``bytes``: shards near equal in size.

Links are groups: every two members of a group are neighbours (here, groups of equal texts; ``propagate_labels`` takes
any, and a document may be in several). Pairs are never made: a group's counts by label say how many neighbours of a
member lie where.

1. Linked documents start with a label by hash. In each round, joins give every document the number of its neighbours
   under each label, by the labels as they are now; it proposes the most frequent one (ties by a hash of group and label,
   the same for all members). Proposals are accepted from the largest gain down while the label's quota, an equal share
   of all bytes, holds. Accepted documents move, neighbours are counted anew, and rounds end when the number of cut edges
   falls no more.
2. Groups take a shard as a whole: each proposes the label that most of its bytes bear and that has room; from the
   largest group down, proposals are accepted within the quota; groups left over propose again. Rounds end when none is
   pending, or when nothing more fits: such groups outgrow every shard's room, and their members fill shards in a row,
   so they touch the fewest.
3. Unlinked documents are ballast: they fill the remaining room in three rounds, from large to small, so shards differ
   by about one small document.

Running sums are taken over hashed buckets (prefix.py). Only sums for each shard, as many as shards, reach the driver.
Joins by group have one row a group on one side, so adaptive execution can split a hot group's members.

Defined results: a null text has size 1, checksum 0, and is grouped with empty texts; equal rows are separate members
of their group; texts of any length are one document; slots number a shard's rows from 0; a null doc_id is placed like
any other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, text_bytes
from .prefix import bucket_bits, bucket_of, running

SHARDS, SEED = 8, 42
#: Parts of a shard's share that part unlinked documents into large, middle and small.
LARGE, MIDDLE = 64, 512


def _per_shard(df: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for r in df.groupBy("shard").agg(F.sum("size").alias("n")).collect():
        out[r["shard"]] = int(r["n"])
    return out


def _fill(rows: DataFrame, room: list[int]) -> DataFrame:
    """rows (with size, hash, order) get a shard: each shard a stretch of their order, in proportion to its room."""
    total = sum(room)
    if total <= 0:
        room = [1] * len(room)
        total = len(room)
    summed = running(rows.withColumn("_one", F.lit(0)), ["_one"], ["hash", "rid"], "size", "_at")
    every = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"] or 1
    ends, at = [], 0
    for r in room:
        at += r
        ends.append(at / total)
    middle = (F.col("_at") + F.col("size") / 2) / F.lit(float(every))
    shard = sum(((middle >= F.lit(e)).cast("int") for e in ends[:-1]), F.lit(0))
    return summed.withColumn("shard", shard.cast("int")).drop("_one", "_at")


def _propose(weights: DataFrame, free: list[int]) -> DataFrame:
    """weights (grp, label, w, gsize) to (grp, gsize, shard): the heaviest label with room for the whole group."""
    per_label = F.create_map(*(x for k, f in enumerate(free) for x in (F.lit(k), F.lit(f).cast("long"))))
    held = weights.groupBy("grp").agg(F.max("gsize").alias("gsize"), F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("held"))
    fits = F.filter(F.sequence(F.lit(0), F.lit(len(free) - 1)), lambda k: F.element_at(per_label, k) >= F.col("gsize"))
    ranked = F.transform(fits, lambda k: F.struct(F.coalesce(F.element_at("held", k), F.lit(0)).alias("w"), F.pmod(F.xxhash64("grp", k), F.lit(1 << 20)).alias("tie"), k.alias("shard")))
    return held.select("grp", "gsize", F.array_max(ranked)["shard"].alias("shard"))


def _from_largest(amount: Column, key: str, bits: int) -> tuple[Column, Column]:
    """hash and bucket of an order from the largest powers of two of ``amount`` down, then by hash."""
    size_class = 63 - F.floor(F.log2(amount.cast("double"))).cast("int")
    hashed = F.xxhash64(key)
    return hashed, size_class * (1 << bits) + bucket_of(hashed, bits)


def _accept(proposals: DataFrame, free: list[int]) -> DataFrame:
    """Those that fit: for each shard, from the largest group down. Order is by size class, then by hash."""
    hashed, bucket = _from_largest(F.col("gsize"), "grp", bucket_bits(proposals.count()) - 6)
    spread = proposals.withColumn("hash", hashed).withColumn("bucket", bucket)
    summed = running(spread, ["shard"], ["hash", "grp"], "gsize", "at")
    room = F.element_at(F.array(*(F.lit(f).cast("long") for f in free)), F.col("shard") + 1)
    return summed.where(F.col("at") + F.col("gsize") <= room).select("grp", "shard")


def cut_edges(labelled: DataFrame) -> int:
    """Pairs of one group (grp, shard) that bear different labels, each document in one row a group."""
    counts = labelled.groupBy("grp", "shard").agg(F.count("*").cast("decimal(38,0)").alias("n"))
    groups = counts.groupBy("grp").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return int(groups.agg(F.coalesce(F.sum((F.col("all") * F.col("all") - F.col("same")) / 2), F.lit(0))).first()[0])


def _moves(nodes: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """nodes (rid, size, shard), links (rid, grp) to (rid, size, shard, to, gain) of the documents with a better label."""
    seen = [f"n{k}" for k in range(shards)]
    placed = links.join(nodes.select("rid", "shard"), "rid")
    counts = placed.groupBy("grp").agg(*(F.count(F.when(F.col("shard") == k, 1)).alias(n) for k, n in enumerate(seen)))
    around = links.join(counts, "grp").groupBy("rid").agg(F.min("grp").alias("grp"), *(F.sum(n).alias(n) for n in seen))
    tie = lambda k: F.pmod(F.xxhash64("grp", F.lit(k)), F.lit(1 << 20))
    best = F.array_max(F.array(*(F.struct(F.col(n).alias("n"), tie(k).alias("tie"), F.lit(k).alias("k")) for k, n in enumerate(seen))))
    there = nodes.join(around.select("rid", best.alias("best"), F.array(*seen).alias("seen")), "rid")
    return there.where(F.col("best.k") != F.col("shard")).select("rid", "size", "shard", F.col("best.k").alias("to"), (F.col("best.n") - F.get("seen", F.col("shard"))).alias("gain"))


def propagate_labels(nodes: DataFrame, links: DataFrame, capacity: list[int]) -> tuple[DataFrame, list[int]]:
    """nodes (rid, size, shard) with their last labels, and the cut edges before and after each round.

    links: (rid, grp). A round that doesn't lower the cut is undone, and the last.
    """
    shards, spark = len(capacity), nodes.sparkSession
    bits = bucket_bits(nodes.count()) - 6
    links, links_path = cut(links.select("rid", "grp"), "links")
    now, path = cut(nodes.select("rid", "size", "shard"), "labels")
    cuts = [cut_edges(links.join(now, "rid"))]
    while cuts[-1]:
        room = [max(0, c - u) for c, u in zip(capacity, _per_shard(now, shards), strict=True)]
        hashed, bucket = _from_largest(F.col("gain") + 1, "rid", bits)
        spread = _moves(now, links, shards).withColumn("hash", hashed).withColumn("bucket", bucket)
        summed = running(spread, ["to"], ["hash", "rid"], "size", "at")
        accepted = summed.where(F.col("at") + F.col("size") <= F.element_at(F.array(*(F.lit(r).cast("long") for r in room)), F.col("to") + 1)).select("rid", "to")
        after, new = cut(now.join(accepted, "rid", "left").select("rid", "size", F.coalesce("to", "shard").alias("shard")), "labels")
        left = cut_edges(links.join(after, "rid"))
        if left >= cuts[-1]:
            drop(spark, new)
            break
        cuts.append(left)
        drop(spark, path)
        now, path = after, new
    drop(spark, links_path)
    return now, cuts


def propagate(linked: DataFrame, capacity: list[int]) -> tuple[DataFrame, DataFrame]:
    """linked (rid, grp, size, shard) to (grp, shard) of the groups placed whole, and the (grp) left over."""
    shards = len(capacity)
    members = linked.select("grp", "size", F.col("shard").alias("label"))
    groups = members.groupBy("grp").agg(F.sum("size").alias("gsize"))
    weights = members.groupBy("grp", "label").agg(F.sum("size").alias("w")).join(groups, "grp")
    spark = linked.sparkSession
    pending, path = cut(weights, "pending")
    placed: list[DataFrame] = []
    free = list(capacity)
    while True:  # a round with a proposal accepts the largest group of a shard at least
        proposals, proposals_path = cut(_propose(pending, free).where("shard is not null"), "proposals")
        accepted, _ = cut(_accept(proposals, free).join(proposals, ["grp", "shard"]).select("grp", "shard", "gsize"), "accepted")
        drop(spark, proposals_path)
        used = _per_shard(accepted.withColumnRenamed("gsize", "size"), shards)
        if not sum(used):
            break
        placed.append(accepted.select("grp", "shard"))
        free = [f - u for f, u in zip(free, used, strict=True)]
        after, new = cut(pending.join(accepted, "grp", "left_anti"), "pending")
        drop(spark, path)
        pending, path = after, new
        if pending.isEmpty():
            break
    done = members.select("grp", F.col("label").alias("shard")).where(F.lit(False))
    for p in placed:
        done = done.unionByName(p)
    return done, pending.select("grp").distinct()


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs (doc_id, text) to doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows."""
    text = F.coalesce("text", F.lit(""))
    base, base_path = cut(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), (text_bytes(F.col("text")) + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("grp")), "rows")
    counts = base.groupBy("grp").agg(F.count("*").alias("group_rows"))
    hashed = base.join(counts, "grp").withColumn("hash", F.xxhash64(F.lit(SEED), "doc_id", "grp"))
    bits = bucket_bits(base.count())
    rows, _ = cut(hashed.withColumn("bucket", bucket_of(F.col("hash"), bits)), "grouped")
    drop(docs.sparkSession, base_path)
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = [total * (k + 1) // shards - total * k // shards for k in range(shards)]
    columns = ["rid", "doc_id", "size", "text_crc32", "group_rows", "hash", "bucket", "shard"]

    linked, single = rows.where("group_rows > 1"), rows.where("group_rows = 1")
    start = linked.select("rid", "size", F.pmod("hash", F.lit(shards)).cast("int").alias("shard"))
    labels, _ = propagate_labels(start, linked, capacity)
    done, left = propagate(linked.select("rid", "grp").join(labels, "rid"), capacity)
    parts = [cut(linked.join(done, "grp").select(*columns), "placed")[0]]
    used = _per_shard(parts[0], shards)
    room = lambda: [max(0, c - u) for c, u in zip(capacity, used, strict=True)]

    def add(part: DataFrame) -> None:
        placed, _ = cut(_fill(part, room()).select(*columns), "placed")
        parts.append(placed)
        for k, n in enumerate(_per_shard(placed, shards)):
            used[k] += n

    share = max(1, total // shards)
    # Members of a group that no shard can hold stand side by side.
    if not left.isEmpty():
        by_group = F.xxhash64("grp")
        add(linked.join(left, "grp", "left_semi").withColumn("bucket", bucket_of(by_group, bits)).withColumn("hash", by_group))
    for low, high in ((share // LARGE, None), (share // MIDDLE, share // LARGE), (0, share // MIDDLE)):
        add(single.where((F.col("size") > low) & (F.lit(True) if high is None else F.col("size") <= high)))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return _slots(out, bits).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows")


def _slots(rows: DataFrame, bits: int) -> DataFrame:
    at = F.xxhash64("doc_id", "rid")
    spread = rows.withColumn("hash", at).withColumn("bucket", bucket_of(F.col("hash"), bits)).withColumn("_n", F.lit(1).cast("long"))
    return running(spread, ["shard"], ["hash", "rid"], "_n", "slot")
