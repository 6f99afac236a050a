"""SpotSigs fingerprints and near-duplicate classes, in DataFrame operations only.

A signature is a common-word anchor with the CHAIN content words that follow it. Words are lower-cased runs of letters
and digits. A text without an anchored chain uses, for each content word, the word and its successor; one without
content words uses its words; one without words uses the text itself. So every text has signatures, as hashes of 32
bits, and its fingerprint is their sorted set in hexadecimal, eight digits each. Likeness is the sets' Jaccard index.

The join: equal fingerprints form one class representative; representatives are partitioned by set length, so that
two sets of a likeness over the threshold lie in one length partition or in neighbours; within these, rarest-first
prefixes meet (two alike sets share an element of their prefixes), pairs whose lengths or remaining lengths rule the
threshold out are pruned, and the rest is compared exactly. Classes are the components of the links.

Defined results: a null text is the empty one; equal texts have equal fingerprints and likeness 1; texts of any length
are read whole; rows with equal doc_id are successive documents, in the order of their texts' digests, and repeated rows
succeed each other; a null doc_id comes last; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop
from .components import components

CHAIN = 2
THRESHOLD = 0.8
#: Rows, about, of a range of doc_ids whose successors one window finds, and the most ranges.
RANGE_ROWS, MOST_RANGES = 1024, 16_384

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it for on with as was at by from be are this have or an not but which you he they his her"
    " der die das und ist von zu den mit sich des auf für nicht ein eine dem im als auch es an werden aus er hat dass sie nach"
    " le la les de et un une du en que qui dans est pour pas sur au par plus ne se ce il avec sont"
    " el los las y del por con no una su para al lo como más o pero sus"
)
_ANCHORS = sorted(set(ANCHORS.split()))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _short(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(0xFFFFFFFF))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the sorted distinct signatures (array<long>) of a text column without nulls."""
    w, c, a = f"_{out}_w", f"_{out}_c", f"_{out}_a"
    split = df.withColumn(w, _words(F.col(text)))
    split = split.withColumn(c, F.filter(w, lambda x: ~x.isin(_ANCHORS)))
    # Anchors with their places: of the words before place i, k are anchors, so i - k content words precede it.
    split = split.withColumn(a, F.filter(F.transform(w, lambda x, i: F.when(x.isin(_ANCHORS), F.struct(i.alias("i"), x.alias("x")))), lambda s: s.isNotNull()))
    size = F.size(c)
    chained = F.transform(a, lambda s, k: F.when(s["i"] - k + CHAIN <= size, _short(s["x"], *(F.col(c)[s["i"] - k + j] for j in range(CHAIN)))))
    anchored = F.filter(chained, lambda h: h.isNotNull())
    pairs = F.transform(c, lambda x, i: _short(F.lit(""), x, F.coalesce(F.get(F.col(c), i + 1), F.lit(""))))
    plain = F.transform(w, lambda x: _short(F.lit(" "), x))
    split = split.withColumn(out, anchored)
    chosen = F.when(F.size(out) > 0, F.col(out)).when(size > 0, pairs).when(F.size(w) > 0, plain).otherwise(F.array(_short(F.lit("  "), F.col(text))))
    return split.withColumn(out, F.array_sort(F.array_distinct(chosen))).drop(w, c, a)


def spell(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def with_next(docs: DataFrame, prepared=lambda rows: rows, *more: str) -> DataFrame:
    """docs (doc_id, text) with the next row's text in descending doc_id order (``next``); after the last comes the first.

    ``prepared`` adds the columns ``more`` to each row after the shuffle, once, and these are carried to ``next_`` too.
    Rows are dealt by ranges of doc_id of about RANGE_ROWS rows; the first row of each range (and of all, for the last)
    also stands at the end of the range before it, so every window holds its rows' successors. A range's bound is one
    number, and MOST_RANGES at most reach the driver. Texts are shuffled once.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = min(MOST_RANGES, max(16, docs.count() // RANGE_ROWS))
    bounds = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    bounds = sorted(set(bounds or []))
    if bounds:  # position in the sorted bounds; a null doc_id, the last in descending order, goes to the lowest range
        sorted_bounds = F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
        jumps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
        below = lambda p, j: (p + j <= len(bounds)) & (F.get(sorted_bounds, F.least(p + j, F.lit(len(bounds))) - 1) < F.col("doc_id"))
        place = F.aggregate(jumps, F.lit(0), lambda p, j: F.when(below(p, j), p + j).otherwise(p))  # a binary search
        bucket = F.coalesce(place, F.lit(0))
    else:
        bucket = F.lit(0)
    placed = rows.withColumn("bucket", bucket)
    order = [F.desc_nulls_last("doc_id"), F.md5("text")]
    # A range's head is its largest doc_id; it also goes to the range of the next larger ids, the largest to the lowest.
    up = Window.orderBy("bucket")  # a row a range
    goes = F.coalesce(F.lead("bucket").over(up), F.min("bucket").over(Window.partitionBy(F.lit(0))))
    heads = placed.groupBy("bucket").agg(F.max("doc_id").alias("head")).withColumn("goes", goes)
    copies = placed.join(F.broadcast(heads), "bucket").where(F.col("doc_id").eqNullSafe(F.col("head")))  # MOST_RANGES heads at most
    first = copies.groupBy("bucket").agg(F.min_by("text", F.md5("text")).alias("text"), F.first("doc_id").alias("doc_id"), F.first("goes").alias("bucket2"))
    extra = first.select("doc_id", "text", F.col("bucket2").alias("bucket"), F.lit(1).alias("extra"))
    every = prepared(placed.select("doc_id", "text", "bucket", F.lit(0).alias("extra")).unionByName(extra).repartition("bucket"))
    after = Window.partitionBy("bucket").orderBy(F.col("extra"), *order)
    led = every.withColumn("next", F.lead("text").over(after)).withColumns({f"next_{c}": F.lead(c).over(after) for c in more})
    return led.where("extra = 0").select("doc_id", "text", "next", *more, *(f"next_{c}" for c in more))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts, of their edited forms, and likeness to these and to the next document's.

    Each text is signed once, where it stands with its successor, and each edited text once.
    """
    pairs = with_next(docs, lambda rows: with_signatures(rows, "text", "own"), "own")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("substring(next, 1, cast(floor(length(text) / 2) as int))"))
    texts = pairs.select("doc_id", "own", "next_own", n.cast("long").alias("n_chars"), F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"))
    signed = with_signatures(texts, "edited", "changed")
    return signed.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spell("own").alias("fingerprint"), spell("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"), F.size("own").alias("n_signatures"),
    )


def duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to (doc_id, class_id, n_links): the smallest doc_id of its class, links to other sets.

    The threshold is taken as the decimal it is written as, up / down, and compared in whole numbers: c common of n and m
    signatures reach it if c * (up + down) >= up * (n + m).
    """
    up, down = Fraction(str(threshold)).as_integer_ratio()
    signed = with_signatures(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "text", "s")
    rows, _ = cut(signed.select("doc_id", "s", F.md5(spell("s")).alias("key")), "signatures")
    reps, _ = cut(rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("s").alias("s")).withColumn("n", F.size("s")), "sets")
    items = reps.select("rep", "n", F.explode("s").alias("h"))
    seen = items.groupBy("h").agg(F.count("*").alias("df"))
    ranked = items.join(seen, "h").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("o"))
    # Partitions are a little wider than the threshold's ratio, so sets at exactly that ratio never lie two apart.
    length = F.floor(F.log(F.col("n")) / (math.log(down / up) * (1 + 1e-9))).cast("int")
    prefix = F.expr(f"cast(n - ({up} * n + {down - 1}) div {down} + 1 as int)")
    heads = ranked.select("rep", "n", length.alias("part"), F.posexplode(F.slice("o", 1, prefix)).alias("pos", "e")).select("rep", "n", "part", "pos", F.col("e.h").alias("h"))
    left = heads.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), "h", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = heads.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), "h", "part")
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (down * F.col("na") >= up * F.col("nb")) & ((up + down) * (rest + F.least("pa", "pb")) >= up * (F.col("na") + F.col("nb")))
    pairs = left.join(right, ["h", "part"]).where(shorter & fits).select("a", "b").distinct()
    sets = reps.select("rep", "s")
    compared = pairs.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
    enough = (up + down) * F.size(F.array_intersect("sa", "sb")) >= up * (F.size("sa") + F.size("sb"))
    links, _ = cut(compared.where(enough).select("a", "b"), "links")
    root = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = reps.select("key", "rep").join(root, F.col("rep") == F.col("node"), "left").join(ends, "rep", "left")
    named = named.select("key", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    return rows.select("doc_id", "key").join(named, "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "n_links")
