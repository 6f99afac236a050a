"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters, digits and underscores, and stand as 64-bit hashes. Seeds are an item's trigrams,
and its spaced trigrams (two words, any word, a third), which stay whole where every third word was replaced. One join of
all documents' n-grams with all items' seeds gives hits; how many hits a seed has, over all documents, tells rare seeds
from common ones. Hits of a text and an item on about one diagonal are one candidate passage if one of them is rare, or
if common ones stand at two places of the item, so a phrase that every document holds makes no candidate by itself.
Seeds of items with fewer than FEW of them count as rare. A second join, of candidates and stretches of the texts, cuts
the passages. A passage that holds too few of the item's words to reach the threshold even if all of them matched is
passed over, which loses nothing; local alignment of passage and item (match 2, mismatch and gap -1) scores the others
as a share of the item's perfect score. A document is contaminated at THRESHOLD or more. Out of reach: copies that keep no
seed, or only one and that common, and what lies beyond a passage (the item's length, and one to two quarters of it on
either side). Recall against all alignments over the threshold is tested: 0.99 or more on random edits.

Texts are keyed by digest, since a match depends on the text alone: equal texts are aligned once and share the result.
Documents are scanned twice, whatever the number of items; the second time only texts with a candidate are split into
words. Seeds and the keys of these texts are broadcast up to BROADCAST_SEEDS rows, and shuffled beyond that; both joins
give the same rows. There is no cap on hits, passages or partners.

Defined results: a null or wordless text is clean; items with fewer than NGRAM words, or null, match nothing; an item
with a null item_id is one like any other; items of one text or one item_id are separate, and a pair of a document and an
item_id counts once; of equal scores the smallest item_id is reported, null first; each row is judged by its own text,
so repeated rows agree and rows that only share a doc_id don't; texts of any length are read whole; other columns are
ignored; an empty benchmark gives all-clean results, empty documents an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, prepare, release

NGRAM = 3
#: Offsets of a seed's words.
SHAPES = ((0, 1, 2), (0, 1, 3))
THRESHOLD = 0.4
#: A seed is common if it has more hits than this share of all hits; an item with fewer seeds than FEW has only rare ones.
COMMON, FEW = 1e-4, 6
#: Hits that a seed may have at any size of the corpus and still be rare.
RARE_HITS = 64
#: Seeds up to this many rows (24 bytes each, less than 100 MB as a hash table) are broadcast.
BROADCAST_SEEDS = 1 << 20
#: Words, at least, of the stretches in which texts are shuffled to their candidates.
CHUNK = 1024
MATCH, MISS, GAP = 2, -1, -1
_CELLS = 1 << 22
_WORD = r"[\p{L}\p{N}_]+"

MATCHES = "key string, item long, score double, first_word long, n_words long"


def word_ids(text: Column) -> Column:
    """Hashes of a text's words; none for a null."""
    return F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0)), lambda w: F.xxhash64(w))


def _with_grams(df: DataFrame, *columns: str) -> DataFrame:
    """df (ids, ...) to columns, at, seed: the place and hash of every n-gram of SHAPES; at the end, of the words there are."""
    # Places are numbered and n-grams taken from ids, row by row in compiled code; as a list of n-grams made by transform()
    # each would be interpreted. The outer form, since the filter that an inner one implies would be pushed to where ids are made.
    n = F.size("ids") - (NGRAM - 1)
    numbers = F.when(n > 0, F.sequence(F.lit(0), len(SHAPES) * n - 1))
    numbered = df.select(*columns, "ids", F.explode_outer(numbers).alias("_number")).where("_number is not null")
    at = F.expr(f"_number div {len(SHAPES)}").cast("int")
    grams = [F.xxhash64(F.lit(k), *(F.get("ids", at + o) for o in shape)) for k, shape in enumerate(SHAPES)]
    seed = grams[-1]
    for k in reversed(range(len(SHAPES) - 1)):
        seed = F.when(F.col("_number") % len(SHAPES) == k, grams[k]).otherwise(seed)
    return numbered.select(*columns, at.alias("at"), seed.alias("seed"))


def _with_chunks(texts: DataFrame, over: int) -> tuple[DataFrame, int]:
    """texts (key, ids) to (key, chunk, ids): stretches of ``step`` words, each with the ``over`` words that follow."""
    step = max(CHUNK, over)
    ids = F.col("ids")
    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(ids) - 1, F.lit(0)) / step).cast("int")), lambda c: F.struct(c.alias("chunk"), F.slice(ids, c * step + 1, F.lit(step + over)).alias("ids")))
    return texts.select("key", F.explode_outer(chunks).alias("c")).select("key", "c.chunk", "c.ids"), step


def text_key(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def align(passages: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each passage row with its item row: score, and its last passage and item positions.

    passages [n, m] and items [n, k] hold word numbers; those below 0 match nothing (-1 in passages, -2 in items).
    """
    n, m = passages.shape
    ramp = (-GAP * np.arange(m)).astype(np.int32)
    h = np.zeros((n, m + 1), np.int32)
    best, where, row = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(items.shape[1]):
        word = items[:, i : i + 1]
        t = h[:, :-1] + np.where(passages == word, MATCH, MISS)
        np.maximum(t, h[:, 1:] + GAP, out=t)
        np.maximum(t, 0, out=t)
        t += ramp  # a run of gaps in the item: the best earlier cell, less a gap a step
        np.maximum.accumulate(t, axis=1, out=t)
        t -= ramp
        h = np.concatenate([np.zeros((n, 1), np.int32), t.astype(np.int32)], axis=1)
        h[word[:, 0] == -2] = 0
        top = h[:, 1:].argmax(axis=1)
        value = h[np.arange(n), top + 1]
        better = value > best
        best[better], where[better], row[better] = value[better], top[better], i
    return best, where, row


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.int64)
    for r, x in enumerate(rows):
        out[r, : len(x)] = x
    return out


def _aligned(passages: list[np.ndarray], items: list[np.ndarray], threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """Index, score, first word in the passage and number of words of each alignment that counts."""
    order = sorted(range(len(passages)), key=lambda k: len(passages[k]))
    at = 0
    while at < len(order):
        width = max(1, len(passages[order[min(at + 999, len(order) - 1)]]))
        part = order[at : at + max(1, min(1000, _CELLS // width))]
        at += len(part)
        best, end, _ = align(_padded([passages[k] for k in part], -1), _padded([items[k] for k in part], -2))
        score = best / np.asarray([MATCH * len(items[k]) for k in part])
        good = np.flatnonzero(score >= threshold)
        if not len(good):
            continue
        hit = [(part[g], int(end[g]) + 1) for g in good]  # from the end back: where the best alignment began
        _, back, _ = align(_padded([passages[k][:stop][::-1] for k, stop in hit], -1), _padded([items[k][::-1] for k, _ in hit], -2))
        for (k, stop), s, b in zip(hit, score[good].tolist(), back.tolist(), strict=True):
            yield k, s, stop - b - 1, b + 1


def _search(threshold: float):
    """Rows (key, item, start, passage, words) to MATCHES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            passages, items = ([np.asarray(x, np.int64) for x in b.column(c).to_pylist()] for c in (3, 4))
            found = list(_aligned(passages, items, threshold))
            if found:
                rows, score, first, size = (list(v) for v in zip(*found, strict=True))
                starts = b.column(2).to_pylist()
                columns = [b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows)), pa.array(score), pa.array([starts[k] + f for k, f in zip(rows, first, strict=True)], pa.int64()), pa.array(size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in MATCHES.split(", ")])

    return run


def _bounded(rows: DataFrame) -> DataFrame:
    """A table of a row a seed, item or text with a candidate: broadcast up to BROADCAST_SEEDS rows, shuffled beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_SEEDS else rows.hint("merge")


def find_text_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (text) to (key, item_id, score, first_word, n_words): every pair of a distinct text and an item_id that
    matches, with its best alignment."""
    prepare(docs.sparkSession)
    # Items number in the thousands to millions and are written once, numbered.
    items, _ = cut(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long"), word_ids(F.col("text")).alias("words")).where(F.size("words") >= NGRAM), "items")
    seeds, seeds_path = cut(_with_grams(items.select("item", F.size("words").alias("n"), F.col("words").alias("ids")), "item", "n").withColumnRenamed("at", "place"), "seeds")
    small = seeds.count() <= BROADCAST_SEEDS
    texts = docs.select(text_key(F.col("text")).alias("key"), word_ids(F.col("text")).alias("ids"))
    found = _with_grams(texts, "key").join(F.broadcast(seeds) if small else seeds.hint("merge"), "seed")
    slack = F.greatest(F.lit(6), F.floor(F.col("n") / 4)).cast("int")
    banded = found.withColumn("slack", slack).select("key", "item", "n", "slack", F.floor((F.col("at") - F.col("place")) / F.col("slack")).alias("band"), "place", "seed")
    # A row a text, item, diagonal, place and seed, however often the text, or the seed in it, is repeated.
    hits, hits_path = cut(banded.distinct(), "hits")
    counts = hits.groupBy("seed").agg(F.countDistinct("key", "item").alias("hits"))
    total = counts.agg(F.coalesce(F.sum("hits"), F.lit(0))).first()[0]
    common = counts.where(F.col("hits") > max(RARE_HITS, COMMON * total)).select("seed", F.lit(True).alias("common"))
    few = seeds.groupBy("item").agg(F.count("*").alias("seeds")).where(F.col("seeds") < FEW).select("item", F.lit(True).alias("few"))
    told = hits.join(_bounded(common), "seed", "left").join(_bounded(few), "item", "left")
    rare = F.col("common").isNull() | F.col("few").isNotNull()
    near = told.groupBy("key", "item", "n", "slack", "band").agg(F.bool_or(rare).alias("rare"), F.min("place").alias("low"), F.max("place").alias("high")).where("rare or low < high")
    start = ((F.col("band") - 1) * F.col("slack")).cast("int")
    spans = near.select("key", "item", F.greatest(start, F.lit(0)).alias("start"), (start + 3 * F.col("slack") + F.col("n")).alias("stop"))
    candidates, candidates_path = cut(spans, "candidates")
    drop(docs.sparkSession, seeds_path)
    drop(docs.sparkSession, hits_path)
    # Only texts with a candidate are split again, and cut into stretches.
    wanted, wanted_path = cut(candidates.select("key").distinct(), "wanted")
    keyed = docs.select(text_key(F.col("text")).alias("key"), "text").join(_bounded(wanted), "key", "left_semi")
    texts = keyed.select("key", word_ids(F.col("text")).alias("ids"))
    # Candidates grow with the documents, so the plan that shuffles both sides is taken at every size.
    longest = items.agg(F.coalesce(F.max(F.size("words")), F.lit(0))).first()[0]
    chunks, step = _with_chunks(texts, longest + 3 * max(6, longest // 4))
    begins = candidates.withColumn("chunk", F.floor(F.col("start") / step).cast("int"))
    cutting = chunks.join(begins.hint("merge"), ["key", "chunk"]).select("key", "item", "start", F.slice("ids", F.col("start") - F.col("chunk") * step + 1, F.col("stop") - F.col("start")).alias("passage"))
    by_item = items.select("item", "words")
    by_item = F.broadcast(by_item) if small else by_item.hint("merge")  # its words are no more than its seeds and two an item
    most = F.size("words") - F.size(F.array_except("words", "passage"))  # words of the item that the passage may hold
    possible = cutting.join(by_item, "item").where(most >= F.lit(threshold) * F.size("words") - 1e-9)
    once = possible.groupBy("key", "item", "start").agg(F.first("passage").alias("passage"), F.first("words").alias("words"))
    found, _ = cut(once.mapInArrow(_search(threshold), MATCHES), "matches")
    drop(docs.sparkSession, candidates_path)
    drop(docs.sparkSession, wanted_path)
    best = F.min(F.struct((-F.col("score")).alias("order"), "first_word", "n_words")).alias("m")
    named = found.join(items.select("item", "item_id"), "item")
    return named.groupBy("key", "item_id").agg(best).select("key", "item_id", (-F.col("m.order")).alias("score"), "m.first_word", "m.n_words")


def find_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) to (doc_id, item_id, score, first_word, n_words): a row for each row and item_id that match."""
    keyed = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"))
    return keyed.join(find_text_matches(docs, benchmark, threshold), "key").drop("key")


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs to (doc_id, contaminated, item_id, score, first_word, n_words, n_items), a row for each row of docs.

    The best match, and the number of items that match; find_matches has each of them.
    """
    worst = F.min(F.struct((-F.col("score")).alias("order"), "item_id", "first_word", "n_words")).alias("m")
    best, _ = cut(find_text_matches(docs, benchmark, threshold).groupBy("key").agg(worst, F.count("*").alias("n_items")), "best")
    joined = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key")).join(best, "key", "left")
    return joined.select("doc_id", F.col("m").isNotNull().alias("contaminated"), "m.item_id", (-F.col("m.order")).alias("score"), "m.first_word", "m.n_words", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"))


def drop_matches(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text matches no item."""
    found, _ = cut(find_text_matches(docs, benchmark, threshold).select("key").distinct(), "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("key"))
    return rows.join(found, "key", "left_anti").select("row.*")
