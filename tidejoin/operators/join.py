"""The windowed equi-join and its outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ALGORITHMS, JoinSpec
from .skew import hot_keys, with_cells
from .windows import assign_windows, sides

RESULT = ("lkey", "rkey", "lval", "rval", "lts", "rts")
WORD = 32  # right tuples in a bitmap word
HYBRID_SALTS = 8
#: Tuples of both sides that a task of a skewed join takes, about: its hash table can't spill.
TASK_ROWS = 1 << 20


def _dealt(left: DataFrame, right: DataFrame, tuples: DataFrame, spec: JoinSpec) -> tuple[DataFrame, DataFrame]:
    """Both sides dealt by window (INTER), or by window and salt (HYBRID), whose salt is also a join key so that the deal
    holds. A hot key has several salts, so that its tuples are spread."""
    if spec.parallel == "INTER":
        return left.repartition("win"), right.repartition("rwin")
    if spec.parallel == "HYBRID":
        hot = hot_keys(tuples)
        salt = lambda key: F.pmod(F.hash(key), F.lit(HYBRID_SALTS))
        left = with_cells(left, hot, "win", "lkey", "lseq", True, "lkey_salt", salt("lkey"))
        right = with_cells(right, hot, "rwin", "rkey", "rseq", False, "rkey_salt", salt("rkey"))
        return left.repartition("win", "lkey_salt"), right.repartition("rwin", "rkey_salt")
    return left, right


def _joined(left: DataFrame, right: DataFrame, spec: JoinSpec) -> DataFrame:
    same = F.col("win") == F.col("rwin")
    if "lkey_salt" in left.columns:
        same = same & (F.col("lkey_salt") == F.col("rkey_salt"))
    if spec.algorithm == "EMPTY":
        same = F.lit(False)
    match = (F.col("lkey") - F.col("rkey") == 0) if spec.algorithm == "NLJ" else (F.col("lkey") == F.col("rkey"))
    return left.join(right.hint(ALGORITHMS[spec.algorithm]), same & match).drop("rwin", "lkey_salt", "rkey_salt")


def window_join(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Matches of batched tuples: win, lkey, lval, lts, lseq, larr, rkey, ...

    The algorithm is a hint; null keys never match. The nested-loop form keeps keys out of the join's hash: windows
    meet by hash, and all pairs of a window are compared, never pairs of different windows.
    """
    placed = assign_windows(tuples, spec)
    left, right = sides(placed)
    return _joined(*_dealt(left.where("lkey is not null"), right.where("rkey is not null"), placed, spec), spec)


def skew_join(tuples: DataFrame, spec: JoinSpec, tasks: int | None = None) -> DataFrame:
    """window_join() with hot keys split over tasks (see skew.py), for rows; counts need no pairs (count_by_window).
    Large inputs are dealt into as many partitions as keep a task's hash table small."""
    placed = assign_windows(tuples, spec)
    hot = hot_keys(placed, tasks)
    left, right = sides(placed)
    left = with_cells(left.where("lkey is not null"), hot, "win", "lkey", "lseq", True, "lkey_salt")
    right = with_cells(right.where("rkey is not null"), hot, "rwin", "rkey", "rseq", False, "rkey_salt")
    parts = -(-placed.count() // TASK_ROWS)
    if parts > int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(parts, "win", "lkey", "lkey_salt"), right.repartition(parts, "rwin", "rkey", "rkey_salt")
    return _joined(left, right, spec)


def materialize(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    return window_join(tuples, spec).select("win", *RESULT)


def count_by_window(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Matches of each window that has any.

    Hash and merge joins meet on each side's counts of a key, which multiply, so a hot key costs a row a window and no
    pair is made. A nested loop compares all pairs; that is what it is for.
    """
    if spec.algorithm in ("NLJ", "EMPTY"):
        return window_join(tuples, spec).groupBy("win").agg(F.count("*").alias("matches"))
    left, right = sides(assign_windows(tuples, spec))
    left, right = left.where("lkey is not null").select("win", "lkey"), right.where("rkey is not null").select("rwin", "rkey")
    if spec.parallel == "INTER":
        left, right = left.repartition("win"), right.repartition("rwin")
    if spec.parallel == "HYBRID":
        salt = lambda key: F.pmod(F.hash(key), F.lit(HYBRID_SALTS))
        left, right = left.withColumn("lkey_salt", salt("lkey")), right.withColumn("rkey_salt", salt("rkey"))
        left, right = left.repartition("win", "lkey_salt"), right.repartition("rwin", "rkey_salt")
    count = lambda df, n: df.groupBy(*df.columns).agg(F.count("*").alias(n))
    return _joined(count(left, "l"), count(right, "r"), spec).groupBy("win").agg(F.sum(F.col("l") * F.col("r")).alias("matches"))


def histogram(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Tuples of each side, window and key."""
    return assign_windows(tuples, spec).groupBy("side", "win", "key").agg(F.count("*").alias("n"))


def count_by_histogram(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """Matches of each window as products of the sides' counts of a key; no pair is made, so hot keys cost one row."""
    each = lambda s: F.count(F.when(F.col("side") == s, 1))
    both = assign_windows(tuples, spec).where("key is not null").groupBy("win", "key").agg(each("L").alias("l"), each("R").alias("r"))
    return both.where("l > 0 and r > 0").groupBy("win").agg(F.sum(F.col("l") * F.col("r")).alias("matches"))


def bitmap(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """For each left tuple and word of 32 right positions, the bits of its matches."""
    bit = F.expr(f"shiftleft(1L, cast(rseq % {WORD} as int))")
    return window_join(tuples, spec).groupBy("win", "lseq", F.floor(F.col("rseq") / WORD).alias("word")).agg(F.bit_or(bit).alias("bits"))


def decode_bitmap(bits: DataFrame) -> DataFrame:
    """Bitmap words back to (win, lseq, rseq)."""
    at = bits.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where(F.expr("(shiftright(bits, bit) & 1) = 1"))
    return at.select("win", "lseq", (F.col("word") * WORD + F.col("bit")).alias("rseq"))


def selectivity(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """One row: windows, matches, possible matches, and their share in percent (null without possible matches).

    A lazy window counts as executed when it joins, an eager one when it is cleared, so the open last one doesn't.
    """
    each = lambda s: F.count(F.when(F.col("side") == s, 1))
    sizes = assign_windows(tuples, spec).groupBy("win").agg(each("L").alias("l"), each("R").alias("r"))
    table = sizes.join(count_by_histogram(tuples, spec), "win", "left")
    executed = F.count("*") if spec.progress == "LAZY" else F.coalesce(F.max("win"), F.lit(0).cast("long"))
    sums = table.agg(executed.alias("windows"), F.coalesce(F.sum("matches"), F.lit(0)).alias("matches"), F.coalesce(F.sum(F.col("l") * F.col("r")), F.lit(0)).alias("possible"))
    return sums.withColumn("selectivity", 100.0 * F.col("matches") / F.nullif(F.col("possible"), F.lit(0)))


def by_window(tuples: DataFrame, spec: JoinSpec) -> DataFrame:
    """win, matches, possible_matches, selectivity of every executed window, also those without a match."""
    each = lambda s: F.count(F.when(F.col("side") == s, 1))
    sizes = assign_windows(tuples, spec).groupBy("win").agg((each("L") * each("R")).alias("possible_matches"))
    joined = sizes.join(count_by_window(tuples, spec), "win", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return joined.select("win", "matches", "possible_matches", (100.0 * F.col("matches") / F.nullif(F.col("possible_matches"), F.lit(0))).alias("selectivity"))
