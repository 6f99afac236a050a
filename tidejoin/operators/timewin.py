"""Time windows: data-driven ones, cut at batches by a watermark, and aligned tumbling ones.

The watermark is the largest last timestamp of any batch so far; a window closes at the first batch that takes it
``width`` beyond the close before. The crossing batch still belongs to a lazy window, and opens the next eager one.
Lazy windows that never close don't join.

Up to CHAIN batches, a row each, one task follows the closes in order. Beyond, each batch points to the one that would
close next if a window closed at it, and the chain of closes from the first batch is found by pointer doubling: each
round doubles the pointers' reach, so n windows take about log2(n) rounds of joins, two rounds a table in the shared
folder. Both give the same windows. Tuples are numbered once, in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_max, running_sum
from ..model import one_of
from ..sources.scratch import cut, drop
from .join import RESULT
from .windows import arrival


#: Batches, a row of two numbers each, that one task takes in order.
CHAIN = 1 << 16


def _in_order(width_ms: int, lazy: bool):
    """Rows (arr, last) of all batches to (arr, win), without the batches of a lazy window that never closes."""

    def run(parts):
        import pandas as pd

        rows = pd.concat(list(parts), ignore_index=True).sort_values("arr")
        wm = rows["last"].cummax().tolist()
        origin, win, wins = (wm[0] if wm else 0), 0, []
        for w in wm:
            crosses = w - origin >= width_ms
            win += crosses and not lazy
            wins.append(win)
            if crosses:
                origin, win = w, win + lazy
        out = pd.DataFrame({"arr": rows["arr"].to_numpy("int64"), "win": pd.array(wins, "int64")})
        yield out[out["win"] < win] if lazy else out

    return run


def _pointers(batches: DataFrame, width_ms: int) -> DataFrame:
    """batches (arr, wm), arr gapless and wm ascending, to arr, nxt: the first batch whose watermark is ``width_ms`` further.

    Watermarks fall into cells of that width, and the wanted batch lies in the cell after this one's, or follows the
    last batch of that cell, or of this one if that has none. Batches of one cell meet in a window.
    """
    cell = F.floor(F.col("wm") / width_ms)
    own = batches.select(cell.alias("cell"), F.col("wm").alias("x"), F.lit(0).alias("asks"), "arr")
    asks = batches.select((cell + 1).alias("cell"), (F.col("wm") + width_ms).alias("x"), F.lit(1).alias("asks"), "arr")
    down = Window.partitionBy("cell").orderBy(F.desc("x"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("asks") == 0, F.col("arr")))
    inside = own.union(asks).withColumn("found", first.over(down)).where("asks = 1")
    after = own.groupBy("cell").agg((F.max("arr") + 1).alias("after"))
    here = after.select((F.col("cell") + 1).alias("cell"), F.col("after").alias("after_own"))
    joined = inside.join(after, "cell", "left").join(here, "cell").select("arr", F.coalesce("found", "after", "after_own").alias("nxt"))
    known = batches.select(F.col("arr").alias("nxt"))
    return joined.join(known.withColumn("is", F.lit(True)), "nxt", "left").select("arr", F.when(F.col("is"), F.col("nxt")).alias("nxt"))


def _closes(pointers: DataFrame, most: int) -> DataFrame:
    """pointers (arr, nxt) to (arr) of the batches, ``most`` at most, that the chain from batch 0 meets."""
    spark = pointers.sparkSession
    now, path = cut(pointers.select("arr", "nxt", (F.col("arr") == 0).alias("met")), "chain")
    rounds = most.bit_length()  # after k rounds, 2 ** k - 1 steps are met
    for k in range(1, rounds + 1):
        # What a met batch points to is met; then every pointer takes two steps at once.
        ahead = now.where("met and nxt is not null").select(F.col("nxt").alias("arr"), F.lit(True).alias("hit"))
        twice = now.select(F.col("arr").alias("nxt"), F.col("nxt").alias("nxt2"))
        joined = now.join(ahead, "arr", "left").join(twice, "nxt", "left")
        now = joined.select("arr", F.col("nxt2").alias("nxt"), (F.col("met") | F.coalesce("hit", F.lit(False))).alias("met"))
        if k % 2 == 0 or k == rounds:  # two rounds a table
            now, new = cut(now, "chain")
            drop(spark, path)
            path = new
    return now.where("met and arr > 0").select("arr")


def batch_windows(tuples: DataFrame, width_ms: int, progress: str = "LAZY") -> DataFrame:
    """arr, win of every batch, from batched tuples. One row a batch: all that follows the first aggregate is small."""
    one_of("progress", progress, ("LAZY", "EAGER"))
    last = tuples.groupBy(arrival().alias("arr")).agg(F.max_by(F.unix_millis(F.col("ts").cast("timestamp")), "seq").alias("last"))
    lasts, path = cut(last, "lasts")
    n, low, high = lasts.agg(F.count("*"), F.min("last"), F.max("last")).first()
    if n <= CHAIN:
        return lasts.coalesce(1).mapInPandas(_in_order(width_ms, progress == "LAZY"), "arr long, win long")
    batches, _ = cut(running_max(lasts, "arr", "last", "wm").select("arr", "wm"), "batches")
    drop(tuples.sparkSession, path)
    closes = _closes(_pointers(batches, width_ms), (high - low) // width_ms).select("arr", F.lit(1).alias("closes"))  # each takes the watermark a width further
    flagged = batches.select("arr").join(closes, "arr", "left").withColumn("closes", F.coalesce("closes", F.lit(0)))
    win = running_sum(flagged, "arr", "closes", "win", before=progress == "LAZY").select("arr", "win")
    if progress == "EAGER":
        return win
    return win.join(F.broadcast(closes.agg(F.count("*").alias("n"))), F.col("win") < F.col("n"), "left_semi")  # one row


def time_join(tuples: DataFrame, width_ms: int, progress: str = "LAZY") -> DataFrame:
    """Matches inside data-driven time windows: win and the result columns."""
    numbered, _ = cut(tuples.select("side", "key", "val", "ts", "seq", "batch"), "numbered")
    placed = numbered.withColumn("arr", arrival()).join(batch_windows(numbered, width_ms, progress), "arr")
    part = lambda s, p: placed.where(F.col("side") == s).select(F.col("win").alias(f"{p}win"), *(F.col(c).alias(f"{p}{c}") for c in ("key", "val", "ts")))
    joined = part("L", "l").join(part("R", "r"), (F.col("lwin") == F.col("rwin")) & (F.col("lkey") == F.col("rkey")))
    return joined.select(F.col("lwin").alias("win"), *RESULT)


def tumbling_join(tuples: DataFrame, width: str) -> DataFrame:
    """Matches inside aligned event-time windows: start and the result columns. tuples need no batches."""
    part = lambda s, p: tuples.where(F.col("side") == s).select(F.window("ts", width)["start"].alias(f"{p}start"), *(F.col(c).alias(f"{p}{c}") for c in ("key", "val", "ts")))
    joined = part("L", "l").join(part("R", "r"), (F.col("lstart") == F.col("rstart")) & (F.col("lkey") == F.col("rkey")))
    return joined.select(F.col("lstart").alias("start"), *RESULT)
