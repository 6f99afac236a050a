"""Count and time windows on a live stream, in state that Spark keeps for each bucket of keys.

Tuples are dealt to buckets by a hash of their key, and each batch's last tuple also sends a mark to every bucket, so a
bucket knows of every batch, in arrival order, also of those that hold none of its keys. A bucket's state is the tuples
of its open windows and where it stands; nothing else is kept, and no time bound is asked from the caller.

* Eager: a batch joins what its window holds so far; the batch that opens the next window clears the state.
* Lazy: both sides are held until the batch that completes the window, join once and are dropped. What never completes
  never joins.
* Time windows: the watermark is the largest last timestamp of any batch; a window closes at the first batch that takes
  it ``width`` beyond the close before. The crossing batch ends a lazy window, and opens the next eager one.

Counts come without pairs: an arriving tuple matches as many as the other side holds of its key so far. Rows are sorted
into windows a micro-batch at a time, which the source's bound keeps small, and pairs leave in pieces. With a clock, a
micro-batch is taken in blocks of batches, in order, and every bucket stamps each block when its counts are found, so that
a block's last stamp is when all its matches were known. Tuples are columns of int64, so that a block costs a fraction of a
millisecond beside its sorting. This module's class is pickled by value.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

BUCKETS = 8
#: Tuples of a chunk of state (768 KB).
CHUNK = 1 << 14
COUNTS = "win long, arr long, matches long, closed boolean"
STAMPED = COUNTS + ", us long"
ROWS = "win long, lkey long, rkey long, lval long, rval long, lts long, rts long"
HELD = "tuples binary"  # a chunk of them, as _packed() makes it
COLUMNS = ["side", "key", "val", "ts", "arr", "win"]
KEY, ARR, WIN = (COLUMNS.index(c) for c in ("key", "arr", "win"))
#: Pairs that leave at once; a tuple's own matches aren't split.
PAIRS = 1 << 18
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _packed(plain: np.ndarray) -> list[tuple[bytes]]:
    """Tuples as chunks of state, which cost a call each rather than a tuple: int64 by columns, the left side as 1."""
    return [(plain[:, k : k + CHUNK].tobytes(),) for k in range(0, plain.shape[1], CHUNK)]


def _plain(chunks) -> np.ndarray:
    parts = [np.frombuffer(c[0], "int64").reshape(len(COLUMNS), -1) for c in chunks]
    return np.hstack(parts) if parts else np.empty((len(COLUMNS), 0), "int64")


def _unpacked(chunks) -> pd.DataFrame:
    plain = _plain(chunks)
    return pd.DataFrame({"side": np.where(plain[0] == 1, "L", "R")} | {c: plain[k] for k, c in enumerate(COLUMNS[1:], 1)})


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether each row of sorted columns is the first of its group."""
    first = np.ones(len(columns[0]), bool)
    first[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return first


class WindowJoin(StatefulProcessor):
    """One bucket's windows. ``whole`` and ``touched`` are a window's batches a side; ``width`` (microseconds) asks for time windows, ``block`` for stamps of that many batches a side."""

    def __init__(self, lazy: bool, whole: int, touched: int, width: int | None, rows: bool, block: int | None = None):
        self.lazy, self.whole, self.touched, self.width, self.rows, self.block = lazy, whole, touched, width, rows, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", HELD)
        self.stand = handle.getValueState("stand", "win long, watermark long, origin long, closed boolean")

    def _place(self, marks: pd.DataFrame, stand: tuple) -> tuple[pd.DataFrame, tuple]:
        """win, closed and close (the window that the batch completes, or -1) of each batch; and where that leaves us."""
        arr = marks["arr"].to_numpy()
        if self.width is None:
            if self.lazy:
                win = arr // 2 // self.whole
                last = arr // 2 + 1 - self.touched  # a right batch completes the window whose batches lie that far back
                closes = np.where((arr % 2 == 1) & (last >= 0) & (last % self.whole == 0), last // self.whole, -1)
                return marks.assign(win=win, close=closes, closed=closes >= 0), stand
            length = 2 * self.touched - 1
            return marks.assign(win=arr // length, close=-1, closed=(arr > 0) & (arr % length == 0)), stand
        win, watermark, origin, _ = stand
        wins, closes, closed = [], [], []
        for ts in marks["ts"].tolist():
            watermark = ts if origin is None else max(watermark, ts)
            origin = watermark if origin is None else origin
            crosses = watermark - origin >= self.width
            if crosses and not self.lazy:
                win += 1
            wins.append(win)
            closes.append(win if crosses and self.lazy else -1)
            closed.append(crosses)
            if crosses:
                origin = watermark
                win += self.lazy
        return marks.assign(win=wins, close=closes, closed=closed), (win, watermark, origin, False)

    @staticmethod
    def _counts(tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the tuples and, in it, each one's matches with the other side's of its window and key before it."""
        order = np.lexsort((tuples[ARR], tuples[KEY], tuples[WIN]))
        left = tuples[0, order]
        first = np.maximum.accumulate(np.where(_starts(tuples[WIN, order], tuples[KEY, order]), np.arange(len(order)), 0))
        lefts, rights = np.cumsum(left), np.cumsum(1 - left)
        before_left, before_right = lefts - (lefts - left)[first], rights - (rights - 1 + left)[first]
        return order, np.where(left == 1, before_right, before_left)

    @staticmethod
    def _pairs(left: np.ndarray, right: np.ndarray) -> Iterator[pd.DataFrame]:
        """Matching tuples, about PAIRS at a time."""
        both = np.hstack([left, right])
        order = np.lexsort((both[KEY], both[WIN]))
        code = np.empty(len(order), "int64")
        code[order] = np.cumsum(_starts(both[WIN, order], both[KEY, order]))
        lcode, rcode = np.split(code, [left.shape[1]])
        sorts = np.argsort(rcode, kind="stable")
        right, rcode = right[:, sorts], rcode[sorts]
        low = np.searchsorted(rcode, lcode, "left")
        n = np.searchsorted(rcode, lcode, "right") - low
        left, low, n = left[:, n > 0], low[n > 0], n[n > 0]
        ends, at = np.cumsum(n), 0
        while at < len(n):
            base = ends[at] - n[at]
            upto = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
            many = n[at:upto]
            lt = left[:, np.repeat(np.arange(at, upto), many)]
            rt = right[:, np.repeat(low[at:upto] - (ends[at:upto] - many - base), many) + np.arange(lt.shape[1])]
            sides = {f"{p}{c}": t[COLUMNS.index(c)] for c in ("key", "val", "ts") for p, t in (("l", lt), ("r", rt))}
            yield pd.DataFrame({"win": lt[WIN]} | sides)
            at = upto

    def _cuts(self, arr: np.ndarray) -> list[int]:
        """Where the blocks of ascending batches begin, and their end; one block without a clock."""
        if self.block is None:
            return [0, len(arr)]
        return [0, *(np.flatnonzero(np.diff(arr // (2 * self.block))) + 1).tolist(), len(arr)]

    def _found(self, tuples: np.ndarray, new: np.ndarray, placed: np.ndarray, flags: bool) -> np.ndarray:
        """Rows (win, arr, matches, closed) of tuples, of which ``new`` ones count, for batches (arr, win, close, closed)."""
        order, matches = self._counts(tuples)
        counts = new[order] & (matches > 0)
        win, arr, matches = tuples[WIN, order][counts], tuples[ARR, order][counts], matches[counts]
        if self.lazy:
            done = placed[:, placed[2] >= 0]
            arr = done[0][np.searchsorted(done[2], win)]  # windows close in order
        else:
            sorts = np.argsort(arr, kind="stable")
            win, arr, matches = win[sorts], arr[sorts], matches[sorts]
        at = np.flatnonzero(_starts(win, arr))
        sums = np.add.reduceat(matches, at) if len(at) else matches
        rows = [np.vstack([win[at], arr[at], sums, np.zeros(len(at), "int64")])]
        if flags:  # one bucket also gives a row for each batch or completed window, with its flag
            its = done[[2, 0, 3]] if self.lazy else placed[[1, 0, 3]]
            rows.append(np.insert(its, 2, 0, axis=0))
        return np.hstack(rows)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        stand = tuple(self.stand.get()) if self.stand.exists() else (0, None, None, False)
        mark = (came["side"] == "M").to_numpy()
        marks, stand = self._place(came[mark].sort_values("arr"), stand)
        placed = np.vstack([marks[c].to_numpy("int64") for c in ("arr", "win", "close", "closed")])
        new = came[~mark].sort_values("arr", kind="stable")
        arr = new["arr"].to_numpy("int64")
        fresh = np.vstack([(new["side"] == "L").to_numpy("int64"), *(new[c].to_numpy("int64") for c in COLUMNS[1:5]), placed[1][np.searchsorted(placed[0], arr)]])
        held = _plain(self.held.get() if self.held.exists() else [])
        size, stored, counted = held.shape[1], np.ones(held.shape[1], bool), []
        cuts = self._cuts(placed[0])
        ends = np.searchsorted(arr, placed[0][[c - 1 for c in cuts[1:]]], "right").tolist()
        for first, last, at, end in zip(cuts, cuts[1:], [0, *ends], ends, strict=False):
            batches = placed[:, first:last]
            tuples = np.hstack([held, fresh[:, at:end]])
            old = np.arange(tuples.shape[1]) < held.shape[1]
            # An eager window is open until the next one's first batch; a lazy one until the batch that completes it.
            if self.lazy:
                ready = np.isin(tuples[WIN], batches[2][batches[2] >= 0])
                keep, counts = ~ready, np.ones(int(ready.sum()), bool)
            else:
                ready, keep, counts = np.ones(len(old), bool), tuples[WIN] >= batches[1].max(), ~old
            if self.rows:
                lefts, before = ready & (tuples[0] == 1), old & (not self.lazy)
                rights = ready & (tuples[0] == 0)
                yield from self._pairs(tuples[:, lefts & ~before], tuples[:, rights])
                yield from self._pairs(tuples[:, lefts & before], tuples[:, rights & ~before])
            else:
                found = self._found(tuples[:, ready], counts, batches, key[0] == 0)
                if self.block is not None:  # a row of no matches in each block, so that no bucket's stamp is missing
                    none = np.array([[-1], [batches[0, 0] // (2 * self.block) * 2 * self.block], [0], [0]])
                    found = np.hstack([found, none])
                counted.append(np.vstack([found, np.full(found.shape[1], time.time_ns() // 1000)]))
            held, stored = tuples[:, keep], np.append(stored, np.zeros(end - at, bool))[keep]
        if not self.rows:
            win, arr, matches, closed, us = np.hstack(counted)
            table = pd.DataFrame({"win": win, "arr": arr, "matches": matches, "closed": closed == 1})
            yield table if self.block is None else table.assign(us=us)
        if self.width is not None:
            self.stand.update(stand)
        if int(stored.sum()) == size:
            if not stored.all():
                self.held.appendList(_packed(held[:, ~stored]))  # nothing was closed: only what is new is written
        elif held.shape[1]:
            self.held.put(_packed(held))
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def _dealt(stream: DataFrame, batch: int, buckets: int) -> DataFrame:
    """Tuples to their buckets, and a mark of each batch's last tuple to every bucket. Null keys match nothing."""
    arr = 2 * F.floor(F.col("seq") / batch).cast("long") + F.when(F.col("side") == "R", 1).otherwise(0)
    own = F.struct(F.pmod(F.hash("key"), F.lit(buckets)).alias("bucket"), F.col("side").alias("side"), F.col("key").alias("key"))
    mark = lambda b: F.struct(b.cast("int").alias("bucket"), F.lit("M").alias("side"), F.lit(None).cast("long").alias("key"))
    tuples = F.when(F.col("key").isNull(), F.array().cast("array<struct<bucket:int,side:string,key:long>>")).otherwise(F.array(own))
    marks = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), mark)
    sent = F.when(F.col("seq") % batch == batch - 1, F.concat(tuples, marks)).otherwise(tuples)
    return stream.select(F.explode(sent).alias("to"), "val", "ts", arr.alias("arr")).select("to.*", "val", "ts", "arr")


def window_stream(stream: DataFrame, batch: int, window: int | None = None, width_ms: int | None = None, progress: str = "EAGER", rows: bool = False, buckets: int = BUCKETS, block: int | None = None) -> DataFrame:
    """Windows over a stream of key, val, ts (microseconds), side, seq, as read_replay() gives it: count windows of
    ``window`` tuples a side, or time windows of ``width_ms``.

    Counts: win, arr (the batch that emits), matches, closed, several rows a batch, to be summed; every batch (eager)
    or completed window (lazy) has one. With ``rows``: win and the matching tuples, times in microseconds. With ``block``,
    counts have us, the clock (microseconds since 1970) when a bucket had found them, and a row of each bucket in each
    block of that many batches a side, without matches and of window -1.
    """
    if block is not None and (rows or block < 1):
        raise ValueError("blocks of at least one batch stamp counts only")
    if (window is None) == (width_ms is None):
        raise ValueError("either count windows or time windows")
    if window is not None and window < batch:
        raise ValueError("a window holds at least one batch")
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    join = WindowJoin(progress == "LAZY", (window or batch) // batch, -(-(window or batch) // batch), None if width_ms is None else 1000 * width_ms, rows, block)
    return _dealt(stream, batch, buckets).groupBy("bucket").transformWithStateInPandas(join, ROWS if rows else COUNTS if block is None else STAMPED, "Append", "None")


@contextmanager
def _settings(spark: SparkSession, **settings: str):
    """Session settings that a query takes over when it starts, put back afterwards."""
    names = {k.replace("__", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """A query that appends to the Parquet table ``path``. State lies in RocksDB, a partition of it for each bucket."""
    spark = stream.sparkSession
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__shuffle__partitions=str(buckets)):
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()


def run(stream: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> None:
    """Take in all that is on offer, then stop."""
    query = start(stream, path, checkpoint, buckets)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
