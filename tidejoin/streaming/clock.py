"""The progress curve of a running query, by the clock: a row for each trigger as its results are written."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from . import windows

OBSERVED = "progress"


class ProgressClock(StreamingQueryListener):
    """Rows (trigger, matches, current_matches, closed, us) of one query: matches and closed windows that its observed
    metrics report, the matches so far, and microseconds since it was started."""

    def __init__(self):
        self.began = time.perf_counter_ns()
        self.run: str | None = None
        self.rows: list[tuple[int, int, int, int, int]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if str(p.runId) != self.run or OBSERVED not in p.observedMetrics or not p.numInputRows:
            return
        seen = p.observedMetrics[OBSERVED]
        matches = seen["matches"] or 0
        so_far = self.rows[-1][2] if self.rows else 0
        self.rows.append((p.batchId, matches, so_far + matches, seen["closed"] or 0, (time.perf_counter_ns() - self.began) // 1000))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.run = None


def observed(counts: DataFrame) -> DataFrame:
    """The counts of window_stream() with the metrics that ProgressClock reads."""
    return counts.observe(OBSERVED, F.sum("matches").alias("matches"), F.sum(F.col("closed").cast("long")).alias("closed"))


def run(counts: DataFrame, path: str, checkpoint: str, buckets: int = windows.BUCKETS, patience: float = 30) -> list[tuple[int, int, int, int, int]]:
    """Take in all that is on offer and give the rows of the progress curve. ``patience``: seconds for the last event."""
    spark, clock = counts.sparkSession, ProgressClock()
    spark.streams.addListener(clock)
    try:
        query = windows.start(observed(counts), path, checkpoint, buckets)
        clock.run = str(query.runId)
        try:
            query.processAllAvailable()
            last = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=-1)
            until = time.monotonic() + patience
            while last >= 0 and (not clock.rows or clock.rows[-1][0] < last) and time.monotonic() < until:
                time.sleep(0.05)  # events come after the trigger
        finally:
            query.stop()
    finally:
        spark.streams.removeListener(clock)
    return clock.rows
