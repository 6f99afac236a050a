"""Windows on a live stream: replay with admission control, state, restarts, against the batch forms and plain counts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidejoin.model import JoinSpec
from tidejoin.operators import join, timewin
from tidejoin.sources.sequence import batched, event_tuples, sequence
from tidejoin.streaming import replay, windows

SF = "/root/testdata/sf0.001"
WIDTH_MS = 36 * 3600 * 1000


def numbered(spark):
    return sequence(event_tuples(spark, SF))


def url(path):
    return f"file://{path}"


def offsets(checkpoint):
    """Batches admitted after each trigger, as Spark logged them."""
    names = sorted((int(n) for n in os.listdir(checkpoint / "offsets") if n.isdigit()))
    return [json.loads((checkpoint / "offsets" / str(n)).read_text().strip().splitlines()[-1])["batch"] for n in names]


def test_replay_admits_whole_batches(spark, tmp_path):
    """The bound holds at every trigger, the tail of one side waits, and a restart reads what is new, once."""
    rows, out, checkpoint = numbered(spark), tmp_path / "out", tmp_path / "checkpoint"
    read = lambda: replay.read_replay(spark, url(tmp_path / "log"), 16, url(checkpoint), 128)
    replay.write_log(rows.where("seq < 200"), url(tmp_path / "log"))
    windows.run(read(), url(out), url(checkpoint))
    first = offsets(checkpoint)
    assert first[-1] == 200 // 16 and all(b - a <= 8 for a, b in zip([0, *first], first))
    replay.write_log(rows.where("seq >= 200"), url(tmp_path / "log"))
    windows.run(read(), url(out), url(checkpoint))
    every = offsets(checkpoint)
    assert every[: len(first)] == first and all(b - a <= 8 for a, b in zip([0, *every], every))
    got = spark.read.parquet(str(out))
    want = batched(event_tuples(spark, SF), 16)
    key = lambda df: sorted((r["side"], r["seq"], r["val"], r["key"]) for r in df.collect())
    assert key(got) == key(want) and got.count() == got.select("side", "seq").distinct().count()


@pytest.mark.parametrize("progress,window", [("EAGER", 64), ("LAZY", 64), ("LAZY", 72), ("EAGER", 72)])
def test_count_windows_survive_a_restart(spark, tmp_path, progress, window):
    """Counts equal the batch form's, with a stop in the middle of a window, and windows that batches don't divide."""
    rows, checkpoint = numbered(spark), url(tmp_path / "checkpoint")

    def go():
        stream = replay.read_replay(spark, url(tmp_path / "log"), 16, checkpoint, 160)
        windows.run(windows.window_stream(stream, 16, window, progress=progress, buckets=3), url(tmp_path / "out"), checkpoint, buckets=3)

    replay.write_log(rows.where("seq < 150"), url(tmp_path / "log"))
    go()
    replay.write_log(rows.where("seq >= 150"), url(tmp_path / "log"))
    go()
    out = spark.read.parquet(str(tmp_path / "out"))
    got = {r["win"]: r["m"] for r in out.groupBy("win").agg(F.sum("matches").alias("m")).where("m > 0").collect()}
    want = {r["win"]: r["matches"] for r in join.count_by_window(batched(event_tuples(spark, SF), 16), JoinSpec(16, window, progress=progress)).collect()}
    assert got == want and want


@pytest.mark.parametrize("progress", ["EAGER", "LAZY"])
def test_time_windows_and_rows(spark, tmp_path, progress):
    checkpoint = url(tmp_path / "checkpoint")
    replay.write_log(numbered(spark), url(tmp_path / "log"))
    stream = replay.read_replay(spark, url(tmp_path / "log"), 16, checkpoint, 100)
    windows.run(windows.window_stream(stream, 16, width_ms=WIDTH_MS, progress=progress, rows=True, buckets=2), url(tmp_path / "out"), checkpoint, buckets=2)
    key = lambda df: sorted((r["win"], r["lkey"], r["lval"], r["rval"]) for r in df.collect())
    got, want = key(spark.read.parquet(str(tmp_path / "out"))), key(timewin.time_join(batched(event_tuples(spark, SF), 16), WIDTH_MS, progress))
    assert got == want and want


def test_state_is_dropped_at_each_close(spark):
    """A processor fed by hand: an eager window's state goes with the next one's first batch, a lazy one's at its close."""
    import pandas as pd

    class State:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows) if self.list else self.rows

        def put(self, rows):
            self.rows = list(rows)

        def appendList(self, rows):  # noqa: N802
            self.rows += rows

        def update(self, row):
            self.rows = row

        def clear(self):
            self.rows = []

    for lazy, left in ((False, [1, 2, 1, 2, 1, 2, 1, 2]), (True, [1, 2, 3, 0, 1, 2, 3, 0])):
        p = windows.WindowJoin(lazy, 2, 2, None, False)
        p.held, p.stand = State(), State()
        p.held.list, p.stand.list = True, False
        sizes = []
        for arr in range(8):
            side = "LR"[arr % 2]
            rows = pd.DataFrame({"bucket": 0, "side": [side, "M"], "key": [5, None], "val": [arr, arr], "ts": [arr, arr], "arr": [arr, arr]})
            list(p.handleInputRows((0,), iter([rows]), None))
            sizes.append(len(p.held.rows))
        if lazy:
            assert sizes == left
        else:
            assert sizes == [1, 2, 3, 1, 2, 3, 1, 2]


def test_invalid_windows(spark, tmp_path):
    replay.write_log(numbered(spark), url(tmp_path / "log"))
    stream = replay.read_replay(spark, url(tmp_path / "log"), 16)
    for bad in ({}, {"window": 8}, {"window": 64, "width_ms": 5}):
        with pytest.raises(ValueError):
            windows.window_stream(stream, 16, **bad)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    windows.run(windows.window_stream(stream, 16, 64, buckets=2), url(tmp_path / "out"), url(tmp_path / "checkpoint"), buckets=2)
    assert before == {k: spark.conf.get(k, None) for k in before}
