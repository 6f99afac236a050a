"""Stream state in columns: pairs in pieces, blocks at small cost; a log read by the groups of a stretch."""

import time

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.test_stream_growth import State
from tidejoin.streaming import replay, windows


def came(batches, each, keys):
    """Rows of one bucket: ``each`` tuples a batch, and each batch's mark."""
    arr = np.repeat(np.arange(batches), each)
    tuples = pd.DataFrame({"side": np.where(arr % 2 == 0, "L", "R"), "key": np.arange(len(arr)) * 7919 % keys, "val": np.arange(len(arr)), "ts": arr, "arr": arr})
    marks = pd.DataFrame({"side": "M", "key": None, "val": 0, "ts": range(batches), "arr": range(batches)})
    return pd.concat([tuples, marks], ignore_index=True).assign(bucket=0)


def fed(processor, *parts):
    processor.held, processor.stand = State(), State()
    return [f for part in parts for f in processor.handleInputRows((0,), iter([part]), None)]


@pytest.mark.parametrize("lazy", [False, True])
def test_pairs_leave_in_pieces_each_once(monkeypatch, lazy):
    """Two micro-batches, cut in the middle of a window, with a hot key: no piece exceeds the bound and one tuple's matches."""
    monkeypatch.setattr(windows, "PAIRS", 50)
    rows = came(23, 20, 3)
    rows.loc[rows["key"] == 2, "key"] = 1
    out = fed(windows.WindowJoin(lazy, 4, 4, None, True), rows[rows["arr"] < 9], rows[rows["arr"] >= 9])
    got = pd.concat(out)
    t = rows[rows["side"] != "M"].assign(win=lambda r: r["arr"] // 8 if lazy else r["arr"] // 7)
    t = t[t["win"] < 2] if lazy else t
    want = t[t["side"] == "L"].merge(t[t["side"] == "R"], on=["win", "key"], suffixes=("_l", "_r"))
    assert sorted(zip(got["win"], got["lkey"], got["lval"], got["rval"], strict=True)) == sorted(zip(want["win"], want["key"], want["val_l"], want["val_r"], strict=True))
    assert len(out) > 10 and max(map(len, out)) <= 50 + 80 and (got["lts"] % 2 == 0).all() and (got["rts"] % 2 == 1).all()


def test_blocks_cost_little():
    """3,000 blocks of 16 batches, as 60 times sf0.1 has, in a few seconds."""
    rows = came(24_000, 8, 1500)
    began = time.process_time()
    out = pd.concat(fed(windows.WindowJoin(False, 8, 8, None, False, 4), rows))
    assert time.process_time() - began < 9
    assert out["arr"].floordiv(8).nunique() == 3000 and out.groupby(out["arr"] // 8)["us"].max().is_monotonic_increasing


def test_a_trigger_reads_its_stretch_only(spark, tmp_path):
    """Files have small row groups, and a task of a trigger has few of them."""
    numbered = spark.range(600_000).select(F.xxhash64("id").alias("key"), F.xxhash64(F.col("id") + 1).alias("val"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.expr("if(id % 2 = 0, 'L', 'R')").alias("side"), F.expr("id div 2").alias("seq"))
    replay.write_log(numbered.coalesce(1), f"file://{tmp_path}")
    groups = [m.row_group(k).num_rows for f in tmp_path.rglob("*.parquet") for m in [pq.read_metadata(f)] for k in range(m.num_row_groups)]
    assert sum(groups) == 600_000 and max(groups) <= replay.PIECE + replay.ROWS
    reader = replay.ReplayReader({"path": f"file://{tmp_path}", "batch": "64", "tuples": str(1 << 20)})
    parts = reader.partitions({"batch": 0}, reader.latestOffset())
    assert max(p.last - p.first + 1 for p in parts) <= replay.PIECE
    read = sorted(s for p in parts if p.side == "R" for b in reader.read(p) for s in b.column("seq").to_pylist())
    assert read == list(range(300_000 // 64 * 64))
