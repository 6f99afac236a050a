"""Admission and the clock of long streams."""

import pandas as pd
import pytest

from tidejoin.plans import streams
from tidejoin.streaming import windows


def test_triggers_stay_few(spark):
    """60 and 360 times sf0.1; short logs are admitted as before, and no trigger exceeds its bound."""
    for tuples in (1000, 100_000, 6_000_000, 36_000_000):
        most = streams.admitted(tuples, 64)
        assert tuples / 2 / (64 * most) <= max(streams.TRIGGERS, tuples / 2 / streams.MOST_TUPLES) and 64 * most <= streams.MOST_TUPLES
    assert streams.admitted(10_000, 64) == streams.ADMITTED


class State:
    def __init__(self):
        self.rows = []

    def exists(self):
        return bool(self.rows)

    def get(self):
        return iter(self.rows)

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):  # noqa: N802
        self.rows += rows

    def clear(self):
        self.rows = []


@pytest.mark.parametrize("lazy", [False, True])
def test_blocks_of_a_micro_batch_are_stamped_in_order(lazy):
    """The same counts and state as without a clock, one stamp a block, ascending, also where nothing matches."""
    rows = [(side, k % 3 if at < 20 else None, 100 * at + k, at) for at in range(26) for side in ("LR"[at % 2],) for k in range(5)]
    tuples = pd.DataFrame([r for r in rows if r[1] is not None], columns=["side", "key", "val", "arr"])
    marks = pd.DataFrame({"side": "M", "key": None, "val": 0, "arr": range(26)})
    came = pd.concat([tuples, marks], ignore_index=True).assign(bucket=0, ts=0)
    found, held = {}, {}
    for block in (None, 2):
        p = windows.WindowJoin(lazy, 3, 3, None, False, block)
        p.held, p.stand = State(), State()
        out = [f for part in (came[came["arr"] < 10], came[came["arr"] >= 10]) for f in p.handleInputRows((0,), iter([part]), None)]
        found[block], held[block] = pd.concat(out), sorted(windows._unpacked(p.held.get()).itertuples(index=False, name=None))
    stamps = found[2].groupby(found[2]["arr"] // 4)["us"].max()
    assert list(stamps.index) == list(range(7)) and stamps.is_monotonic_increasing and stamps.is_unique
    counts = {b: f[f["matches"] > 0].groupby(["win", "arr"])["matches"].sum().to_dict() for b, f in found.items()}
    flags = {b: sorted(f.loc[f["closed"], "arr"]) for b, f in found.items()}
    assert counts[2] == counts[None] != {} and flags[2] == flags[None] != [] and held[2] == held[None]
