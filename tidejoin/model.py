"""Specification of a windowed stream join."""

from __future__ import annotations

from dataclasses import dataclass

#: Join hints. A nested loop runs inside windows, which meet by hash. EMPTY takes the input in and joins nothing.
ALGORITHMS = {"NLJ": "shuffle_hash", "HJ": "shuffle_hash", "SMJ": "merge", "EMPTY": "shuffle_hash"}
PROGRESS = ("LAZY", "EAGER")
OUTPUTS = ("NO_OUTPUT", "COUNT_KERNEL", "ESTIMATED_SELECTIVITY", "BITMAP", "ATOMIC")
DEVICES = ("CPU", "GPU")
PARALLEL = ("INTER", "INTRA", "HYBRID")

INPUT_SCHEMA = "key long, val long, ts timestamp_ntz"
RESULT_SCHEMA = "lkey long, rkey long, lval long, rval long, lts timestamp_ntz, rts timestamp_ntz"


def one_of(what: str, value: str, allowed) -> str:
    """Exact match; an unknown or shortened name is an error."""
    if value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


@dataclass(frozen=True)
class JoinSpec:
    """Inner equi-join on key inside count windows of ``window`` tuples a side, fed in batches of ``batch`` tuples.

    device is a label without effect. parallel chooses what a shuffle is dealt by: INTER by window, INTRA by key within
    it (what an equi-join does by itself), HYBRID by window and a few salts of the key.
    """

    batch: int
    window: int
    algorithm: str = "HJ"
    progress: str = "LAZY"
    output: str = "NO_OUTPUT"
    device: str = "CPU"
    parallel: str = "INTRA"

    def __post_init__(self):
        if self.batch < 1 or self.window < self.batch:
            raise ValueError("a window holds at least one batch of at least one tuple")
        one_of("algorithm", self.algorithm, ALGORITHMS)
        one_of("progress", self.progress, PROGRESS)
        one_of("output", self.output, OUTPUTS)
        one_of("device", self.device, DEVICES)
        one_of("parallel", self.parallel, PARALLEL)

    @property
    def name(self) -> str:
        """Label for result tables."""
        return "_".join((self.progress, self.device, self.algorithm, self.output)).lower()

    @property
    def whole(self) -> int:
        """Batches that a lazy window takes."""
        return self.window // self.batch

    @property
    def touched(self) -> int:
        """Batches that a side needs to hold a window's tuples."""
        return -(-self.window // self.batch)

    @property
    def length(self) -> int:
        """Batches of both sides that an eager window holds."""
        return 2 * self.touched - 1
