"""Joins that must give rows although some keys of a window are hot.

A mergeable frequency sketch (one pass, merged like any aggregate) finds the hot (window, key) of both sides. A hot key's
matches form a grid: its left tuples are dealt into rows of cells and its right ones into columns, by a hash of their
position, and each tuple goes to every cell of its row or column, so each pair meets in one cell of bounded size, and
the cells go to different tasks. All other keys have one cell. The sketch decides where tuples go, never what matches.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that the sketch tracks, and reports at most: what is broadcast and what the driver holds.
TRACKED, MOST = 1 << 16, 10_000
#: Cells that an even deal gives a task: a key with more pairs than one of them is split.
CELLS_PER_TASK = 16


def hot_keys(placed: DataFrame, tasks: int | None = None) -> list[tuple[int, int, int]]:
    """(hash of win and key, rows of cells, columns of cells) of the hot keys of tuples with win and side; MOST at most.

    A key is hot if its estimated pairs exceed an even cell's share of the estimated pairs of all keys that the sketch
    reports; keys that it doesn't report have fewer tuples than those.
    """
    tasks = tasks or int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = lambda s: F.expr(f"approx_top_k(h, {MOST}, {TRACKED}) FILTER (WHERE side = '{s}')").alias(s)
    found = placed.where("key is not null").select("side", F.xxhash64("win", "key").alias("h")).agg(top("L"), top("R")).first()
    left, right = ({x["item"]: x["count"] for x in found[s] or ()} for s in ("L", "R"))
    pairs = {h: left.get(h, 1) * right.get(h, 1) for h in left.keys() | right.keys()}
    cell = sum(pairs.values()) / (tasks * CELLS_PER_TASK)
    edge = max(1.0, math.sqrt(cell))
    split = lambda h: (h, math.ceil(left.get(h, 1) / edge), math.ceil(right.get(h, 1) / edge))
    return sorted(split(h) for h, n in pairs.items() if n > max(1.0, cell))


def with_cells(df: DataFrame, hot: list[tuple[int, int, int]], win: str, key: str, seq: str, left: bool, cell: str, plain=None) -> DataFrame:
    """df, one side of a join, with ``cell``: for hot keys all cells of the tuple's row (left) or column (right).

    ``plain`` is the cell of other keys, which both sides must agree on (0).
    """
    plain = F.lit(0) if plain is None else plain
    if not hot:
        return df.withColumn(cell, plain)
    table = F.broadcast(df.sparkSession.createDataFrame(hot, "_h long, _rows int, _columns int"))  # MOST rows at most
    own, other = ("_rows", "_columns") if left else ("_columns", "_rows")
    at = F.pmod(F.xxhash64(seq), F.col(own)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col(other) - 1), lambda k: (at * F.col("_columns") + k) if left else (k * F.col("_columns") + at))
    dealt = df.join(table, F.xxhash64(win, key) == F.col("_h"), "left")
    every = F.when(F.col("_h").isNull(), F.array(plain)).otherwise(cells)
    return dealt.withColumn(cell, F.explode(every)).drop("_h", "_rows", "_columns")
