"""Shared helpers: input columns, the shared scratch folder, and shipping this package to executors."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop, scratch, shared_dir

T = TypeVar("T")

#: Rows in one Arrow batch. Texts may be long, so the default of 10,000 rows would not bound a worker's memory.
ARROW_ROWS, ARROW_BYTES = 512, "4m"
#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_kept: dict[object, object] = {}
_shipped: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches and make this package importable on executors that don't have it installed."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = __name__.split(".")[0]
    path = os.path.join(tempfile.mkdtemp(), f"{package}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, files in os.walk(os.path.join(root, package)):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    out.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _shipped[sc.applicationId] = path


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def release() -> None:
    """Empty what a worker keeps. Every operator whose tasks keep nothing calls it, so that none holds another's memory."""
    if _kept:
        _kept.clear()
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # gives freed memory back, where the C library can
        if trim:
            trim(0)


def keep(key: object, make: Callable[[], T]) -> T:
    """What a worker keeps from task to task: one object at a time, so operators that follow each other don't add up."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]  # type: ignore[return-value]


__all__ = ["ARROW_BYTES", "ARROW_ROWS", "WORD", "cut", "drop", "keep", "prepare", "release", "scratch", "shared_dir", "table", "text_bytes", "word_count"]
