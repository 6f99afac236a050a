"""Experiments: a grid of specifications, sustainable-throughput search, progress runs, and their CSV files."""

from __future__ import annotations

import csv
import logging
import os
import time
from dataclasses import dataclass, replace
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import ROOM, estimated_capacity, median, progress
from ..model import ALGORITHMS, DEVICES, OUTPUTS, PARALLEL, PROGRESS, JoinSpec, one_of
from ..operators.join import bitmap, count_by_histogram, count_by_window, materialize, selectivity
from ..sources.datagen import BURST, generate, stream_pair
from ..sources.scratch import drop, scratch
from ..sources.sequence import batched, sequence
from ..streaming import clock, replay, windows
from . import phases

LOG = logging.getLogger("tidejoin")

#: Tuples of 16 bytes in a kibibyte and a mebibyte.
KIB, MIB = 64, 65536
LIMIT_MS, NEAR_MS, PRECISION = 1000, 50, 32 * KIB
THROUGHPUT_COLUMNS = "algorithm_name write_result ingestion_rate batch_size zipf_theta distinct_key window_size probe_threads joiner_threads selectivity time".split()
PROGRESS_COLUMNS = "algorithm_name batch_size selectivity isWindowClosed match_count timestamp".split()


@dataclass(frozen=True)
class Experiment:
    spec: JoinSpec
    distinct: int
    theta: float
    size: int
    repeat: int = 1


def load_grid(path: str) -> list[Experiment]:
    """The experiments of a YAML file."""
    import yaml

    with open(path) as f:
        return grid(yaml.safe_load(f))


def grid(config: dict, size: int = 2560 * MIB) -> list[Experiment]:
    """Every combination of the lists in config. Window sizes are in MB and batch sizes in KB of tuples."""
    one_of("measuredMetric", config.get("measuredMetric", "Throughput"), ("Throughput", "cumulativePercentage"))
    axes = [config["algTypes"], config["deviceTypes"], config["progressivenessModes"], config["distinctKeys"], config["resultMaterializationMethod"], config["windowSizesMB"], config["batchSizeKB"], config["zipfThetas"], config["parStrats"]]
    names = {"algTypes": ALGORITHMS, "deviceTypes": DEVICES, "progressivenessModes": PROGRESS, "resultMaterializationMethod": OUTPUTS, "parStrats": PARALLEL}
    for k, allowed in names.items():
        for v in config[k]:
            one_of(k, v, allowed)
    return [
        Experiment(JoinSpec(batch * KIB, window * MIB, algorithm=alg, progress=mode, output=output, device=device, parallel=par), distinct, theta, size, config.get("repeat", 1))
        for alg, device, mode, distinct, output, window, batch, theta, par in product(*axes)
    ]


def outputs(tuples: DataFrame, spec: JoinSpec) -> list[DataFrame]:
    """What a run writes, in order, by its output mode.

    NO_OUTPUT counts (sort-merge by histograms); COUNT_KERNEL counts, then writes the rows; ESTIMATED_SELECTIVITY sets
    room aside, then writes the rows; BITMAP writes bits; ATOMIC writes the rows. EMPTY only takes the input in.
    """
    if spec.algorithm == "EMPTY":
        return [tuples]
    if spec.output == "NO_OUTPUT":
        return [count_by_histogram(tuples, spec) if spec.algorithm == "SMJ" else count_by_window(tuples, spec)]
    if spec.output == "BITMAP":
        return [bitmap(tuples, spec)]
    first = {"COUNT_KERNEL": count_by_window, "ESTIMATED_SELECTIVITY": estimated_capacity}.get(spec.output)
    return ([first(tuples, spec)] if first else []) + [materialize(tuples, spec)]


def run_once(spark: SparkSession, x: Experiment, size: int | None = None, ts_range: int = 1000) -> dict:
    """Generate both sides, run the join into a noop sink, and report. ``time`` covers the join, not the generation.

    Besides the file's columns: matches, windows, generate_ms, window_ms, build_ms, probe_ms and sort_ms (time by executed
    window, null without one; those of phases are summed over tasks), and overflown, the windows whose matches exceed the room that ESTIMATED_SELECTIVITY sets aside.
    """
    size = size or x.size
    began = time.perf_counter()
    tuples = batched(stream_pair(spark, size, theta=x.theta, distinct=x.distinct, upper=ts_range), x.spec.batch).persist()
    tuples.count()
    made = time.perf_counter()
    times = dict.fromkeys(phases.PHASES, 0)
    for df in outputs(tuples, x.spec):
        for k, v in phases.run(df)[1].items():
            times[k] += v
    elapsed = (time.perf_counter() - made) * 1000
    counted = replace(x.spec, algorithm="HJ") if x.spec.algorithm == "EMPTY" else x.spec
    share = selectivity(tuples, counted).first()
    overflown = None
    if x.spec.output == "ESTIMATED_SELECTIVITY" and x.spec.algorithm in ROOM:
        overflown = count_by_window(tuples, counted).join(estimated_capacity(tuples, counted), "win").where("matches > capacity").count()
    tuples.unpersist()
    cores = spark.sparkContext.defaultParallelism
    probe, join = {"INTRA": (cores, 1), "INTER": (1, cores), "HYBRID": (max(1, cores // 4), 4)}[x.spec.parallel]
    matches = 0 if x.spec.algorithm == "EMPTY" else share["matches"]
    report = {
        "algorithm_name": x.spec.name, "write_result": x.spec.output, "ingestion_rate": size, "batch_size": x.spec.batch, "zipf_theta": x.theta, "distinct_key": x.distinct,
        "window_size": x.spec.window, "probe_threads": probe, "joiner_threads": join, "selectivity": share["selectivity"] if matches else 0.0, "time": elapsed, "matches": matches,
        "windows": share["windows"], "generate_ms": (made - began) * 1000, "window_ms": elapsed / share["windows"] if share["windows"] else None, "overflown": overflown, **phases.averages(times, share["windows"]),
    }
    LOG.info("%s: %s matches, selectivity %s %%, %.0f ms, %s windows", x.spec.name, matches, report["selectivity"], elapsed, share["windows"])
    return report


def standalone(spark: SparkSession, size: int = 128 * MIB) -> dict:
    """One run of a lazy sort-merge join over skewed keys, counted: windows of 2 MiB, batches of 128 KiB."""
    return run_once(spark, Experiment(JoinSpec(128 * KIB, 2 * MIB, algorithm="SMJ", device="GPU"), 1000, 0.99, size))


def dump(spark: SparkSession, count: int = 8096, columns: tuple[str, ...] = ("ts",), upper: int = 1000) -> DataFrame:
    """Bursty generated tuples in order, for a look at them."""
    return generate(spark, count, mode=BURST, upper=upper).orderBy("id").select(*columns)


def write_input(path: str, tuples: DataFrame) -> None:
    """Append the tuples to a folder of CSV files: key, val, ts, without a header."""
    tuples.select("key", "val", "ts").write.mode("append").csv(path)


def sustainable(spark: SparkSession, x: Experiment, run=run_once, limit: float = LIMIT_MS, near: float = NEAR_MS, precision: int = PRECISION, most: int = 1 << 40) -> dict:
    """The report of the largest size found whose median time stays under the limit (or of the first, if none does).

    Sizes double until one isn't sustained, then the gap halves until it is within the precision or the time is near
    the limit.
    """
    size, low, high, best = x.size, 0, None, None
    while True:
        reports = [run(spark, x, size) for _ in range(x.repeat)]
        middle = median([r["time"] for r in reports])
        report = min(reports, key=lambda r: abs(r["time"] - middle)) | {"time": middle}
        if middle < limit:
            low, best = size, report
        else:
            high = size
        best = best or report
        if abs(middle - limit) <= near or size >= most:
            return report if middle < limit else best
        step = low if high is None else (high - low) // 2
        if step <= precision and high is not None:
            return best
        size = low + max(step, 1)


def _append(path: str, columns: list[str], rows: list[dict]) -> None:
    new = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "a", newline="") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore")
        if new:
            out.writeheader()
        out.writerows(rows)


def write_throughput(path: str, rows: list[dict]) -> None:
    """Append reports to a CSV file on the driver; the header is written once. A report is one line a run."""
    _append(path, THROUGHPUT_COLUMNS, rows)


def write_progress(spark: SparkSession, path: str, x: Experiment) -> None:
    """The progress curve of one run, written by Spark as CSV. The clock is the arrival ordinal."""
    tuples = batched(stream_pair(spark, x.size, theta=x.theta, distinct=x.distinct), x.spec.batch)
    share = selectivity(tuples, x.spec).select("selectivity")
    curve = progress(tuples, x.spec).crossJoin(F.broadcast(share))  # one row
    rows = curve.select(F.lit(x.spec.name).alias("algorithm_name"), F.lit(x.spec.batch).alias("batch_size"), "selectivity", F.col("is_window_closed").alias("isWindowClosed"), F.col("current_matches").alias("match_count"), F.col("arr").alias("timestamp"))
    rows.write.mode("append").option("header", True).csv(path)


def write_timed_progress(spark: SparkSession, path: str, x: Experiment, admitted: int = 16) -> None:
    """The progress curve of one run by the clock, appended to a CSV file on the driver, a line a trigger.

    The input is replayed as a stream that admits ``admitted`` batches a side at a time; ``timestamp`` is microseconds
    since the start, and match_count what had been written by then.
    """
    log, out, checkpoint = (scratch(spark, name) for name in ("log", "streamed", "state"))
    generated = stream_pair(spark, x.size, theta=x.theta, distinct=x.distinct).withColumn("ts", F.timestamp_millis("ts"))
    replay.write_log(sequence(generated), log)
    stream = replay.read_replay(spark, log, x.spec.batch, checkpoint, admitted * x.spec.batch)
    found = clock.run(windows.window_stream(stream, x.spec.batch, x.spec.window, progress=x.spec.progress), out, checkpoint)
    share = selectivity(batched(stream_pair(spark, x.size, theta=x.theta, distinct=x.distinct), x.spec.batch), x.spec).first()["selectivity"]
    for p in (log, out, checkpoint):
        drop(spark, p)
    _append(path, PROGRESS_COLUMNS, [dict(zip(PROGRESS_COLUMNS, (x.spec.name, x.spec.batch, share, closed > 0, so_far, us), strict=True)) for _, _, so_far, closed, us in found])


def main(config: str, out: str = "") -> None:
    """Command line: a YAML grid, and a folder for the CSV files; or ``standalone``; or ``dump``, and columns to show."""
    import yaml

    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("tidejoin").getOrCreate()
    if config == "standalone":
        print(standalone(spark))
        return
    if config == "dump":
        shown = dump(spark, columns=tuple(out.split(",")) if out else ("ts",))
        shown.show(shown.count(), truncate=False)
        return
    with open(config) as f:
        wanted = yaml.safe_load(f)
    for x in grid(wanted):
        if wanted.get("measuredMetric", "Throughput") == "Throughput":
            write_throughput(os.path.join(out, "throughput.csv"), [sustainable(spark, x)])
        else:
            write_progress(spark, os.path.join(out, "progressiveness.csv"), x)


if __name__ == "__main__":
    import sys

    main(*sys.argv[1:3])
