"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: prints one JSON line, warm medians in seconds."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tidejoin.model import JoinSpec
from tidejoin.operators import join, timewin
from tidejoin.sources.sequence import batched, event_tuples

BATCH, PER_WINDOW, RUNS = 512, 8, 3


def cases():
    spec = lambda progress, alg: JoinSpec(BATCH, BATCH * PER_WINDOW, algorithm=alg, progress=progress)
    tuples = lambda spark, d: batched(event_tuples(spark, d), BATCH)
    for progress in ("LAZY", "EAGER"):
        for alg in ("HJ", "SMJ", "NLJ"):
            yield f"{progress.lower()}_{alg.lower()}_count", lambda s, d, x=spec(progress, alg): join.window_join(tuples(s, d), x).groupBy().count()
        yield f"{progress.lower()}_histogram_count", lambda s, d, x=spec(progress, "SMJ"): join.count_by_histogram(tuples(s, d), x)
        yield f"{progress.lower()}_hj_materialized", lambda s, d, x=spec(progress, "HJ"): join.materialize(tuples(s, d), x)
        yield f"{progress.lower()}_selectivity", lambda s, d, x=spec(progress, "HJ"): join.selectivity(tuples(s, d), x)
    yield "time_lazy_join", lambda s, d: timewin.time_join(tuples(s, d), 36 * 3600 * 1000)
    yield "tumbling_time_join", lambda s, d: timewin.tumbling_join(event_tuples(s, d), "1 day")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name, query in cases():
        times = []
        for _ in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
