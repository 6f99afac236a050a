"""Closed forms against a sequential simulation of arriving batches, edge cases, streaming, and the experiment driver."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidejoin.functions.stats import median, progress
from tidejoin.model import JoinSpec
from tidejoin.operators import join, timewin
from tidejoin.plans import experiment
from tidejoin.sources import datagen
from tidejoin.sources.sequence import batched, event_tuples, sequence

SCHEMA = "key long, val long, ts timestamp_ntz, side string"


def table(spark, left, right, gaps=None):
    t0 = datetime(2024, 1, 1)
    rows = [(k, i, t0 + timedelta(seconds=i), s) for s, keys in (("L", left), ("R", right)) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, SCHEMA)


def arrivals(left, right, batch):
    for b in range(min(len(left), len(right)) // batch):
        for side, keys in (("L", left), ("R", right)):
            yield side, b, [(k, b * batch + i) for i, k in enumerate(keys[b * batch : (b + 1) * batch])]


def simulate(left, right, spec):
    """Matches by window, by holding batches until a window is complete (lazy) or by probing what is held (eager)."""
    found, win = Counter(), 0
    if spec.progress == "LAZY":
        held = {"L": [], "R": []}
        for side, _, rows in arrivals(left, right, spec.batch):
            held[side].append(rows)
            if all(len(v) * spec.batch >= spec.window for v in held.values()):
                take = {s: [r for b in v[: spec.whole] for r in b] for s, v in held.items()}
                held = {s: v[spec.whole :] for s, v in held.items()}
                n = sum(a is not None and a == b for a, _ in take["L"] for b, _ in take["R"])
                if n:
                    found[win] += n
                win += 1
        return found
    state = {"L": [], "R": []}
    for side, _, rows in arrivals(left, right, spec.batch):
        if any(len(v) >= spec.window for v in (state["L"], state["R"])):
            state, win = {"L": [], "R": []}, win + 1
        other = state["R" if side == "L" else "L"]
        n = sum(a is not None and a == b for a, _ in rows for b, _ in other)
        if n:
            found[win] += n
        state[side] += rows
    return found


CASES = [(1000, 1000, 16, 64, 20), (1000, 1000, 16, 16, 20), (1000, 1000, 16, 160, 50), (997, 640, 10, 30, 7), (1000, 1000, 16, 72, 20), (5, 500, 8, 16, 3), (300, 300, 7, 50, 1), (0, 40, 4, 8, 3)]


@pytest.mark.parametrize("progress_", ["LAZY", "EAGER"])
@pytest.mark.parametrize("case", CASES)
def test_windows_equal_simulation(spark, case, progress_):
    n_left, n_right, b, w, d = case
    rng = random.Random(str(case))
    draw = lambda n: [rng.choice([None, *range(d)]) for _ in range(n)]
    left, right = draw(n_left), draw(n_right)
    spec = JoinSpec(b, w, progress=progress_)
    tuples = batched(table(spark, left, right), b)
    want = simulate(left, right, spec)
    counts = lambda df: {r["win"]: r["matches"] for r in df.collect()}
    assert counts(join.count_by_histogram(tuples, spec)) == want
    assert counts(join.count_by_window(tuples, spec)) == want
    if progress_ == "EAGER" and w <= b:
        assert not want


def test_algorithms_agree(spark):
    tuples = batched(event_tuples(spark, "/root/testdata/sf0.001"), 16)
    for mode in ("LAZY", "EAGER"):
        counts = {alg: join.window_join(tuples, JoinSpec(16, 64, alg, mode)).count() for alg in ("NLJ", "HJ", "SMJ")}
        spec = JoinSpec(16, 64, progress=mode)
        bits = join.bitmap(tuples, spec)
        counts["bits"] = bits.agg(F.sum(F.bit_count("bits"))).first()[0]
        counts["decoded"] = join.decode_bitmap(bits).count()
        counts["histogram"] = join.count_by_histogram(tuples, spec).agg(F.sum("matches")).first()[0]
        counts["progress"] = progress(tuples, spec).agg(F.max("current_matches")).first()[0]
        counts["selectivity"] = join.selectivity(tuples, spec).first()["matches"]
        assert len(set(counts.values())) == 1, counts


def test_plans_push_columns_and_pick_joins(spark):
    tuples = batched(event_tuples(spark, "/root/testdata/sf0.001"), 16)
    for alg, node in (("HJ", "ShuffledHashJoin"), ("SMJ", "SortMergeJoin")):
        plan = join.count_by_window(tuples, JoinSpec(16, 64, alg))._jdf.queryExecution().executedPlan().toString()
        assert node in plan and "props" not in plan and "CartesianProduct" not in plan


def test_hybrid_shuffles_once(spark):
    """The salted deal satisfies the join: no exchange besides the two that INTER has too."""
    tuples = batched(event_tuples(spark, "/root/testdata/sf0.001"), 16)
    count = {}
    for par in ("INTER", "HYBRID"):
        plan = join.window_join(tuples, JoinSpec(16, 64, parallel=par))._jdf.queryExecution().executedPlan().toString()
        count[par] = (plan.count("REPARTITION_BY_COL"), plan.count("ENSURE_REQUIREMENTS"))
    assert count["HYBRID"] == count["INTER"] and count["INTER"][0] == 2


@pytest.mark.parametrize("mode", ["LAZY", "EAGER"])
def test_progress_has_every_row(spark, mode):
    """A row for each batch or executed window, also without a match, against the simulation's counts."""
    left, right = [k % 3 for k in range(400)], [9] * 120 + [k % 3 for k in range(280)]
    spec = JoinSpec(10, 40, progress=mode)
    rows = sorted(progress(batched(table(spark, left, right), 10), spec).collect())
    want = simulate(left, right, spec)
    by_window, total = Counter(), 0
    for r in rows:
        by_window[r["win"]] += r["matches"]
        total += r["matches"]
        assert r["current_matches"] == total
    assert +by_window == want and any(r["matches"] == 0 for r in rows)
    if mode == "LAZY":
        assert [r["arr"] for r in rows] == [8 * k + 7 for k in range(10)] and all(r["is_window_closed"] for r in rows)
    else:
        assert [r["arr"] for r in rows] == list(range(80))
        assert all(r["is_window_closed"] == (k > 0 and rows[k - 1]["win"] < r["win"]) for k, r in enumerate(rows))
        assert join.selectivity(batched(table(spark, left, right), 10), spec).first()["windows"] == rows[-1]["win"]


def test_running_over_blocks(spark, monkeypatch):
    from tidejoin.functions import running

    monkeypatch.setattr(running, "SPAN", 4)
    rng = random.Random(3)
    values = [rng.randrange(50) for _ in range(23)]
    df = spark.createDataFrame(list(enumerate(values)), "arr long, v long")
    sums = {r["arr"]: (r["s"], r["b"]) for r in running.running_sum(running.running_sum(df, "arr", "v", "s"), "arr", "v", "b", before=True).collect()}
    assert sums == {k: (sum(values[: k + 1]), sum(values[:k])) for k in range(23)}
    assert {r["arr"]: r["m"] for r in running.running_max(df, "arr", "v", "m").collect()} == {k: max(values[: k + 1]) for k in range(23)}


def test_invalid_specs():
    for bad in ({"batch": 8, "window": 4}, {"batch": 0, "window": 4}, {"batch": 1, "window": 4, "algorithm": "H"}, {"batch": 1, "window": 4, "progress": ""}, {"batch": 1, "window": 4, "parallel": "I"}):
        with pytest.raises(ValueError):
            JoinSpec(**bad)


def test_ranges_number_like_one_window(spark):
    tuples = event_tuples(spark, "/root/testdata/sf0.001")
    rows = lambda df: sorted((r["side"], r["val"], r["seq"]) for r in df.collect())
    assert rows(sequence(tuples, ranges=7)) == rows(sequence(tuples))


def simulate_time(left, right, batch, width, lazy):
    found, wm, latest, state, win = Counter(), None, None, {"L": [], "R": []}, 0
    for side, b, rows in arrivals(left, right, batch):
        wm = max(wm or 0, rows[-1][1])
        latest = wm if latest is None else latest
        crosses = wm - latest >= width
        if crosses and not lazy:
            state, win, latest = {"L": [], "R": []}, win + 1, wm
        if not lazy:
            n = sum(k == o for k, _ in rows for o, _ in state["R" if side == "L" else "L"])
            found[win] += n
        state[side] += rows
        if crosses and lazy:
            found[win] += sum(a == c for a, _ in state["L"] for c, _ in state["R"])
            state, win, latest = {"L": [], "R": []}, win + 1, wm
    return +found


@pytest.mark.parametrize("mode", ["LAZY", "EAGER"])
def test_time_windows_equal_simulation(spark, mode):
    rng = random.Random(2)
    left, right = [rng.randrange(6) for _ in range(300)], [rng.randrange(6) for _ in range(300)]
    got = timewin.time_join(batched(table(spark, left, right), 10), 45_000, mode).groupBy("win").count().collect()
    assert {r["win"]: r["count"] for r in got} == simulate_time(left, right, 10, 45, mode == "LAZY")


def test_stream_equals_batch(spark, tmp_path):
    from tidejoin.streaming import joins

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):  # files in event order
        events.where(F.floor(F.col("event_id") / 334) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = joins.read_events(spark, str(tmp_path / "in"))
    query = joins.start(joins.tumbling_stream_join(stream, "1 day", "60 days"), "joined", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        want = timewin.tumbling_join(event_tuples(spark, "/root/testdata/sf0.001"), "1 day").count()
        assert spark.table("joined").count() == want
        assert joins.progress_rows(query)[-1][2] in (1000, 2000)  # a source may count once for each side
    finally:
        query.stop()


def test_count_windows_on_a_stream(spark, tmp_path):
    from tidejoin.streaming import joins

    tuples = batched(event_tuples(spark, "/root/testdata/sf0.001"), 16).select("key", "val", F.col("ts").cast("timestamp").alias("ts"), "side", "seq")
    tuples.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tuples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = joins.start(joins.count_stream_join(stream, 16, 64, "30 DAYS", "60 days"), "counted", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        want = join.count_by_window(batched(event_tuples(spark, "/root/testdata/sf0.001"), 16), JoinSpec(16, 64, progress="EAGER"))
        assert {r["win"]: r["count"] for r in spark.table("counted").groupBy("win").count().collect()} == {r["win"]: r["matches"] for r in want.collect()}
    finally:
        query.stop()


def test_a_stream_numbers_its_tuples(spark, tmp_path):
    from tidejoin.streaming import joins

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):  # files in event order
        events.where(F.floor(F.col("event_id") / 334) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart goes on, and numbers nothing twice
        query = joins.number_stream(joins.read_events(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "numbers"))
        query.processAllAvailable()
        query.stop()
    numbered = spark.read.parquet(str(tmp_path / "out" / "tuples"))
    want = sequence(event_tuples(spark, "/root/testdata/sf0.001"))
    pairs = lambda df: {(r["side"], r["seq"], r["val"]) for r in df.collect()}
    assert numbered.count() == want.count() and pairs(numbered) == pairs(want)
    tuples = joins.read_numbered(spark, str(tmp_path / "out"))
    query = joins.start(joins.count_stream_join(tuples, 16, 64, "30 DAYS", "60 days"), "numbered", str(tmp_path / "state"))
    try:
        query.processAllAvailable()
        want = join.count_by_window(batched(event_tuples(spark, "/root/testdata/sf0.001"), 16), JoinSpec(16, 64, progress="EAGER"))
        got = {r["win"]: r["count"] for r in spark.table("numbered").groupBy("win").count().collect()}
        want = {r["win"]: r["matches"] for r in want.collect()}
        closed = [k for k in want if k < max(want)]  # a stream has no end, so its open batches join as well
        assert closed and {k: got.get(k) for k in closed} == {k: want[k] for k in closed}
    finally:
        query.stop()


def test_generators(spark):
    rows = datagen.generate(spark, 3000, distinct=50, upper=100).collect()
    assert [r["ts"] for r in sorted(rows)] == [k // 30 for k in range(3000)]
    assert {r["key"] for r in rows} == set(range(50)) and all(r["key"] == r["val"] for r in rows)
    with pytest.raises(ValueError):
        datagen.generate(spark, 10, upper=100)
    with pytest.raises(ValueError):
        datagen.generate(spark, 1000, mode="SOME", upper=10)
    skewed = Counter(r["key"] for r in datagen.generate(spark, 20000, theta=0.9, distinct=100, upper=100).collect())
    total = sum(k**-0.9 for k in range(1, 101))
    assert abs(skewed[0] / 20000 - 1 / total) < 0.02 and set(skewed) <= set(range(100)) and skewed[0] > skewed[5] > skewed[60]
    burst = [r["ts"] for r in datagen.generate(spark, 2000, mode="BURST", distinct=9, upper=500).collect()]
    assert all(0 <= t < 500 for t in burst) and len(set(burst)) > 100
    rows = sorted(datagen.generate(spark, 2000, mode="BURST", distinct=9, upper=500).collect())
    assert [r["ts"] for r in rows] == sorted(burst) and {r["key"] for r in rows} == set(range(9))
    keys = datagen.sorted_by(datagen.generate(spark, 2000, theta=0.5, distinct=50), "key").orderBy("id").collect()
    assert [r["key"] for r in keys] == sorted(r["key"] for r in datagen.generate(spark, 2000, theta=0.5, distinct=50).collect())


def test_experiments(spark, tmp_path):
    text = "algTypes: [HJ, SMJ]\ndeviceTypes: [CPU]\nprogressivenessModes: [LAZY]\ndistinctKeys: [10]\nzipfThetas: [0.0]\nresultMaterializationMethod: [NO_OUTPUT]\nwindowSizesMB: [1]\nbatchSizeKB: [128]\nmeasuredMetric: Throughput\nrepeat: 1\nparStrats: [INTRA]\n"
    (tmp_path / "grid.yaml").write_text(text)
    found = experiment.load_grid(str(tmp_path / "grid.yaml"))
    assert [x.spec.name for x in found] == ["lazy_cpu_hj_no_output", "lazy_cpu_smj_no_output"] and found[0].spec.batch == 8192
    one = experiment.Experiment(JoinSpec(16, 64), 10, 0.0, 2000)
    report = experiment.run_once(spark, one)
    assert report["matches"] > 0 and abs(report["selectivity"] - 10) < 1
    assert report["windows"] > 0 and abs(report["window_ms"] - report["time"] / report["windows"]) < 1e-6
    for output in ("COUNT_KERNEL", "ESTIMATED_SELECTIVITY", "BITMAP", "ATOMIC"):
        other = experiment.run_once(spark, experiment.Experiment(JoinSpec(16, 64, output=output), 10, 0.0, 2000))
        assert other["matches"] == report["matches"] and (other["overflown"] is not None) == (output == "ESTIMATED_SELECTIVITY")
    assert experiment.run_once(spark, experiment.Experiment(JoinSpec(16, 64, algorithm="EMPTY"), 10, 0.0, 2000))["matches"] == 0
    assert experiment.standalone(spark, 300_000)["windows"] == 2
    experiment.write_input(str(tmp_path / "in"), table(spark, [1, 2], [3]))
    assert spark.read.csv(str(tmp_path / "in")).count() == 3
    experiment.write_throughput(str(tmp_path / "t.csv"), [report])
    experiment.write_throughput(str(tmp_path / "t.csv"), [report])
    assert (tmp_path / "t.csv").read_text().count("algorithm_name") == 1
    experiment.write_progress(spark, str(tmp_path / "p"), one)
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == experiment.PROGRESS_COLUMNS
    asked = []
    run = lambda spark, x, size: asked.append(size) or {"time": size / 100, "size": size}
    best = experiment.sustainable(spark, one, run=run, precision=100)
    assert 90_000 <= best["size"] <= 105_000 and asked[:3] == [2000, 4000, 8000]
    assert (median([3, 1, 2]), median([1, 2, 4, 9])) == (2, 3)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["win", "matches", "possible_matches", "selectivity"]
    assert set(e.oracle_sql()) <= set(e.queries())
