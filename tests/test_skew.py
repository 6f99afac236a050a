"""Hot keys: split joins give what a plain join gives, evenly; counts and progress make no pairs."""

import pytest
from pyspark.sql import functions as F

from tidejoin.functions import stats
from tidejoin.model import JoinSpec
from tidejoin.operators import join, skew
from tidejoin.operators.windows import assign_windows
from tidejoin.sources import datagen
from tidejoin.sources.sequence import batched, event_tuples


def zipf(spark, n, theta):
    pair = datagen.stream_pair(spark, n, theta=theta, distinct=1000, upper=1000)
    return pair.withColumn("ts", F.timestamp_millis("ts").cast("timestamp_ntz"))


@pytest.fixture
def plain_plans(spark):
    """Plans as they are written: partitions aren't merged at run time."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", before)


def largest(df):
    sizes = sorted(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
    return sizes[-1] / sizes[len(sizes) // 2]


@pytest.mark.parametrize("algorithm", ["HJ", "SMJ"])
def test_a_skewed_join_is_even(spark, plain_plans, algorithm):
    """theta 0.99: the largest task of the split join holds under twice the median; a plain one's, far more."""
    tuples = batched(zipf(spark, 16_000, 0.99), 1000, ranges=8)
    spec = JoinSpec(1000, 8000, algorithm)
    split, plain = join.skew_join(tuples, spec), join.window_join(tuples, spec)
    assert largest(split) < 2 < largest(plain)
    each = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("win", "lkey", "lseq", "rseq").cast("decimal(38,0)"))).first()
    assert each(split) == each(plain)


def test_hybrid_spreads_a_hot_key(spark, plain_plans):
    tuples = batched(zipf(spark, 16_000, 0.99), 1000, ranges=8)
    hybrid = join.window_join(tuples, JoinSpec(1000, 8000, parallel="HYBRID"))
    assert hybrid.count() == join.count_by_histogram(tuples, JoinSpec(1000, 8000)).agg(F.sum("matches")).first()[0]
    hot = skew.hot_keys(assign_windows(tuples, JoinSpec(1000, 8000)))
    assert hot and any(rows * columns > 4 for _, rows, columns in hot) and len(hot) <= skew.MOST


def test_even_keys_are_not_split(spark):
    tuples = batched(zipf(spark, 8000, 0.0), 500)
    assert skew.hot_keys(assign_windows(tuples, JoinSpec(500, 1000))) == []
    assert skew.hot_keys(assign_windows(tuples.where("key < 0"), JoinSpec(500, 1000))) == []


def test_null_keys_and_empty_sides(spark):
    rows = [(None if k % 3 else 7, k, k, s) for k in range(400) for s in "LR"] + [(7, 1000 + k, 1000 + k, "L") for k in range(50)]
    tuples = batched(spark.createDataFrame(rows, "key long, val long, ts long, side string").withColumn("ts", F.timestamp_millis("ts")), 10)
    spec = JoinSpec(10, 200)
    key = lambda df: sorted((r["win"], r["lkey"], r["lseq"], r["rseq"]) for r in df.collect())
    assert key(join.skew_join(tuples, spec)) == key(join.window_join(tuples, spec)) != []
    assert join.skew_join(tuples.where("side = 'L'"), spec).count() == 0


def test_counts_and_progress_make_no_pairs(spark):
    """Joins in the plans of counts meet on aggregated rows; progress has none but the one of running blocks."""
    tuples = batched(event_tuples(spark, "/root/testdata/sf0.001"), 16)
    for alg, node in (("HJ", "ShuffledHashJoin"), ("SMJ", "SortMergeJoin")):
        plan = join.count_by_window(tuples, JoinSpec(16, 64, alg))._jdf.queryExecution().optimizedPlan().toString()
        at = plan.index("Join Inner")
        assert plan[at:].count("Aggregate [") >= 2  # both inputs of the join
        assert node in join.count_by_window(tuples, JoinSpec(16, 64, alg))._jdf.queryExecution().executedPlan().toString()
    for mode in ("LAZY", "EAGER"):
        plan = stats.progress(tuples, JoinSpec(16, 64, progress=mode))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join") == 1 and "lkey" not in plan


def test_pairs_of_windows_by_sketch(spark):
    """Sketches of parts merge into the sketch of all, and estimates on skewed keys are close."""
    from tidejoin.operators import sketch

    tuples = batched(zipf(spark, 16_000, 0.8), 1000, ranges=4)
    spec = JoinSpec(1000, 4000)
    placed = assign_windows(tuples, spec)
    whole = sketch.agms(placed)
    parts = sketch.merged(sketch.agms(placed.where("val % 3 = 0")), sketch.agms(placed.where("val % 3 > 0")))
    rows = lambda df: sorted((r["win"], r["line"], r["bucket"], r["l"], r["r"]) for r in df.where("l != 0 or r != 0").collect())
    assert rows(whole) == rows(parts)
    sized = sketch.sized_windows(tuples, spec).collect()
    assert len(sized) == 4 and all(r["within"] for r in sized)
    assert any(r["estimated_matches"] != r["matches"] for r in sized)


def test_runs_join_without_shuffle_or_sort(spark):
    from tidejoin.operators import runs

    tuples = batched(event_tuples(spark, "/root/testdata/sf0.001"), 16)
    spec = JoinSpec(16, 64, "SMJ")
    written = runs.write_runs(tuples, spec)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    key = lambda df: sorted((r["win"], r["lkey"], r["lseq"], r["rseq"]) for r in df.collect())
    for _ in range(2):  # written once, joined again
        joined = runs.join_runs(spark, written)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
        assert key(joined) == key(join.window_join(tuples, spec)) != []
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before
    runs.drop_runs(spark, written)


@pytest.mark.parametrize("progress", ["LAZY", "EAGER"])
def test_time_windows_by_pointers_equal_the_ordered_pass(spark, monkeypatch, progress):
    """Both ways of finding closes, on late and repeated timestamps and gaps wider than a window."""
    import random

    from tidejoin.operators import timewin

    rng, at, rows = random.Random(4), 0, []
    for k in range(300):
        at += rng.choice([0, 0, 1, 5, 400])
        rows += [(k % 5, k, at * 1000 + rng.randrange(3000), s) for s in "LR"]
    tuples = batched(spark.createDataFrame(rows, "key long, val long, ts long, side string").withColumn("ts", F.timestamp_millis("ts")), 10)
    key = lambda df: sorted((r["arr"], r["win"]) for r in df.collect())
    ordered = key(timewin.batch_windows(tuples, 30_000, progress))
    monkeypatch.setattr(timewin, "CHAIN", 3)
    assert key(timewin.batch_windows(tuples, 30_000, progress)) == ordered and ordered[-1][1] > 5
