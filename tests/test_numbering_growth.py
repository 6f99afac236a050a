"""Numbering of large tables by ranges of the arrival order."""

from datetime import datetime

from pyspark.sql import functions as F

from tidejoin.model import JoinSpec
from tidejoin.operators import join
from tidejoin.operators.windows import assign_windows
from tidejoin.sources import sequence
from tidejoin.sources.sequence import batched, line_tuples


def test_numbering_splits_tuples_of_one_time(spark):
    """One timestamp for all: ranges stay even, and numbers follow val."""
    tuples = spark.range(20_000).select(F.col("id").alias("key"), ((F.col("id") * 7919) % 20_000).alias("val"), F.lit(datetime(2024, 1, 1)).alias("ts"), F.when(F.col("id") % 4 == 0, "L").otherwise("R").alias("side"))
    numbered, upto, path = sequence.number(tuples, 8)
    assert upto == {"L": 5000, "R": 15_000}
    tasks = [r["count"] for r in spark.read.parquet(path).groupBy("_part").count().collect()]
    assert len(tasks) == 8 and max(tasks) < 5000
    got = {s: [r["seq"] for r in numbered.where(F.col("side") == s).orderBy("val").collect()] for s in "LR"}
    assert got["L"] == list(range(5000)) and got["R"] == list(range(15_000))


def test_ranges_follow_rows_not_compressed_bytes(spark, tmp_path, monkeypatch):
    """A table that compresses well has as many ranges as its rows need."""
    monkeypatch.setattr(sequence, "SMALL_BYTES", 0)
    monkeypatch.setattr(sequence, "SMALL_ROWS", 1000)
    monkeypatch.setattr(sequence, "RANGE_ROWS", 100)
    spark.range(5000).select(F.lit(1).alias("key"), F.lit(1).alias("val"), F.lit(datetime(2024, 1, 1)).alias("ts"), F.lit("L").alias("side")).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert sequence._ranges(read) == 50 and sequence._ranges(read.limit(900)) == 0


def test_large_tables_are_numbered_once(spark):
    """Both sides of a skewed join read the written numbers: nothing is ordered again."""
    tuples = batched(line_tuples(spark, "/root/testdata/sf0.001"), 16, ranges=4)
    plan = join.skew_join(tuples, JoinSpec(16, 64))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "RepartitionByExpression" not in plan


def test_a_skewed_join_has_partitions_for_its_rows(spark, monkeypatch):
    """A hash table can't spill, so its rows are bounded whatever the session's partitions; the rows stay the same."""
    tuples = batched(line_tuples(spark, "/root/testdata/sf0.001"), 16, ranges=4)
    rows = lambda: join.skew_join(tuples, JoinSpec(16, 64)).select("win", *join.RESULT)
    plain = rows()
    monkeypatch.setattr(join, "TASK_ROWS", 100)
    dealt = rows()
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    n = -(-assign_windows(tuples, JoinSpec(16, 64)).count() // 100)
    assert n > 8 and plan.count(f", {n})") >= 2 and "ENSURE_REQUIREMENTS" not in plan and "ShuffledHashJoin" in plan
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, plain.collect())) != []


def _steady(path, n):
    """A steady stream that Parquet holds in a few bytes: n events, 50 users in turn, clicks and purchases."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    ids = list(range(n))
    table = pa.table({"event_id": ids, "ts": pa.array([1_704_067_200_000_000 + 40_000_000 * i for i in ids], pa.timestamp("us")), "user_id": [i % 50 for i in ids], "event_type": ["click" if i // 50 % 2 else "purchase" for i in ids]})
    pq.write_table(table, str(path / "events.parquet"), compression="zstd", use_dictionary=["event_type"], column_encoding={c: "DELTA_BINARY_PACKED" for c in ("event_id", "ts", "user_id")})


def _orders_a_side(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return any("Window [row_number()" in line and "[side" in line for line in plan.splitlines())


def test_a_stream_that_compresses_well_is_numbered_by_ranges(spark, tmp_path, monkeypatch):
    """Bytes don't bound rows: no query orders a whole side in one task, and its rows stay those of one window (F14, F15, F17, F19)."""
    from tidejoin.plans.queries import QUERIES

    _steady(tmp_path, 20_000)
    names = ("seq_batches", "time_eager_join", "lazy_estimated_capacity", "lazy_empty")
    rows = lambda name: sorted(map(repr, QUERIES[name](spark, str(tmp_path)).collect()))
    want = {name: rows(name) for name in names}
    assert all(want.values()) and _orders_a_side(QUERIES["seq_batches"](spark, str(tmp_path))) and sequence._ranges(sequence.event_tuples(spark, str(tmp_path))) == 0
    monkeypatch.setattr(sequence, "SMALL_ROWS", 1000)
    monkeypatch.setattr(sequence, "RANGE_ROWS", 1000)
    assert sequence._ranges(sequence.event_tuples(spark, str(tmp_path))) == 20
    for name in names:
        assert rows(name) == want[name]
        if name != "time_eager_join":  # which reads its numbers from a table either way
            assert not _orders_a_side(QUERIES[name](spark, str(tmp_path)))


def test_bounded_plans_are_not_counted(spark, monkeypatch):
    """What the plan bounds by rows needs no count; what multiplies rows isn't bounded."""
    monkeypatch.setattr(sequence, "SMALL_ROWS", 1000)
    monkeypatch.setattr(sequence, "RANGE_ROWS", 100)
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("ranges"))
    spark.sparkContext.setJobGroup("ranges", "")
    try:
        assert sequence._ranges(spark.range(1000)) == 0 and jobs() == 0
        many = spark.range(100).select(F.explode(F.sequence(F.lit(1), F.lit(30))).alias("val"))
        assert sequence._ranges(many) == 30
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_dealing_to_ranges_holds_no_tuples(spark, tmp_path, monkeypatch):
    """However large a table, its ranges stay few enough to be written straight to their files, not held first (F15, F17, F19)."""
    monkeypatch.setattr(sequence, "SMALL_ROWS", 1000)
    monkeypatch.setattr(sequence, "RANGE_ROWS", 10)
    _steady(tmp_path, 5000)
    tuples = sequence.event_tuples(spark, str(tmp_path))
    ranges = sequence._ranges(tuples)
    assert 100 < ranges <= int(spark.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    rows = lambda df: sorted(map(repr, df.select("side", "seq", "key", "val", "ts").collect()))
    assert rows(sequence.sequence(tuples)) == rows(sequence._windowed(tuples))


def test_a_time_join_of_a_large_stream_orders_no_side(spark, tmp_path, monkeypatch):
    """Its numbers come from ranges, though it reads them from a table (F15)."""
    from tidejoin.plans.queries import QUERIES

    _steady(tmp_path, 20_000)
    monkeypatch.setattr(sequence, "SMALL_ROWS", 1000)
    monkeypatch.setattr(sequence, "RANGE_ROWS", 1000)
    monkeypatch.setattr(sequence, "_windowed", lambda tuples: 1 / 0)
    assert QUERIES["time_eager_join"](spark, str(tmp_path)).count() > 0
