"""Phase times from finished plans, in reports, and progress by the clock in its file."""

import csv

from tidejoin.model import JoinSpec
from tidejoin.operators import join
from tidejoin.plans import experiment, phases
from tidejoin.sources.sequence import batched, event_tuples


def test_phases_of_hash_and_merge_joins(spark):
    tuples = batched(event_tuples(spark, "/root/testdata/sf0.01"), 64, ranges=4)
    hashed, by_hash = phases.run(join.materialize(tuples, JoinSpec(64, 512)))
    merged, by_merge = phases.run(join.materialize(tuples, JoinSpec(64, 512, "SMJ")))
    assert hashed == merged == join.materialize(tuples, JoinSpec(64, 512)).count() > 0
    assert by_hash["probe_ms"] > 0 and by_merge["probe_ms"] > 0
    nodes = {n.getClass().getSimpleName() for n in phases._nodes(join.materialize(tuples, JoinSpec(64, 512))._jdf.queryExecution().executedPlan())}
    assert "ShuffledHashJoinExec" in nodes
    assert phases.averages({"build_ms": 9}, 3) == {"build_ms": 3} and phases.averages({"build_ms": 9}, 0) == {"build_ms": None}


def test_reports_have_phases(spark):
    report = experiment.run_once(spark, experiment.Experiment(JoinSpec(16, 64, output="ATOMIC"), 10, 0.0, 2000))
    assert all(report[k] >= 0 for k in phases.PHASES)
    none = experiment.run_once(spark, experiment.Experiment(JoinSpec(512, 1024), 10, 0.0, 1001))
    assert none["windows"] == 0 and all(none[k] is None for k in phases.PHASES)


def test_progress_file_by_the_clock(spark, tmp_path):
    x = experiment.Experiment(JoinSpec(64, 512, progress="EAGER"), 10, 0.0, 3000)
    experiment.write_timed_progress(spark, str(tmp_path / "p.csv"), x, admitted=16)
    with open(tmp_path / "p.csv") as f:
        rows = list(csv.DictReader(f))
    stamps, counts = [int(r["timestamp"]) for r in rows], [int(r["match_count"]) for r in rows]
    assert list(rows[0]) == experiment.PROGRESS_COLUMNS and len(rows) == 3
    assert stamps == sorted(set(stamps)) and counts == sorted(counts)
    tuples = batched(experiment.stream_pair(spark, 3000, theta=0.0, distinct=10), 64)
    assert counts[-1] == join.selectivity(tuples, x.spec).first()["matches"]


def test_dump_of_bursts(spark):
    rows = experiment.dump(spark, 2000, ("key", "val", "ts"), upper=500).collect()
    assert len(rows) == 2000 and [r["ts"] for r in rows] == sorted(r["ts"] for r in rows) and rows[0]["key"] == rows[0]["val"]
