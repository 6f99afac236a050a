"""Times of a join's phases, read from the metrics of the plan that ran."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

PHASES = ("build_ms", "probe_ms", "sort_ms")


def _nodes(node) -> Iterator:
    """The nodes of a physical plan, through adaptive stages to what really ran; a reused exchange counts once."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(node.executedPlan())
        return
    if kind.startswith("ReusedExchange"):
        return
    yield node
    if kind.endswith("QueryStageExec"):
        yield from _nodes(node.plan())
        return
    children = node.children()
    for k in range(children.size()):
        yield from _nodes(children.apply(k))


def _metric(node, name: str) -> int:
    metrics = node.metrics()
    return int(metrics.apply(name).value()) if metrics.contains(name) else 0


def _same_stage(node) -> Iterator:
    """The nodes below that run in the same generated code."""
    children = node.children()
    for k in range(children.size()):
        child = children.apply(k)
        if child.getClass().getSimpleName() != "InputAdapter":
            yield child
            yield from _same_stage(child)


def run(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Run df to its last row; the number of rows, and PHASES in milliseconds, summed over tasks.

    build: hash tables; sort: all sorts; probe: the generated code around a join (hash probe or merge), less the builds
    and sorts inside it, so aggregates that Spark fused with the join are in it.
    """
    execution = df._jdf.queryExecution()
    rows = int(execution.toRdd().count())
    times = dict.fromkeys(PHASES, 0)
    for node in _nodes(execution.executedPlan()):
        times["build_ms"] += _metric(node, "buildTime")
        times["sort_ms"] += _metric(node, "sortTime")
        if node.getClass().getSimpleName() == "WholeStageCodegenExec":
            inside = list(_same_stage(node))
            if any(n.getClass().getSimpleName() in ("ShuffledHashJoinExec", "SortMergeJoinExec", "BroadcastHashJoinExec") for n in inside):
                spent = sum(_metric(n, "buildTime") + _metric(n, "sortTime") for n in inside)
                times["probe_ms"] += max(0, _metric(node, "pipelineTime") - spent)
    return rows, times


def averages(times: dict[str, int], windows: int) -> dict[str, float | None]:
    """Phase times by executed window; null if none was."""
    return {k: v / windows if windows else None for k, v in times.items()}
