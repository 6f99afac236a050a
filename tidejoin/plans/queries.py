"""Queries over the event stream, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..model import JoinSpec
from ..operators import join, runs, sketch, timewin, windows
from ..sources import datagen
from ..sources.sequence import batched, event_tuples, line_tuples, sequence
from . import experiment, streams

BATCH, WINDOW = 64, 512
WIDTH_MS = 36 * 3600 * 1000
CONFIG = {
    "algTypes": ["HJ", "SMJ", "NLJ"], "deviceTypes": ["CPU", "GPU"], "progressivenessModes": ["LAZY", "EAGER"], "distinctKeys": [100, 1000], "zipfThetas": [0.0, 0.5],
    "resultMaterializationMethod": ["NO_OUTPUT"], "windowSizesMB": [1, 2], "batchSizeKB": [128], "measuredMetric": "Throughput", "repeat": 2, "parStrats": ["INTER", "INTRA", "HYBRID"],
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _spec(progress: str, algorithm: str = "HJ", **more) -> JoinSpec:
    return JoinSpec(BATCH, WINDOW, algorithm=algorithm, progress=progress, **more)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join.by_window(batched(event_tuples(spark, sf_dir), 16), JoinSpec(16, 64))


def _tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batched(event_tuples(spark, sf_dir), BATCH)


def _joined(f, progress: str, algorithm: str = "HJ", **more) -> Query:
    return lambda spark, d: f(_tuples(spark, d), _spec(progress, algorithm, **more))


_EVENTS = "SELECT user_id AS key, event_id AS val, ts, CASE WHEN event_type IN ('click', 'view') THEN 'L' ELSE 'R' END AS side FROM events"
_LINES = "SELECT l_suppkey AS key, 8 * l_orderkey + l_linenumber AS val, l_shipdate AS ts, CASE WHEN l_linenumber % 2 = 1 THEN 'L' ELSE 'R' END AS side FROM lineitem"


def _ctes(progress: str, batch: int = BATCH, window: int = WINDOW, source: str = _EVENTS) -> str:
    spec = JoinSpec(batch, window, progress=progress)
    if progress == "LAZY":
        win, keep = f"batch // {spec.whole}", f"win < greatest(0, (nb - {spec.touched - spec.whole}) // {spec.whole})"
    else:
        win, keep = f"arr // {2 * spec.touched - 1}", "TRUE"
    return f"""
WITH t AS ({source}),
s AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY ts, val) - 1 AS seq FROM t),
nb AS (SELECT least(count(*) FILTER (side = 'L') // {batch}, count(*) FILTER (side = 'R') // {batch}) AS nb FROM t),
b AS (SELECT s.*, seq // {batch} AS batch, 2 * (seq // {batch}) + CASE WHEN side = 'R' THEN 1 ELSE 0 END AS arr, nb FROM s, nb WHERE seq // {batch} < nb),
w AS (SELECT * FROM (SELECT *, {win} AS win FROM b) WHERE {keep}),
j AS (SELECT l.win, l.key AS lkey, r.key AS rkey, l.val AS lval, r.val AS rval, l.ts AS lts, r.ts AS rts, l.seq AS lseq, r.seq AS rseq, l.arr AS larr, r.arr AS rarr
      FROM w l JOIN w r ON l.side = 'L' AND r.side = 'R' AND l.win = r.win AND l.key = r.key),
z AS (SELECT win, count(*) FILTER (side = 'L') AS l, count(*) FILTER (side = 'R') AS r FROM w GROUP BY win)
"""


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


_RESULT = "win, lkey, rkey, lval, rval, lts, rts"
_add("src_tuples", lambda s, d: sequence(event_tuples(s, d)).select("side", "seq", "key", "val", "ts"), _ctes("LAZY") + "SELECT side, seq, key, val, ts FROM s")
_add("seq_ranges", lambda s, d: sequence(event_tuples(s, d), ranges=64).select("side", "seq", "key", "val", "ts"), ORACLE_SQL["src_tuples"])
_add("seq_batches", lambda s, d: _tuples(s, d).select("side", "batch", "seq", "val", windows.arrival().alias("arr")), _ctes("LAZY") + "SELECT side, batch, seq, val, arr FROM b")
for _mode in ("LAZY", "EAGER"):
    _low = _mode.lower()
    _sql = _ctes(_mode)
    for _alg in ("NLJ", "HJ", "SMJ"):
        _add(f"{_low}_{_alg.lower()}_count", _joined(join.count_by_window, _mode, _alg), _sql + "SELECT win, count(*) AS matches FROM j GROUP BY win")
        _add(f"{_low}_{_alg.lower()}_materialized", _joined(join.materialize, _mode, _alg, output="ATOMIC"), _sql + f"SELECT {_RESULT} FROM j")
    for _par in ("INTER", "HYBRID"):
        _add(f"{_low}_hj_count_{_par.lower()}", _joined(join.count_by_window, _mode, "HJ", parallel=_par), _sql + "SELECT win, count(*) AS matches FROM j GROUP BY win")
    _add(f"{_low}_nlj_bitmap", _joined(join.bitmap, _mode, "NLJ", output="BITMAP"), _sql + "SELECT win, lseq, rseq // 32 AS word, bit_or(CAST(1 AS BIGINT) << CAST(rseq % 32 AS BIGINT)) AS bits FROM j GROUP BY 1, 2, 3")
    _add(f"{_low}_bitmap_decoded", lambda s, d, m=_mode: join.decode_bitmap(join.bitmap(_tuples(s, d), _spec(m, "NLJ"))), _sql + "SELECT win, lseq, rseq FROM j")
    _add(f"{_low}_smj_histogram_count", _joined(join.count_by_histogram, _mode, "SMJ"), _sql + "SELECT win, count(*) AS matches FROM j GROUP BY win")
    _add(f"{_low}_selectivity", _joined(join.selectivity, _mode), _sql + f"SELECT (SELECT {'count(*)' if _mode == 'LAZY' else 'coalesce(max(win), 0)'} FROM z) AS windows, (SELECT count(*) FROM j) AS matches, (SELECT CAST(coalesce(sum(l * r), 0) AS BIGINT) FROM z) AS possible, 100.0::DOUBLE * (SELECT count(*) FROM j) / nullif((SELECT sum(l * r) FROM z), 0) AS selectivity")
    _add(f"{_low}_windows", _joined(join.by_window, _mode), _sql + "SELECT win, coalesce(m, 0) AS matches, l * r AS possible_matches, 100.0::DOUBLE * coalesce(m, 0) / nullif(l * r, 0) AS selectivity FROM z LEFT JOIN (SELECT win, count(*) AS m FROM j GROUP BY win) USING (win)")
    if _mode == "LAZY":
        _rows = f"e AS (SELECT win, 2 * (win + 1) * {WINDOW // BATCH} - 1 AS arr, TRUE AS closed, count(j.lseq) AS matches FROM (SELECT DISTINCT win FROM w) LEFT JOIN j USING (win) GROUP BY win)"
    else:
        _rows = "x AS (SELECT DISTINCT arr, win FROM w), y AS (SELECT *, coalesce(lag(win) OVER (ORDER BY arr) < win, FALSE) AS closed FROM x), e AS (SELECT y.win, y.arr, y.closed, count(j.lseq) AS matches FROM y LEFT JOIN j ON greatest(larr, rarr) = y.arr GROUP BY ALL)"
    _add(f"{_low}_progress", _joined(stats.progress, _mode), _sql + f", {_rows} SELECT arr, win, matches, CAST(sum(matches) OVER (ORDER BY arr) AS BIGINT) AS current_matches, closed AS is_window_closed FROM e")
_sql = _ctes("LAZY")
_add("lazy_estimated_capacity", _joined(stats.estimated_capacity, "LAZY"), _sql + ", d AS (SELECT count(DISTINCT key) AS d FROM w) SELECT win, CAST(ceil(1.125 * ceil(l * r / d)) AS BIGINT) AS capacity, 1.0::DOUBLE / d AS estimated_selectivity FROM z, d")
for _alg, _output in (("NLJ", "ESTIMATED_SELECTIVITY"), ("SMJ", "ESTIMATED_SELECTIVITY")):
    _add(f"lazy_{_alg.lower()}_capacity", _joined(stats.estimated_capacity, "LAZY", _alg, output=_output), _sql + f", d AS (SELECT count(DISTINCT key) AS d FROM w) SELECT win, CAST(ceil({stats.ROOM[_alg]} * ceil(l * r / d)) AS BIGINT) AS capacity, 1.0::DOUBLE / d AS estimated_selectivity FROM z, d")
_add("lazy_empty", _joined(join.by_window, "LAZY", "EMPTY"), _sql + "SELECT win, CAST(0 AS BIGINT) AS matches, l * r AS possible_matches, 0.0::DOUBLE AS selectivity FROM z")
_add("key_histogram", _joined(join.histogram, "LAZY"), _sql + "SELECT side, win, key, count(*) AS n FROM w GROUP BY 1, 2, 3")
_add("key_prefix_sum", _joined(stats.prefix_sums, "LAZY"), _sql + ", h AS (SELECT side, win, key, count(*) AS n FROM w GROUP BY 1, 2, 3) SELECT side, win, key, n, CAST(coalesce(sum(n) OVER (PARTITION BY side, win ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM h")
_add("counting_sort_slots", _joined(stats.slots, "LAZY"), _sql + "SELECT side, win, key, val, row_number() OVER (PARTITION BY side, win ORDER BY key, seq) - 1 AS slot FROM w")
_add("latest_results_ring", _joined(stats.latest_results, "LAZY"), _sql + ", n AS (SELECT row_number() OVER (ORDER BY win, lseq, rseq) - 1 AS pos, count(*) OVER () AS total, win, lseq, rseq, lval, rval FROM j) SELECT pos % 1024 AS slot, win, lseq, rseq, lval, rval FROM n WHERE pos >= total - 1024")
# The time from a window's first tuple to its last stands for what it took.
_add(
    "median_window_span", lambda s, d: windows.assign_windows(_tuples(s, d), _spec("LAZY")).groupBy("win").agg((F.max(F.unix_micros(F.col("ts").cast("timestamp"))) - F.min(F.unix_micros(F.col("ts").cast("timestamp")))).alias("us")).agg(F.floor(F.percentile("us", 0.5)).alias("median_us")),
    _sql + "SELECT CAST(floor(quantile_cont(us, 0.5)) AS BIGINT) AS median_us FROM (SELECT win, max(epoch_us(ts)) - min(epoch_us(ts)) AS us FROM w GROUP BY win)",
)
_add("window_w_not_multiple_of_b", lambda s, d: join.by_window(batched(event_tuples(s, d), 48), JoinSpec(48, 200)), _ctes("LAZY", 48, 200) + "SELECT win, coalesce(m, 0) AS matches, l * r AS possible_matches, 100.0::DOUBLE * coalesce(m, 0) / nullif(l * r, 0) AS selectivity FROM z LEFT JOIN (SELECT win, count(*) AS m FROM j GROUP BY win) USING (win)")


_add("lazy_hj_skew", lambda s, d: join.skew_join(batched(line_tuples(s, d), BATCH), JoinSpec(BATCH, 256)).select("win", *join.RESULT), _ctes("LAZY", BATCH, 256, _LINES) + f"SELECT {_RESULT} FROM j")

for _mode in ("LAZY", "EAGER"):
    _low = _mode.lower()
    _add(f"{_low}_join_size_sketch", lambda s, d, m=_mode: sketch.sized_windows(_tuples(s, d), _spec(m)).select("win", "matches", "within"), _ctes(_mode) + "SELECT win, count(*) AS matches, TRUE AS within FROM j GROUP BY win")
    _add(f"{_low}_smj_bucketed", lambda s, d, m=_mode: runs.join_runs(s, runs.write_runs(_tuples(s, d), _spec(m, "SMJ"))).select("win", *join.RESULT), ORACLE_SQL[f"{_low}_smj_materialized"])


def _time_sql(progress: str) -> str:
    count = "ROWS UNBOUNDED PRECEDING" if progress == "EAGER" else "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    keep = "TRUE" if progress == "EAGER" else "win < (SELECT count(*) FROM closes)"
    return _ctes("LAZY").replace("WITH t", "WITH RECURSIVE t", 1) + f""",
lb AS (SELECT arr, arg_max(epoch_ms(ts), seq) AS last FROM b GROUP BY arr),
wm AS (SELECT arr, max(last) OVER (ORDER BY arr) AS wm FROM lb),
nx AS (SELECT a.arr, min(c.arr) AS nxt FROM wm a JOIN wm c ON c.wm >= a.wm + {WIDTH_MS} GROUP BY a.arr),
closes AS (SELECT nxt AS close_at FROM nx WHERE arr = 0 UNION ALL SELECT nx.nxt FROM closes JOIN nx ON nx.arr = closes.close_at),
bw AS (SELECT * FROM (SELECT arr, CAST(coalesce(sum(CASE WHEN arr IN (SELECT close_at FROM closes) THEN 1 ELSE 0 END) OVER (ORDER BY arr {count}), 0) AS BIGINT) AS win FROM wm) WHERE {keep}),
p AS (SELECT b.*, bw.win FROM b JOIN bw USING (arr))
SELECT l.win, l.key AS lkey, r.key AS rkey, l.val AS lval, r.val AS rval, l.ts AS lts, r.ts AS rts FROM p l JOIN p r ON l.side = 'L' AND r.side = 'R' AND l.win = r.win AND l.key = r.key"""


_add("time_lazy_join", lambda s, d: timewin.time_join(_tuples(s, d), WIDTH_MS, "LAZY"), _time_sql("LAZY"))
_add("time_eager_join", lambda s, d: timewin.time_join(_tuples(s, d), WIDTH_MS, "EAGER"), _time_sql("EAGER"))
_add("tumbling_time_join", lambda s, d: timewin.tumbling_join(event_tuples(s, d), "1 day"), _sql + "SELECT date_trunc('day', l.ts)::TIMESTAMP AS start, l.key AS lkey, r.key AS rkey, l.val AS lval, r.val AS rval, l.ts AS lts, r.ts AS rts FROM t l JOIN t r ON l.side = 'L' AND r.side = 'R' AND date_trunc('day', l.ts) = date_trunc('day', r.ts) AND l.key = r.key")

# The same over a replayed stream: windows are kept in state, and results are written and read back.
_add("stream_seq_batches", lambda s, d: streams.batches(s, d, BATCH), ORACLE_SQL["seq_batches"])
for _mode in ("LAZY", "EAGER"):
    _low = _mode.lower()
    _add(f"stream_{_low}_count", lambda s, d, m=_mode: streams.counts(s, d, BATCH, WINDOW, m), ORACLE_SQL[f"{_low}_hj_count"])
    _add(f"stream_{_low}_progress", lambda s, d, m=_mode: streams.curve(s, d, BATCH, WINDOW, m), ORACLE_SQL[f"{_low}_progress"])
    _add(f"stream_{_low}_materialized", lambda s, d, m=_mode: streams.rows(s, d, BATCH, window=WINDOW, progress=m), ORACLE_SQL[f"{_low}_hj_materialized"])
    _add(f"stream_time_{_low}_join", lambda s, d, m=_mode: streams.rows(s, d, BATCH, width_ms=WIDTH_MS, progress=m), ORACLE_SQL[f"time_{_low}_join"])


def _clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("us").over(Window.orderBy("trigger"))  # a row a trigger
    return streams.timed(spark, sf_dir, BATCH, WINDOW, "EAGER").withColumn("clock_ascends", F.col("us") > F.coalesce(before, F.lit(0))).drop("us")


_add(
    "stream_progress_clock", _clock,
    ORACLE_SQL["eager_progress"].split(", e AS (")[0] + f", e AS ({ORACLE_SQL['eager_progress'].split(', e AS (')[1].split(') SELECT arr, win')[0]}), g AS (SELECT arr // {2 * streams.ADMITTED} AS trigger, sum(matches) AS m, count(*) FILTER (closed) AS c FROM e GROUP BY 1) SELECT trigger, CAST(m AS BIGINT) AS matches, CAST(sum(m) OVER (ORDER BY trigger) AS BIGINT) AS current_matches, c AS closed_windows, TRUE AS clock_ascends FROM g",
)

_N, _D, _UB = 20_000, 1000, 1000
_P = datagen.PRIME
_UNIFORM = f"u1 AS (SELECT i, (i * 48271 + 123 * 16807 + 11) % {_P} AS x FROM range({_N}) r(i)), u2 AS (SELECT i, (x * x + i + 123) % {_P} AS x FROM u1), u AS (SELECT i, ((x * x + 7 * i + 369) % {_P}) / {float(_P)}::DOUBLE AS u FROM u2)"
_WEIGHTS = ", ".join(map(str, datagen.BURST_WEIGHTS))
_add("gen_steady_ts", lambda s, d: datagen.generate(s, _N, distinct=_D, upper=_UB).select("id", "ts"), f"SELECT i AS id, i // ({_N} // {_UB}) AS ts FROM range({_N}) r(i)")
_add("gen_uniform_keys", lambda s, d: datagen.generate(s, _N, distinct=_D).select("id", "key", "val"), f"WITH {_UNIFORM} SELECT i AS id, CAST(floor(u * {_D}) AS BIGINT) AS key, CAST(floor(u * {_D}) AS BIGINT) AS val FROM u")
_add(
    "gen_zipf_keys", lambda s, d: datagen.generate(s, _N, theta=0.5, distinct=_D).groupBy("key").agg(F.count("*").alias("n")),
    f"WITH {_UNIFORM}, z AS (SELECT sum(pow(1.0::DOUBLE / k, 0.5)) AS z FROM range(1, {_D + 1}) r(k)) SELECT key, count(*) AS n FROM (SELECT least(CASE WHEN u * z < 1 THEN 0 WHEN u * z < 1 + pow(0.5::DOUBLE, 0.5) THEN 1 ELSE floor({_D} * pow((1 - pow({2 / _D}::DOUBLE, 0.5)) / (1 - (1 + pow(0.5::DOUBLE, 0.5)) / z) * (u - 1) + 1, 2)) END, {_D - 1})::BIGINT AS key FROM u, z) GROUP BY key",
)
_add(
    "gen_burst_ts", lambda s, d: datagen.generate(s, _N, mode="BURST", distinct=_D, upper=_UB).groupBy("ts").agg(F.count("*").alias("n")),
    f"WITH g AS (SELECT i, ([{_WEIGHTS}])[(i % 360) + 1] AS w FROM range({_N}) r(i)), c AS (SELECT i, sum(w) OVER (ORDER BY i) - w AS lo, sum(w) OVER () AS total FROM g), m AS (SELECT i, CAST(lo AS HUGEINT) AS lo, CAST((CAST(i AS HUGEINT) * total) // {_N} AS HUGEINT) AS x FROM c), a AS (SELECT m.i, (SELECT 0) AS z, x FROM m), p AS (SELECT a.i, b.i AS place FROM a ASOF JOIN m b ON a.x >= b.lo) SELECT place % {_UB} AS ts, count(*) AS n FROM p GROUP BY 1",
)


_add("gen_burst_sorted", lambda s, d: datagen.generate(s, _N, mode="BURST", distinct=_D, upper=_UB).select("id", "ts"), ORACLE_SQL["gen_burst_ts"].replace("SELECT place % 1000 AS ts, count(*) AS n FROM p GROUP BY 1", "SELECT row_number() OVER (ORDER BY place % 1000) - 1 AS id, place % 1000 AS ts FROM p"))
_add("gen_zipf_sorted", lambda s, d: datagen.sorted_by(datagen.generate(s, _N, theta=0.5, distinct=_D), "key"), "WITH k AS (" + ORACLE_SQL["gen_zipf_keys"] + ") SELECT row_number() OVER (ORDER BY key) - 1 AS id, key FROM k, range(n) r(i)")


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(x.spec.algorithm, x.spec.device, x.spec.progress, x.distinct, x.theta, x.spec.window, x.spec.batch, x.spec.parallel, x.repeat) for x in experiment.grid(CONFIG)]
    return spark.createDataFrame(rows, "algorithm string, device string, progress string, distinct_key long, theta double, window long, batch long, par string, repeat long")


def _values(values, kind: str) -> str:
    return "(SELECT unnest([" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + f"]::{kind}[]) AS v)"


_add("experiment_grid", _grid, f"""SELECT a.v AS algorithm, d.v AS device, m.v AS progress, k.v AS distinct_key, z.v AS theta, w.v * {experiment.MIB} AS "window", b.v * {experiment.KIB} AS batch, p.v AS par, CAST({CONFIG["repeat"]} AS BIGINT) AS repeat
FROM {_values(CONFIG["algTypes"], "VARCHAR")} a, {_values(CONFIG["deviceTypes"], "VARCHAR")} d, {_values(CONFIG["progressivenessModes"], "VARCHAR")} m, {_values(CONFIG["distinctKeys"], "BIGINT")} k, {_values(CONFIG["zipfThetas"], "DOUBLE")} z, {_values(CONFIG["windowSizesMB"], "BIGINT")} w, {_values(CONFIG["batchSizeKB"], "BIGINT")} b, {_values(CONFIG["parStrats"], "VARCHAR")} p""")
