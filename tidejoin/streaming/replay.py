"""A streaming source that replays a numbered log of both sides batch by batch, and admits a bounded number a trigger.

The log is Parquet under ``side=L`` and ``side=R``, numbered by ``seq`` and sorted by it in each file, as write_log()
leaves it. An offset is a number of batches: a batch is on offer once both sides hold it whole, so a tail that only one
side has waits, and at most ``tuples`` tuples a side are admitted at a time. What a trigger has admitted stands in
Spark's own offset log, where a restarted query finds it again; nothing is read twice. The driver reads file footers
only, each once; tasks read the row groups of their stretch.

Paths are opened by pyarrow's file systems (local, HDFS, object stores). This module imports nothing of its package:
its class is pickled by value, so executors need no copy of it.
"""

from __future__ import annotations

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "key long, val long, ts long, side string, seq long"
ROWS = 1 << 16
#: Tuples that a task of a trigger reads at most, and bytes of a row group: a trigger reads the groups of its stretch only,
#: so that reading a log costs the same a tuple however long its files are.
PIECE, GROUP_BYTES = 1 << 17, 2 << 20


class _Stretch(InputPartition):
    """Rows ``first`` to ``last`` of a side, all in one file."""

    def __init__(self, path: str, side: str, first: int, last: int):
        self.path, self.side, self.first, self.last = path, side, first, last


class ReplayReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.batch = options["path"], int(options["batch"])
        self.most = max(1, int(options.get("tuples", 1 << 20)) // self.batch)
        self.checkpoint = options.get("checkpoint")
        self.files: dict[str, dict[str, tuple[int, int]]] = {"L": {}, "R": {}}
        self.at = self._admitted()

    @staticmethod
    def _open(path: str):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(path)

    def _admitted(self) -> int:
        """Batches in the latest offset that Spark has logged; 0 for a new query."""
        if not self.checkpoint:
            return 0
        from pyarrow.fs import FileSelector

        fs, root = self._open(self.checkpoint)
        found = fs.get_file_info(FileSelector(f"{root}/offsets", allow_not_found=True))
        numbers = [int(f.base_name) for f in found if f.base_name.isdigit()]
        if not numbers:
            return 0
        with fs.open_input_file(f"{root}/offsets/{max(numbers)}") as f:
            return json.loads(f.read().decode().strip().splitlines()[-1])["batch"]

    def _look(self, side: str) -> None:
        """Take in the files that have come, by their footers."""
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        fs, root = self._open(self.path)
        for f in fs.get_file_info(FileSelector(f"{root}/side={side}", allow_not_found=True)):
            if f.base_name.endswith(".parquet") and f.path not in self.files[side]:
                with fs.open_input_file(f.path) as file:
                    meta = pq.read_metadata(file)
                at = meta.schema.names.index("seq")
                stats = [meta.row_group(k).column(at).statistics for k in range(meta.num_row_groups) if meta.row_group(k).num_rows]
                if stats:
                    self.files[side][f.path] = (min(s.min for s in stats), max(s.max for s in stats))

    def _whole(self, side: str) -> int:
        """Batches that a side holds without a gap."""
        self._look(side)
        end = 0
        for first, last in sorted(self.files[side].values()):
            if first > end:
                break
            end = max(end, last + 1)
        return end // self.batch

    def initialOffset(self) -> dict:
        return {"batch": 0}

    def latestOffset(self) -> dict:
        self.at = max(self.at, min(self.at + self.most, self._whole("L"), self._whole("R")))
        return {"batch": self.at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        first, last = start["batch"] * self.batch, end["batch"] * self.batch - 1
        self.at = max(self.at, end["batch"])
        out: list[InputPartition] = []
        for side in ("L", "R"):
            if last >= first and max((b for _, b in self.files[side].values()), default=-1) < last:
                self._look(side)  # a restarted query plans before it asks for offsets
            for path, (a, b) in sorted(self.files[side].items(), key=lambda x: x[1]):
                if max(a, first) <= min(b, last):
                    low, high = max(a, first), min(b, last)
                    out += [_Stretch(path, side, k, min(k + PIECE - 1, high)) for k in range(low, high + 1, PIECE)]
        return out

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        fs, _ = self._open(self.path)
        with fs.open_input_file(partition.path) as f:
            file = pq.ParquetFile(f)
            at = file.schema_arrow.names.index("seq")
            groups = [k for k in range(file.num_row_groups) if (s := file.metadata.row_group(k).column(at).statistics) and s.min <= partition.last and s.max >= partition.first]
            for batch in file.iter_batches(ROWS, row_groups=groups, columns=["key", "val", "ts", "seq"]):
                seq = batch.column("seq")
                held = batch.filter(pc.and_(pc.greater_equal(seq, partition.first), pc.less_equal(seq, partition.last)))
                if held.num_rows:
                    side = pa.array([partition.side] * held.num_rows, pa.string())
                    yield pa.RecordBatch.from_arrays([*(held.column(c) for c in ("key", "val", "ts")), side, held.column("seq")], names=["key", "val", "ts", "side", "seq"])


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ReplayReader(dict(self.options))


def write_log(numbered: DataFrame, path: str) -> None:
    """Append tuples (key, val, ts, side, seq) to a log; ``ts`` becomes microseconds. A file is a stretch of one side, in small row groups."""
    ts = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
    rows = numbered.select("key", "val", ts, "side", F.col("seq").cast("long"))
    rows.repartitionByRange("side", "seq").sortWithinPartitions("side", "seq").write.mode("append").option("parquet.block.size", GROUP_BYTES).partitionBy("side").parquet(path)


def read_replay(spark: SparkSession, path: str, batch: int, checkpoint: str | None = None, tuples: int = 1 << 20) -> DataFrame:
    """The log as a stream of key, val, ts (microseconds), side, seq: at most ``tuples`` a side a trigger.

    ``checkpoint`` is the query's checkpoint location, from which a restart goes on.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(ReplaySource)
    reader = spark.readStream.format("replay").option("path", path).option("batch", batch).option("tuples", tuples)
    return (reader.option("checkpoint", checkpoint) if checkpoint else reader).load()
