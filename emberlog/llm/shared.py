"""Storage that the driver and all executors share, and lineage cuts kept there.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and everything runs in one
process (local tests) a temporary folder takes its place; on a cluster its absence is an error.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: An Arrow batch's rows and bytes at most.  The JVM and the Python worker each hold a batch whole, and copies of it.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; sets one only where the session names none."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


class Workspace:
    """Tables written to the shared folder during one query.

    A table that is read more than once is written once: a lost executor costs its own tasks only, and
    what was dealt out by a nondeterministic step (range sampling) stays as it was.  Results are lazy and may
    read these tables until the session ends; then they go.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        path, fs = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, where: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        self._n += 1
        path = f"{self.root}/t{self._n}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._emberlog_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that no later step reads."""
        path, fs = self._at(df._emberlog_path)
        fs.delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and what they keep adds up over a session."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with bounded batches; each task gives its memory back.

    The session's bound of rows is lowered where it is higher, that of bytes set where there is none; both stay so, as plans are
    made only when results are read.
    """

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    conf = df.sparkSession.conf
    rows, size = (f"spark.sql.execution.arrow.{x}PerBatch" for x in ("maxRecords", "maxBytes"))
    if not 0 < int(conf.get(rows, "0")) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    if conf.get(size, None) is None:
        conf.set(size, str(BATCH_BYTES))
    return df.mapInArrow(lean, schema)


def grouped(run: Callable) -> Callable:
    """A function of (key, table) for ``applyInArrow`` that gives its memory back after each group beyond a megabyte."""

    def lean(key: tuple, table: pa.Table) -> pa.Table:
        try:
            return run(key, table)
        finally:
            if table.nbytes > 1 << 20:
                release()

    return lean


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, changed until they differ from all columns (in any letter case)."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
        taken.add(n.lower())
    return out


def passed(columns: list[str], own: list[str]) -> list[str]:
    """The columns to pass through: those named like an operator's own give way to them."""
    mine = {c.lower() for c in own}
    return [c for c in columns if c.lower() not in mine]
