"""Shared helpers: Arrow text slices with bounded temporaries, workers that give memory back, and durable tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one slice holds at most, unless a single text is longer.
SLICE_BYTES = 1 << 21


@dataclass
class Slice:
    """Some consecutive rows: ids, texts (null read as empty), their UTF-8 bytes and bounds."""

    ids: pa.Array
    texts: pa.Array
    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def piece(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut batches of (id, text) into slices of at most max_bytes; a longer text is a slice of its own."""
    for batch in batches:
        texts = pc.fill_null(batch.column(1).cast(pa.large_string()), "")
        n, start = len(texts), 0
        if not n:
            continue
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        while start < n:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max_bytes, "right")) - 1)
            yield Slice(
                batch.column(0).slice(start, end - start),
                texts.slice(start, end - start),
                whole[offsets[start] : offsets[end]],
                offsets[start : end + 1] - offsets[start],
            )
            start = end


def owners(bounds: np.ndarray) -> np.ndarray:
    """Row number of each byte (or item) that bounds delimit."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty rows sum to 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


#: What one operator keeps in a worker from task to task; the next task of another operator drops it.
_KEPT: dict[tuple, object] = {}


def kept(key: tuple, make: Callable):
    """What make gives, made once in a worker as long as nothing else is kept there."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _drop() -> None:
    """A function, as workers get a copy of a table that a task names."""
    _KEPT.clear()


def _give_back() -> None:
    """Memory that Arrow's pool and the C library hold without use goes to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def thrifty(run: Callable, keeps: bool = False) -> Callable:
    """A mapInArrow function whose worker gives back, when a task ends, the memory that the task has freed.

    Workers live on between tasks and steps; else each would hold the most that it ever took. Unless it keeps
    something itself, it drops what another operator has kept.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _drop()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def thrifty_group(judge: Callable) -> Callable:
    """The same for an applyInArrow function of one group, after each group."""

    def task(table: pa.Table) -> pa.Table:
        _drop()
        try:
            return judge(table)
        finally:
            _give_back()

    return task


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one only on a local master, where there is one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="tables-"))
    return _LOCAL[0]


def durable(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read from there: lineage ends, and lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that `durable` wrote and that nothing needs any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.table_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(df: DataFrame) -> None:
    """Let Spark delete shuffle files of plans that are no longer referred to; it does so when the driver collects garbage."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
