"""Whole files as rows, and the helper that runs a byte-level function over rows in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes and rows after which a batch goes out.
BATCH_BYTES, BATCH_ROWS = 1 << 24, 4096


def read_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, length, content) of all files that a glob names; Spark holds each file in one row, so 2 GB at most."""
    return spark.read.format("binaryFile").load(glob).select("path", "length", "content")


def mapped(df: DataFrame, f: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that f(row values) yields for each row of df, in batches of bounded size."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for values in zip(*columns, strict=True):
                for row in f(*values):
                    rows.append(row)
                    size += sum(len(v) * (1 if isinstance(v, bytes | str) else 8) for v in row if hasattr(v, "__len__"))
                    if size > BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    return df.mapInArrow(run, schema)
