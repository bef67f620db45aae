"""Encoding as files arrive: a folder is watched, each new TIFF becomes a row with its gain map file and report.

Encoding keeps no state from file to file, so a query needs no watermark; the checkpoint remembers which files were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import encode
from ..plans.options import EncodeOptions

FILE = StructType.fromDDL("path string, modificationTime timestamp, length long, content binary")


def arriving(spark: SparkSession, folder: str, files_per_trigger: int = 64, pattern: str = "*.tif") -> DataFrame:
    """(path, content) of files as they appear in a folder; so many a trigger at most, which bounds what is in flight."""
    reader = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern)
    return reader.load(folder).select("path", "content")


def encode_arriving(spark: SparkSession, folder: str, out: str, checkpoint: str, options: EncodeOptions | None = None, once: bool = False, **limits) -> StreamingQuery:
    """A running query that appends (path, ok, error, report, content) of each new file to a table of Parquet files."""
    rows = encode.encode_files(arriving(spark, folder, **limits), options)
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
