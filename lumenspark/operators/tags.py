"""Exif fields as rows tags(path, ifd, tag, type, count, value): what a JPEG carries, what it needs, and where values come to lie."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..codecs import exif
from ..sources.files import mapped


def carried(tags: DataFrame) -> DataFrame:
    """Fields that may be carried over: listed ones of the first directory, all but two of Exif, all of GPS; none without a value or over 65535 bytes."""
    ifd, tag = F.col("ifd"), F.col("tag")
    able = F.when(ifd == "ifd0", tag.isin(*exif.KEPT)).when(ifd == "exif", ~tag.isin(*exif.LEFT_OUT)).otherwise(ifd == "gps")
    n = F.count("*").over(Window.partitionBy("path", "ifd"))
    return tags.withColumn("_n", n).where(able & F.col("value").isNotNull() & (F.length("value") <= exif.MOST_BYTES) & (F.col("_n") <= exif.MOST_ENTRIES)).drop("_n")


def required(sizes: DataFrame) -> DataFrame:
    """Fields set for every image of sizes(path, width, height, srgb): upright, its size and space."""
    short = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 4, "0"))
    long_ = lambda v: F.unhex(F.lpad(F.hex(v.cast("long")), 8, "0"))
    row = lambda d, t, k, v: F.struct(F.lit(d).alias("ifd"), F.lit(t).alias("tag"), F.lit(k).alias("type"), F.lit(1).cast("long").alias("count"), v.alias("value"))
    made = F.array(
        row("ifd0", exif.ORIENTATION, 3, short(F.lit(1))), row("exif", exif.WIDTH, 4, long_(F.col("width"))), row("exif", exif.HEIGHT, 4, long_(F.col("height"))),
        row("exif", exif.COLOUR_SPACE, 3, short(F.when(F.col("srgb"), 1).otherwise(0xFFFF))),
    )
    return sizes.select("path", F.explode(made).alias("t")).select("path", "t.*")


def completed(tags: DataFrame, sizes: DataFrame) -> DataFrame:
    """The carried fields of each image with those that are set, and the conventional defaults of those that are absent."""
    key = ["path", "ifd", "tag"]
    columns = ["path", "ifd", "tag", "type", "count", "value"]
    put = required(sizes).select(*columns)
    out = tags.select(*columns).join(put, key, "left_anti").unionByName(put)
    spark = tags.sparkSession
    rows = [(d, t.tag, t.type, t.count, bytearray(t.value)) for d, t in exif.REQUIRED]
    defaults = sizes.select("path").join(F.broadcast(spark.createDataFrame(rows, "ifd string, tag int, type int, count long, value binary")))  # seven rows
    return out.unionByName(defaults.select(*columns).join(out, key, "left_anti"))


def laid_out(tags: DataFrame) -> DataFrame:
    """Adds to each field, in order of tags, its entry's number and where its value lies behind the directory (null for values of up to 4 bytes)."""
    order = Window.partitionBy("path", "ifd").orderBy("tag")
    size = F.length("value")
    padded = F.when(size > 4, size + size % 2).otherwise(0)
    before = F.coalesce(F.sum(padded).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return tags.withColumns({"entry": F.row_number().over(order) - 1, "place": F.when(size > 4, before)})


def payloads(tags: DataFrame) -> DataFrame:
    """(path, payload): the Exif segment's payload of each image; empty if it does not fit. A file has at most 3 x 512 fields."""
    listed = tags.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ifd", "tag", "type", "count", "value"))).alias("tags"))

    def run(path, rows) -> Iterator[tuple]:
        dirs: dict[str, list[exif.Tag]] = {}
        for r in rows:
            dirs.setdefault(r["ifd"], []).append(exif.Tag(r["tag"], r["type"], r["count"], bytes(r["value"])))
        yield path, exif.app_payload(dirs)

    return mapped(listed, run, "path string, payload binary")
