"""JPEG files as tables: their images, segments, multi-picture index, gain map payload, XMP packets and frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..codecs import container
from ..functions import binary
from .files import mapped

SEGMENTS = "path string, image_no int, seq int, marker int, offset long, payload_offset long, size int, payload binary"


def images(files: DataFrame) -> DataFrame:
    """(path, image_no, offset, size, image): the images of files(path, content); each begins at a start marker behind an end marker."""

    def run(path, content) -> Iterator[tuple]:
        at = 0
        for i, image in enumerate(container.split(content or b"")):
            yield path, i, at, len(image), image
            at += len(image)

    return mapped(files.select("path", "content"), run, "path string, image_no int, offset long, size long, image binary")


def segments(files: DataFrame) -> DataFrame:
    """Segments before the scan of every image, with places counted from the file's start."""

    def run(path, content) -> Iterator[tuple]:
        at = 0
        for i, image in enumerate(container.split(content or b"")):
            for k, s in enumerate(container.walk(image)[0]):
                yield path, i, k, s.marker, at + s.offset, at + s.payload, s.size, image[s.payload : s.end]
            at += len(image)

    return mapped(files.select("path", "content"), run, SEGMENTS)


def has(marker: int, prefix: bytes) -> Column:
    """Whether a segment has a marker and its payload begins with a prefix."""
    return (F.col("marker") == marker) & binary.starts(F.col("payload"), prefix)


def first(segs: DataFrame, marker: int, prefix: bytes) -> DataFrame:
    """Per file and image the first segment of its kind."""
    row = F.struct(*[c for c in segs.columns if c not in ("path", "image_no")])
    return segs.where(has(marker, prefix)).groupBy("path", "image_no").agg(F.min_by(row, "seq").alias("s")).select("path", "image_no", "s.*")


def index(segs: DataFrame) -> DataFrame:
    """(path, n, attr, type, size, offset): entries of each primary's index, in either byte order, read by expressions alone."""
    own = first(segs.where("image_no = 0"), 0xE2, container.MPF_ID).select("path", F.col("payload").alias("p"))
    own = own.withColumn("little", F.substring("p", 5, 2) == binary.raw(b"II"))
    u = lambda at, n: binary.read(F.col("p"), at, n, F.col("little"))
    own = own.withColumn("dir", (u(F.lit(8), 4) + 4).cast("int")).withColumn("tags", u(F.col("dir"), 2).cast("int"))
    entry = lambda i: F.struct(u(F.col("dir") + 2 + i * 12, 2).alias("tag"), u(F.col("dir") + 10 + i * 12, 4).alias("value"))
    listed = F.transform(F.sequence(F.lit(0), F.col("tags") - 1), entry)
    value = lambda tag: F.element_at(F.filter("listed", lambda e: e["tag"] == tag), 1)["value"].cast("int")
    own = own.where("tags > 0").withColumn("listed", listed).where(F.exists("listed", lambda e: e["tag"] == 0xB002) & F.exists("listed", lambda e: e["tag"] == 0xB001))
    own = own.withColumn("count", value(0xB001)).withColumn("entries", value(0xB002) + 4).where("count > 0")
    rows = own.select("path", "p", "little", "entries", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("n"))
    at = lambda k: u(F.col("entries") + F.col("n") * container.ENTRY + 4 * k, 4)
    return rows.select("path", "n", at(0).alias("attr"), at(0).bitwiseAND(F.lit(0xFFFFFF)).alias("type"), at(1).alias("size"), at(2).alias("offset"))


def payloads(segs: DataFrame) -> DataFrame:
    """(path, image_no, multi, use_base, writer_version, base_headroom, alt_headroom, channels): gain map payloads, not the bare marker of base images."""
    own = first(segs.where(F.col("size") > len(container.URN) + 4), 0xE2, container.URN)
    p, at = F.col("payload"), len(container.URN)
    flags = binary.read(p, F.lit(at + 4), 1)
    rational = lambda k: binary.read_rational(p, k * 8 + at + 5)
    names = ("lo", "hi", "gamma", "base_offset", "alt_offset")
    channel = lambda c: F.struct(*[rational(c * 5 + 2 + k).alias(n) for k, n in enumerate(names)])
    own = own.withColumn("multi", flags.bitwiseAND(F.lit(0x80)) > 0).withColumn("use_base", flags.bitwiseAND(F.lit(0x40)) > 0)
    rows = F.transform(F.sequence(F.lit(0), F.when(F.col("multi"), 2).otherwise(0)), channel)
    return own.select("path", "image_no", "multi", "use_base", binary.read(p, F.lit(at + 2), 2).alias("writer_version"), rational(F.lit(0)).alias("base_headroom"), rational(F.lit(1)).alias("alt_headroom"), rows.alias("channels"))


def packets(segs: DataFrame) -> DataFrame:
    """(path, image_no, seq, xml): XMP packets."""
    body = F.substring(F.col("payload"), F.lit(len(container.XMP_ID) + 1), F.length("payload"))
    return segs.where(has(0xE1, container.XMP_ID)).select("path", "image_no", "seq", F.decode(body, "UTF-8").alias("xml"))


def frames(segs: DataFrame) -> DataFrame:
    """(path, image_no, precision, height, width, components, sampling) from the frame header; sampling lists each component's factors."""
    p = F.col("payload")
    read = lambda at, n: binary.read(p, at, n).cast("int")
    factors = F.transform(F.sequence(F.lit(0), F.col("components") - 1), lambda i: F.concat_ws("x", binary.read(p, i * 3 + 7, 1).bitwiseAND(F.lit(15)), F.shiftright(binary.read(p, i * 3 + 7, 1), 4)))
    own = segs.where(F.col("marker").isin(0xC0, 0xC1, 0xC2))
    own = own.select("path", "image_no", "payload", read(F.lit(0), 1).alias("precision"), read(F.lit(1), 2).alias("height"), read(F.lit(3), 2).alias("width"), read(F.lit(5), 1).alias("components"))
    return own.where("components > 0").withColumn("sampling", F.array_join(factors, ",")).drop("payload")


def marker_counts(segs: DataFrame) -> DataFrame:
    """(path, marker, n)."""
    return segs.groupBy("path", "marker").agg(F.count("*").alias("n"))
