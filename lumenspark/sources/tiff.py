"""TIFF files as tables: images with their acceptance, tags, segments, decoded bands and pixels.

Only `segments` touches whole files; it cuts them up, so that the segments of one large image are
decoded by many tasks. A predicate on rows belongs on the segments, before they are decoded.
Files that are not accepted give an `images` row with the reason and no segments.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..codecs import exif, tiff
from .files import mapped

IMAGES = "path string, accepted boolean, reason string, little boolean, width int, height int, channels int, samples int, bits int, is_float boolean, compression int, photometric int, planar int, predictor int, orientation int, tiled boolean, segments int, icc binary, xmp binary"
_GEOMETRY = "plane int, y0 int, x0 int, rows int, columns int, samples int"
_HOW = "little boolean, bits int, compression int, predictor int, photometric int, width int, height int, channels int"
SEGMENTS = f"path string, index int, {_GEOMETRY}, {_HOW}, raw binary"
BANDS = "path string, index int, plane int, y0 int, x0 int, rows int, columns int, channels int, data array<float>"
TAGS = "path string, ifd string, tag int, type int, count long, value binary"


def images(files: DataFrame) -> DataFrame:
    """One row per file of files(path, content): its header, or why it is not accepted."""

    def run(path, content) -> Iterator[tuple]:
        try:
            h = tiff.header(content or b"")
        except tiff.TiffError as e:
            yield (path, False, str(e)) + (None,) * 16
            return
        yield path, True, None, h.little, h.width, h.height, h.channels, h.samples, h.bits, h.is_float, h.compression, h.photometric, h.planar, h.predictor, h.orientation, h.tiled, len(h.offsets), h.icc, h.xmp

    return mapped(files.select("path", "content"), run, IMAGES)


def tags(files: DataFrame) -> DataFrame:
    """Fields of the first, Exif and GPS directories, values in big-endian order; unknown types and dangling values have none."""

    def run(path, content) -> Iterator[tuple]:
        try:
            h = tiff.header(content or b"")
        except tiff.TiffError:
            return
        for name, at in (("ifd0", h.ifd0), ("exif", h.exif), ("gps", h.gps)):
            for tag, kind, count, value in exif.directory(content, at, h.little) if at is not None else ():
                yield path, name, tag, kind, count, None if value is None else exif.big_endian(kind, value, h.little)

    return mapped(files.select("path", "content"), run, TAGS)


def segments(files: DataFrame) -> DataFrame:
    """Strips or tiles of accepted files, packed as they are, with what decoding needs."""

    def run(path, content) -> Iterator[tuple]:
        try:
            h = tiff.header(content or b"")
        except tiff.TiffError:
            return
        for index, plane, y0, x0, rows, columns, samples in h.geometry():
            if index >= len(h.offsets) or h.offsets[index] + h.sizes[index] > len(content):
                raise tiff.TiffError(f"{path}: truncated TIFF: pixel data")
            raw = content[h.offsets[index] : h.offsets[index] + h.sizes[index]]
            yield path, index, plane, y0, x0, rows, columns, samples, h.little, h.bits, h.compression, h.predictor, h.photometric, h.width, h.height, 1 if h.planar == 2 else h.channels, raw

    return mapped(files.select("path", "content"), run, SEGMENTS)


def rows_between(segs: DataFrame, first: int, count: int) -> DataFrame:
    """The segments that hold some of the rows; decode these only."""
    return segs.where((F.col("y0") < first + count) & (F.col("y0") + F.col("rows") > first))


def bands(segs: DataFrame) -> DataFrame:
    """Decoded light values of each segment, row by row with channels side by side."""

    def run(path, index, plane, y0, x0, rows, columns, samples, little, bits, compression, predictor, photometric, width, height, channels, raw) -> Iterator[tuple]:
        how = {"little": little, "bits": bits, "compression": compression, "predictor": predictor, "photometric": photometric, "width": width, "height": height, "channels": channels}
        v = tiff.band(raw, how, rows, columns, samples, y0, x0)
        yield path, index, plane, y0, x0, v.shape[0], v.shape[1], v.shape[2], v.reshape(-1)

    return mapped(segs.select("path", "index", "plane", "y0", "x0", "rows", "columns", "samples", "little", "bits", "compression", "predictor", "photometric", "width", "height", "channels", "raw"), run, BANDS)


def samples(decoded: DataFrame) -> DataFrame:
    """(path, y, x, c, v) of bands; planes of planar files are channels."""
    s = decoded.select("path", "plane", "y0", "x0", "columns", "channels", F.posexplode("data").alias("i", "v"))
    cell = F.expr("i div channels").cast("int")
    return s.select("path", (F.col("y0") + F.expr("i div (columns * channels)")).cast("int").alias("y"), (F.col("x0") + F.pmod(cell, "columns")).cast("int").alias("x"), (F.col("plane") + F.expr("i % channels")).cast("int").alias("c"), F.col("v").cast("double").alias("v"))


def pixels(decoded: DataFrame) -> DataFrame:
    """(image_id, y, x, r, g, b); a grey image has its value in all three. Chunky bands need no shuffle."""
    chunky = decoded.where("channels = 3")
    step = lambda k: F.transform(F.sequence(F.lit(0), F.expr("rows * columns - 1")), lambda i: F.element_at("data", i * 3 + k + 1).cast("double"))
    cells = chunky.select("path", "y0", "x0", "columns", F.posexplode(F.arrays_zip(step(0).alias("r"), step(1).alias("g"), step(2).alias("b"))).alias("i", "p"))
    place = (F.col("y0") + F.expr("i div columns")).cast("int").alias("y"), (F.col("x0") + F.expr("i % columns")).cast("int").alias("x")
    rgb = cells.select(F.col("path").alias("image_id"), *place, "p.r", "p.g", "p.b")
    split = samples(decoded.where("channels = 1")).groupBy(F.col("path").alias("image_id"), "y", "x").agg(*[F.max(F.when(F.col("c") == k, F.col("v"))).alias(n) for k, n in enumerate("rgb")])
    return rgb.unionByName(grey_to_rgb(split))


def grey_to_rgb(p: DataFrame) -> DataFrame:
    """Pixels whose green and blue are absent take the one channel there is."""
    return p.withColumn("g", F.coalesce("g", "r")).withColumn("b", F.coalesce("b", "r"))
