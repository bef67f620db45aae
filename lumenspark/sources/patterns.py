"""Synthetic rasters and scenes from their definitions, as rows made by expressions; and TIFF fixtures of rasters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..codecs import tiff
from .files import mapped

MASK = (1 << 32) - 1
# Multipliers of the grain hash and of the scene's generator.
GRAIN = (374761393, 668265263, 2246822519, 1274126177)
LCG = (1664525, 1013904223, 0x9E3779B9)
#: Size of the test card and its levels: field, panel, word, wedge labels, strip, label.
CARD = (1600, 1200)
LEVELS = {"field": 0.05, "panel": 1.0, "word": 4.0, "wedge_label": 0.85, "strip": 0.18, "label": 0.62}
PATCHES = 7


def grid(spark: SparkSession, width: int, height: int, image_id: str = "pattern") -> DataFrame:
    """(image_id, y, x) of a raster."""
    i = spark.range(width * height)
    return i.select(F.lit(image_id).alias("image_id"), F.expr(f"id div {width}").cast("int").alias("y"), F.expr(f"id % {width}").cast("int").alias("x"))


def hdr_pattern(spark: SparkSession, width: int, height: int, peak: float, image_id: str = "pattern") -> DataFrame:
    """(image_id, y, x, r, g, b): a grey gradient, a coloured one on top, and a bright corner."""
    g = grid(spark, width, height, image_id)
    u = F.col("x") / (width - 1) if width > 1 else F.lit(0.0)
    v = F.col("y") / (height - 1) if height > 1 else F.lit(0.0)
    corner, top, grey = (u > 0.7) & (v > 0.7), v < 0.3, 0.18 + 0.5 * u
    pick = lambda coloured: F.when(corner, F.lit(float(peak))).when(top, coloured).otherwise(grey)
    return g.select("image_id", "y", "x", pick(0.18 + 0.6 * u).alias("r"), pick(F.lit(0.18)).alias("g"), pick(0.5 - 0.4 * u).alias("b"))


def _product(a, k: int):
    """Product modulo 2^32 without leaving 63 bits."""
    high, low = k >> 16, k & 0xFFFF
    return (((a * high).bitwiseAND(F.lit(0xFFFF)) * 65536) + a * low).bitwiseAND(F.lit(MASK))


def grain(x, y, c: int):
    """A value of -0.5 to 0.5 for a place and channel."""
    v = (_product(x.cast("long"), GRAIN[0]) + _product(y.cast("long"), GRAIN[1]) + (c * GRAIN[2] & MASK)).bitwiseAND(F.lit(MASK))
    v = _product(v.bitwiseXOR(F.shiftrightunsigned(v, 13)), GRAIN[3])
    return v.bitwiseXOR(F.shiftrightunsigned(v, 16)).bitwiseAND(F.lit(0xFFFF)) / 65535.0 - 0.5


def detailed_pattern(spark: SparkSession, width: int, height: int, peak: float, image_id: str = "pattern") -> DataFrame:
    """The pattern with texture at two scales and grain that grow with its level."""
    p = hdr_pattern(spark, width, height, peak, image_id)
    x, y = F.col("x"), F.col("y")
    texture = 0.10 * F.sin(x * 0.31 + y * 0.17) * F.cos(x * 0.07 - y * 0.23)
    made = {n: F.greatest(F.lit(0.0), F.col(n) * (1 + texture) + 0.03 * F.col(n) * grain(x, y, k)) for k, n in enumerate("rgb")}
    return p.withColumns(made)


def lognormal_scene(spark: SparkSession, median: float, spread: float = 1.6, count: int = 20_000, scene_id: str = "scene", part: int = 1000) -> DataFrame:
    """(scene_id, i, l): luminances about a median from a linear congruential generator; each part of the scene jumps to its own state."""
    a, c, seed = LCG
    parts = spark.range(-(-count // part))

    def run(number) -> Iterator[tuple]:
        # n steps at once: state -> a^n * state + c * (a^n - 1) / (a - 1), modulo 2^32
        n = 3 * part * number
        wide = (a - 1) << 32
        state = (pow(a, n, 1 << 32) * seed + c * ((pow(a, n, wide) - 1) // (a - 1))) & MASK
        for i in range(part * number, min(count, part * (number + 1))):
            u = 0.0
            for _ in range(3):
                state = (a * state + c) & MASK
                u += (state >> 8) / (1 << 24)
            yield scene_id, i, float(median * 2.0 ** ((u - 1.5) * 2 * spread))

    return mapped(parts, run, "scene_id string, i int, l double")


def test_card(spark: SparkSession, glyphs: DataFrame | None = None, image_id: str = "card") -> DataFrame:
    """(image_id, y, x, l): field, panel, a wedge of half stops and a strip, later rectangles above earlier ones.

    glyphs(x0, y0, x1, y1, v) are further rectangles, such as the cells of letters from `letters`.
    """
    width, height = CARD
    step = (width - 160) // PATCHES
    base = [(80, 90, width - 80, 560, LEVELS["panel"])] + [(80 + i * step, 660, 80 + (i + 1) * step - 12, 980, 2.0 ** (i / 2)) for i in range(PATCHES)] + [(80, 1080, width - 80, 1140, LEVELS["strip"])]
    v = F.lit(LEVELS["field"])
    for x0, y0, x1, y1, level in base:
        v = F.when((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1), level).otherwise(v)
    card = grid(spark, width, height, image_id).withColumn("l", v)
    if glyphs is None:
        return card
    cells = glyphs.select(F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"), "x0", "x1", "v").select("y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"), "v").dropDuplicates(["y", "x"])
    return card.join(cells, ["y", "x"], "left").select("image_id", "y", "x", F.coalesce("v", "l").alias("l"))


def letters(spark: SparkSession, font: dict[str, list[str]], text: str, x0: int, y0: int, scale: int, level: float) -> DataFrame:
    """Rectangles of a text in a block font of 5 x 7 cells; a character without a glyph raises."""
    rows = []
    for k, ch in enumerate(text.upper()):
        if ch not in font and ch != " ":
            raise ValueError(f"the font has no glyph for {ch!r}")
        rows += [(x0 + (6 * k + c) * scale, y0 + r * scale, x0 + (6 * k + c + 1) * scale, y0 + (r + 1) * scale, level) for r, row in enumerate(font.get(ch, ())) for c, bit in enumerate(row) if bit == "#"]
    return spark.createDataFrame(rows, "x0 int, y0 int, x1 int, y1 int, v double")


def tiff_files(pixels: DataFrame, channels=("r", "g", "b"), **how) -> DataFrame:
    """(path, content): a TIFF of each image of pixels(image_id, y, x, channels), packed as `codecs.tiff.write` is told.

    Rows of pixels are gathered first, so that an image reaches its task as arrays.
    """
    cells = F.array_sort(F.collect_list(F.struct("x", *channels)))
    rows = pixels.groupBy("image_id", "y").agg(cells.alias("cells")).select("image_id", "y", F.flatten(F.transform("cells", lambda c: F.array(*[c[n].cast("double") for n in channels]))).alias("data"))
    images = rows.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "data"))).alias("rows"))

    def run(image_id, listed) -> Iterator[tuple]:
        v = np.array([r["data"] for r in listed]).reshape(len(listed), -1, len(channels))
        yield f"{image_id}.tif", tiff.write(v, **how)

    return mapped(images, run, "path string, content binary")


def expected_headroom(peak: float) -> float:
    return math.log2(peak) if peak > 1 else 0.0
