"""JPEG blocks as rows: geometry, quantisation steps, DCT coefficients, DC prediction, symbols; and the horizontal predictor of TIFF rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..codecs import jpeg
from ..sources.files import mapped


def geometry(width: Column, height: Column, factor: Column) -> Column:
    """Units across and down and padded sizes of an image whose units have factor x factor luma blocks."""
    units = lambda n: F.ceil(n / (factor * 8)).cast("long")
    return F.struct(units(width).alias("across"), units(height).alias("down"), (units(width) * factor * 8).cast("int").alias("width"), (units(height) * factor * 8).cast("int").alias("height"))


def repeated(at: Column, size: Column) -> Column:
    """The place whose sample stands for one beyond the edge."""
    return F.least(at, size - 1)


def quantisation(qualities: DataFrame) -> DataFrame:
    """Adds the luma and chroma steps, in natural order, of each quality."""
    q = F.least(F.lit(100), F.greatest(F.lit(1), F.col("quality")))
    scale = F.when(q < 50, F.expr("5000 div least(100, greatest(1, quality))")).otherwise(200 - 2 * q)
    steps = lambda t: F.transform(F.array(*[F.lit(int(v)) for v in t]), lambda v: F.least(F.lit(255), F.greatest(F.lit(1), F.floor((v * scale + 50) / 100))).cast("int"))
    return qualities.withColumns({"luma": steps(jpeg.LUMA), "chroma": steps(jpeg.CHROMA)})


def coefficients(rows: DataFrame, quality: int, chroma: bool = False) -> DataFrame:
    """(image_id, block, coefs) of planes given as rows(image_id, y, row array<int>): quantised DCT coefficients in zigzag order.

    Blocks are numbered in scan order. Eight rows meet in one task, whatever the image's size; rows
    and columns beyond the edge repeat the last ones.
    """
    quant = jpeg.scaled(jpeg.CHROMA if chroma else jpeg.LUMA, quality)
    strips = rows.groupBy("image_id", F.floor(F.col("y") / 8).alias("strip")).agg(F.array_sort(F.collect_list(F.struct("y", "row"))).alias("rows"))

    def run(image_id, strip, listed) -> Iterator[tuple]:
        v = np.array([r["row"] for r in listed], np.int64)
        v = np.pad(v, ((0, 8 - len(v)), (0, -v.shape[1] % 8)), "edge")
        f = jpeg.BASIS @ (jpeg.blocks(v).reshape(-1, 8, 8) - 128.0) @ jpeg.BASIS.T
        # to nine decimals, so that ties do not hang on the last bits of a sum
        q = np.rint(np.round(f.reshape(-1, 64), 9) / quant).astype(np.int32)[:, jpeg.ZIGZAG]
        for i, c in enumerate(q):
            yield image_id, int(strip) * len(q) + i, c

    return mapped(strips, run, "image_id string, block long, coefs array<int>")


def dc_differences(coefs: DataFrame) -> DataFrame:
    """(image_id, block, diff): DC less that of the block before it in the scan, by an equi-join on the block's number."""
    dc = coefs.select("image_id", "block", F.col("coefs")[0].alias("dc"))
    before = dc.select("image_id", (F.col("block") + 1).alias("block"), F.col("dc").alias("last"))
    return dc.join(before, ["image_id", "block"], "left").select("image_id", "block", (F.col("dc") - F.coalesce("last", F.lit(0))).alias("diff"))


def category(v: Column) -> Column:
    """Bit length of the absolute value."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v))))


def symbols(coefs: Column) -> Column:
    """Run and size symbols of one block's coefficients, runs of sixteen zeros and the end of block among them."""
    places = F.filter(F.sequence(F.lit(1), F.lit(63)), lambda k: F.element_at(coefs, k + 1) != 0)
    one = lambda k, before: F.concat(F.array_repeat(F.lit(0xF0), F.floor((k - before - 1) / 16).cast("int")), F.array((F.pmod(k - before - 1, F.lit(16)) * 16 + category(F.element_at(coefs, k + 1))).cast("int")))
    listed = F.transform(places, lambda k, i: one(k, F.when(i == 0, 0).otherwise(F.get(places, i - 1))))
    last = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(0))
    return F.concat(F.flatten(listed), F.when(last < 63, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))


def symbol_counts(coefs: DataFrame) -> DataFrame:
    """(symbol, n) of the AC coefficients of all blocks."""
    return coefs.select(F.explode(symbols(F.col("coefs"))).alias("symbol")).groupBy("symbol").agg(F.count("*").alias("n"))


def _line() -> Window:
    return Window.partitionBy("image_id", "y").orderBy("x")


def horizontal(pixels: DataFrame, value: str, bits: int) -> DataFrame:
    """Adds delta: each sample less the one before it in its row, modulo 2^bits."""
    return pixels.withColumn("delta", F.pmod(F.col(value) - F.coalesce(F.lag(value).over(_line()), F.lit(0)), F.lit(1 << bits)))


def undo_horizontal(pixels: DataFrame, delta: str, bits: int) -> DataFrame:
    """Adds restored: the running sum of each row, modulo 2^bits."""
    return pixels.withColumn("restored", F.pmod(F.sum(delta).over(_line().rowsBetween(Window.unboundedPreceding, 0)), F.lit(1 << bits)))
