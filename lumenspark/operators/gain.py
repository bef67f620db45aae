"""Gain maps in two passes: per-image statistics, then a map over pixels joined with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tone


def gain_plane(plane: DataFrame, sub: int, value: Column) -> DataFrame:
    """Mean gain, in stops, over sub x sub pixels: (image_id, gy, gx, g)."""
    if sub not in (1, 2, 4):
        raise ValueError("subsample must be 1, 2 or 4")
    return plane.groupBy("image_id", F.floor(F.col("y") / sub).alias("gy"), F.floor(F.col("x") / sub).alias("gx")).agg(F.avg(value).alias("g"))


def gain_range(gains: DataFrame) -> DataFrame:
    """(image_id, lo, hi): at most 0, and at least lo + 1e-4."""
    r = gains.groupBy("image_id").agg(F.least(F.lit(0.0), F.min("g")).alias("lo"), F.max("g").alias("hi"))
    return r.withColumn("hi", F.greatest(F.col("lo") + 1e-4, F.col("hi")))


def quantised(gains: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Gains with q (0..255) and the range they were quantised by; ranges are one row per image."""
    return gains.join(gain_range(gains), "image_id").withColumn("q", tone.quantise(F.col("g"), F.col("lo"), F.col("hi"), gamma))
