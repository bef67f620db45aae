"""Measurements over planes and bags of samples; all are partial aggregations merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tone


def block_means(plane: DataFrame, block: int, value: Column, keys=("image_id",)) -> DataFrame:
    """Mean of a value over square blocks of (y, x)."""
    b = F.lit(block)
    return plane.groupBy(*keys, F.floor(F.col("y") / b).alias("gy"), F.floor(F.col("x") / b).alias("gx")).agg(F.avg(value).alias("v"))


def block_size(width: int, height: int, exact: bool = False) -> int:
    edge = max(width, height)
    return 1 if exact else max(-(-edge // 2048), 2 if edge > 512 else 1)


def guide_block(width: int, height: int) -> int:
    return max(1, -(-max(width, height) // 1024))


def block_size_of(width: Column, height: Column, exact: bool = False) -> Column:
    """`block_size` of each image."""
    edge = F.greatest(width, height)
    return F.lit(1) if exact else F.greatest(F.ceil(edge / 2048), F.when(edge > 512, 2).otherwise(1)).cast("int")


def guide_block_of(width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.greatest(width, height) / 1024)).cast("int")


def guide_radius_of(guide_width: Column, guide_height: Column) -> Column:
    return F.greatest(F.lit(2), F.floor(F.greatest(guide_width, guide_height) / 16)).cast("int")


def channel_ceilings(pixels: DataFrame, block: int, channels=("r", "g", "b"), keys=("image_id",)) -> DataFrame:
    """Per image and channel the highest block mean of what is not negative, as ceil_<channel>."""
    b = F.lit(block)
    cells = pixels.groupBy(*keys, F.floor(F.col("y") / b).alias("gy"), F.floor(F.col("x") / b).alias("gx")).agg(*[F.avg(F.greatest(F.lit(0.0), F.col(c))).alias(c) for c in channels])
    return cells.groupBy(*keys).agg(*[F.max(c).alias(f"ceil_{c}") for c in channels])


def held(pixels: DataFrame, ceilings: DataFrame, channels=("r", "g", "b"), keys=("image_id",)) -> DataFrame:
    """Pixels with each channel between 0 and its image's ceiling; ceilings are one row per image."""
    out = pixels.join(ceilings, list(keys))
    return out.withColumns({c: F.least(F.col(f"ceil_{c}"), F.greatest(F.lit(0.0), F.col(c))) for c in channels}).select(*pixels.columns)


def flat_white(pixels: DataFrame, keys=("image_id",)) -> DataFrame:
    """Per image how many 8-bit pixels are white in all channels, and the mean level (0..1) of its base."""
    white = (F.col("r") == 255) & (F.col("g") == 255) & (F.col("b") == 255)
    return pixels.groupBy(*keys).agg(F.count_if(white).alias("flat_white"), (F.avg((F.col("r") + F.col("g") + F.col("b")) / 3.0) / 255).alias("mean_level"))


def study(rows: DataFrame, x: str, y: str, constant: float) -> DataFrame:
    """Correlation of two columns, and the mean absolute error of a constant as an estimate of the second."""
    return rows.agg(F.corr(x, y).alias("r"), F.avg(F.abs(F.col(y) - constant)).alias("mae"), F.count("*").alias("n"))


def peaks(plane: DataFrame, block: int, keys=("image_id",)) -> DataFrame:
    """True and softened peak of luminance l, at least 0, with their headrooms in stops."""
    soft = block_means(plane, block, F.col("l"), keys).groupBy(*keys).agg(F.greatest(F.max("v"), F.lit(0.0)).alias("softened"))
    true = plane.groupBy(*keys).agg(F.greatest(F.max("l"), F.lit(0.0)).alias("peak"))
    out = true.join(soft, list(keys))
    return out.withColumn("headroom", tone.headroom(F.col("softened"))).withColumn("true_headroom", tone.headroom(F.col("peak")))


def log_histogram(samples: DataFrame, l: str = "l", keys=()) -> DataFrame:
    """Sparse histogram (keys, bin, n) of positive luminances."""
    return samples.where((F.col(l) > 0) & ~F.isnan(l)).groupBy(*keys, tone.histogram_bin(F.col(l)).alias("bin")).agg(F.count("*").alias("n"))


def percentile(hist: DataFrame, fractions: dict[str, float], keys=()) -> DataFrame:
    """Values at fractions of a histogram: centre of the first bin whose running count reaches floor(f * total).

    A wanted count of 0 is reached by bin 0, filled or not; without samples all are 0. At most 384
    rows per key meet in the window.
    """
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*keys)
    run = hist.select(*keys, "bin", F.sum("n").over(w).alias("cum"), F.sum("n").over(every).alias("total"))
    at = lambda f: F.when(F.floor(F.first("total") * f) == 0, 0).otherwise(F.min(F.when(F.col("cum") >= F.floor(F.col("total") * f), F.col("bin"))))
    return run.groupBy(*keys).agg(*[F.pow(F.lit(2.0), at(f) / 16.0 - 14).alias(n) for n, f in fractions.items()], F.max("total").alias("total"))


def fraction_above(hist: DataFrame, l: float, keys=()) -> DataFrame:
    at = tone.histogram_bin(F.lit(float(l)))
    return hist.groupBy(*keys).agg((F.sum(F.when(F.col("bin") > at, F.col("n")).otherwise(0)) / F.sum("n")).alias("above"))


def auto_shape(hist: DataFrame, curve: str = "reinhard", max_boost: float = 2.3, keys=()) -> DataFrame:
    """Lift and contrast that give the SDR rendering the scene's mid tones and part of its spread."""
    top = max(1.0001, 2.0**max_boost)
    t = lambda v: tone.curve(curve, v, top)
    p = percentile(hist, {"q25": 0.25, "median": 0.5, "q75": 0.75}, keys)
    for n in ("q25", "median", "q75"):
        p = p.withColumn(n, F.least(F.lit(1.0), F.col(n)))
    q1, q3, a = F.col("q25"), F.col("q75"), F.col("median")
    p = p.withColumn("got", F.when((q1 > 0) & (q1 < q3) & (t(q1) > 0) & (t(q1) < t(q3)), F.log2(t(q3) / t(q1))))
    wanted = 1 + 0.4 * (F.log2(q3 / q1) / F.col("got") - 1)
    p = p.withColumn("contrast", F.when(F.col("got") > 1e-4, tone.clamp(wanted, 1, 1.5)).otherwise(1.0))
    c = F.col("contrast")
    lift = F.log2(F.pow(a / F.pow(F.lit(tone.PIVOT), 1 - c), 1 / c) / t(a))
    return p.withColumn("lift", F.when(t(a) > 0, tone.clamp(lift, 0, 1.5)).otherwise(0.0)).select(*keys, "median", "lift", "contrast")


def indexed_percentiles(samples: DataFrame, value: str, fractions: dict[str, float], ranges: int = 64) -> DataFrame:
    """Values at index min(n - 1, floor(n * f)) of the sorted samples, without sorting them into one task.

    Equal values are counted first. Approximate quantiles cut them into ranges, a column of each row
    (any cuts give the same result); their running count is made per range and shifted by the
    totals of the ranges below.
    """
    counts = samples.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = sorted(set(counts.approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.01)))
    part = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col("v"))) if cuts else F.lit(0)
    ranged = counts.withColumn("part", part)
    totals = ranged.groupBy("part").agg(F.sum("n").alias("t"))
    below = totals.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("below"), F.sum("t").over(Window.partitionBy()).alias("total"))
    run = ranged.join(F.broadcast(below), "part").withColumn("cum", F.col("below") + F.sum("n").over(Window.partitionBy("part").orderBy("v")))  # one row per range
    at = lambda f: F.min(F.when(F.col("cum") > F.least(F.col("total") - 1, F.floor(F.col("total") * f)), F.col("v")))
    return run.agg(*[at(f).alias(n) for n, f in fractions.items()])


def errors(rows: DataFrame, got: str, want: str, shadow: float = 0.02) -> DataFrame:
    """RMSE over all rows; relative error and drift in stops outside deep shadow."""
    g, w = F.col(got), F.col(want)
    lit_ = w >= shadow
    rel, drift = F.when(lit_, F.abs(g - w) / w), F.when(lit_ & (g > 0), tone.ev(g, w))
    return rows.agg(F.sqrt(F.avg((g - w) * (g - w))).alias("rmse"), F.avg(rel).alias("mean_rel"), F.max(rel).alias("max_rel"), F.avg(drift).alias("mean_ev"), F.max(drift).alias("max_ev"))
