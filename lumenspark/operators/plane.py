"""Neighbourhood operators on planes (image_id, y, x, v); frames stay within a row or a column of one image."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _means(plane: DataFrame, columns: list[str], radius: int, along: str, across: str) -> DataFrame:
    """Moving means of 2 * radius + 1 samples with the edge samples repeated outside."""
    line = Window.partitionBy("image_id", across).orderBy(along)
    frame, whole = line.rowsBetween(-radius, radius), line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pos, size = F.row_number().over(line) - 1, F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), radius - pos), F.greatest(F.lit(0), pos + radius - (size - 1))
    made = {c: (F.sum(c).over(frame) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / (2 * radius + 1) for c in columns}
    return plane.withColumns(made)


def box_blur(plane: DataFrame, radius: int, columns: list[str] | None = None) -> DataFrame:
    """Separable moving mean of the columns (v by default): rows, then columns."""
    if radius < 1:
        raise ValueError("radius must be at least 1")
    columns = columns or ["v"]
    return _means(_means(plane, columns, radius, "x", "y"), columns, radius, "y", "x")


def guided_filter(plane: DataFrame, radius: int, eps: float) -> DataFrame:
    """Edge-keeping smoothing of v by itself: four shuffles for any number of images."""
    m = box_blur(plane.withColumn("_m", F.col("v")).withColumn("_s", F.col("v") * F.col("v")), radius, ["_m", "_s"])
    var = F.greatest(F.lit(0.0), F.col("_s") - F.col("_m") * F.col("_m"))
    m = m.withColumn("_a", var / (var + eps)).withColumn("_b", F.col("_m") * (1 - F.col("_a")))
    m = box_blur(m, radius, ["_a", "_b"])
    return m.withColumn("v", F.col("_a") * F.col("v") + F.col("_b")).drop("_m", "_s", "_a", "_b")


def guide_radius(width: int, height: int) -> int:
    return max(2, max(width, height) // 16)


def bilinear(plane: DataFrame, guide: DataFrame, block: int, name: str = "base") -> DataFrame:
    """Adds to each pixel the guide(image_id, gy, gx, v) at its place, cells centred at (g + 0.5) * block, edges repeated.

    A guide has at most 1024 cells a side, so it is joined as rows of arrays: a pixel reads its two
    rows and picks its four cells from them. Catalyst broadcasts the rows where they are small.
    """
    rows = guide.groupBy("image_id", "gy").agg(F.array_sort(F.collect_list(F.struct("gx", "v"))).alias("_cells"))
    last = guide.groupBy("image_id").agg(F.max("gy").alias("_h"), F.max("gx").alias("_w"))
    fy, fx = (F.col("y") + 0.5) / block - 0.5, (F.col("x") + 0.5) / block - 0.5
    bound = lambda v, top: F.least(F.col(top), F.greatest(F.lit(0), v)).cast("long")
    p = plane.join(last, "image_id").withColumns({"_ya": bound(F.floor(fy), "_h"), "_yb": bound(F.floor(fy) + 1, "_h"), "_xa": bound(F.floor(fx), "_w"), "_xb": bound(F.floor(fx) + 1, "_w"), "_ty": fy - F.floor(fy), "_tx": fx - F.floor(fx)})
    for side in ("a", "b"):
        own = rows.select("image_id", F.col("gy").alias(f"_y{side}"), F.transform("_cells", lambda c: c["v"]).alias(f"_r{side}"))
        p = p.join(own, ["image_id", f"_y{side}"])
    cell = lambda r, x: F.element_at(r, (F.col(x) + 1).cast("int"))
    line = lambda r: cell(r, "_xa") * (1 - F.col("_tx")) + cell(r, "_xb") * F.col("_tx")
    made = line("_ra") * (1 - F.col("_ty")) + line("_rb") * F.col("_ty")
    return p.withColumn(name, made).select(*plane.columns, name)


def blob_like(mask: DataFrame) -> DataFrame:
    """Share of bright (0/1) interior pixels of which at least 7 of 8 neighbours are bright too."""
    near = lambda along, across: Window.partitionBy("image_id", across).orderBy(along).rowsBetween(-1, 1)
    m = mask.withColumn("_r", F.sum("bright").over(near("x", "y"))).withColumn("_s", F.sum("_r").over(near("y", "x")))
    size = mask.groupBy("image_id").agg(F.max("y").alias("_h"), F.max("x").alias("_w"))
    m = m.join(size, "image_id")
    inside = (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("_w")) & (F.col("y") < F.col("_h"))
    hit = inside & (F.col("bright") == 1) & (F.col("_s") - 1 >= 7)
    return m.groupBy("image_id").agg(F.sum("bright").cast("long").alias("bright"), F.sum(hit.cast("long")).alias("blob"))
