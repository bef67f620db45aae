"""Numbering rows within a key without a task per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Spans into which the order column is cut; a key's rows meet in tasks of one span each.
SPANS = 256


def numbered(df: DataFrame, keys: list[str], order: str, name: str, spans: int = SPANS, weight: str | None = None) -> DataFrame:
    """Adds how many rows (or how much weight) precede each row within its keys by an integer column; ties in any order, nulls first.

    Counts per key and span are summed forward (at most `spans` small rows a key); rows are ordered
    only within their span. A key whose rows bunch in one span still meets in one sorted task.
    """
    w = F.col(weight) if weight else F.lit(1)
    ends = df.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    width = F.greatest(F.lit(1), F.expr(f"(_hi - _lo) div {spans} + 1"))
    rows = df.join(F.broadcast(ends)).withColumn("_span", F.coalesce(F.floor((F.col(order) - F.col("_lo")) / width), F.lit(-1))).drop("_lo", "_hi")  # one row
    before = lambda line: line.rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_span").agg(F.sum(w).alias("_n"))
    earlier = F.coalesce(F.sum("_n").over(before(Window.partitionBy(*keys).orderBy("_span"))), F.lit(0))
    summed = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_span").alias("_s"), earlier.alias("_before"))
    own = F.coalesce(F.sum(w).over(before(Window.partitionBy(*keys, "_span").orderBy(order))), F.lit(0))
    same = F.col("_span") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = rows.withColumn("_own", own).join(summed, same)
    return out.withColumn(name, F.col("_before") + F.col("_own")).drop("_span", "_s", "_before", "_own", *[f"_k{i}" for i in range(len(keys))])
