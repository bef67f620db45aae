"""Connected components by alternating large-star and small-star steps, cut by written tables.

No neighbour list is ever gathered: each step takes a minimum per vertex (combined before the
shuffle) and joins it back to the edges, where AQE can split a hot vertex.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import discard, durable, thrifty


def forest(pairs) -> list[tuple]:
    """Spanning stars (member, smallest member) of the pairs, without self links."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def _local_forest(batches):
    for batch in batches:
        if batch.num_rows:
            found = forest(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], batch.schema.types[0]), pa.array([r for _, r in found], batch.schema.types[1])],
                names=["u", "v"],
            )


#: Links that one task may join at most (about 100 MB); beyond, stars are made in rounds. Both give the same result.
ONE_TASK = 300_000


def _whole_forest(batches):
    """Component of every node of all batches together."""
    pairs: list[tuple] = []
    kinds = None
    for batch in batches:
        kinds = batch.schema.types
        pairs = forest([*pairs, *zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
    if pairs:
        pairs += [(r, r) for r in {r for _, r in pairs}]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kinds[0]), pa.array([r for _, r in pairs], kinds[1])], names=["node", "component"])


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node that some edge names.

    Nulls and self links are ignored, repeated links count once; an empty table gives an empty one.
    """
    kind = edges.schema[a].dataType.simpleString()
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = durable(edges.mapInArrow(thrifty(_local_forest), f"u {kind}, v {kind}").distinct())
    digest = F.struct(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003))
    seen = edges.agg(digest).first()[0]
    if seen[0] <= ONE_TASK:
        out = durable(edges.coalesce(1).mapInArrow(thrifty(_whole_forest), f"node {kind}, component {kind}"))
        discard(edges)
        return out
    for _ in range(rounds):
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: edges now point from the larger end to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).unionAll(joined.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, durable(small)
        discard(before)
        now = edges.agg(digest).first()[0]
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    # settled: each node points at its component
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()


def group_bounds(*keys: np.ndarray) -> np.ndarray:
    """Bounds of runs of equal keys in sorted rows."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)
