"""Join-shaped operators: nearest colour space, best matching thumbnail, ordered segment alignment, unique names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..sources.files import mapped
from .order import numbered

#: Vectors of the sent set that are compared in one pass (4096 of 4096 numbers take 128 MB).
BLOCK = 4096


def nearest_primaries(profiles: DataFrame, colorants: str = "colorants", limit: float = 0.05) -> DataFrame:
    """Adds the colour space whose nine D50 colorants are nearest (sum of differences under the limit; first listed on ties)."""

    def error(name):
        m = color.adaptation(color.D65, color.D50) @ color.to_xyz(name)
        flat = m.T.reshape(-1).tolist()
        return sum((F.abs(F.col(colorants)[i] - F.lit(v)) for i, v in enumerate(flat)), F.lit(0.0))

    options = F.array(*[F.struct(error(n).alias("err"), F.lit(k).alias("pos"), F.lit(n).alias("name")) for k, n in enumerate(color.PRIMARIES)])
    best = F.array_min(options)
    return profiles.withColumn("err", best["err"]).withColumn("nearest", F.when(best["err"] < limit, best["name"]))


def _centred(v: np.ndarray) -> np.ndarray:
    return v - v.mean(1, keepdims=True)


def best_match(received: DataFrame, sent: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each received(id, vec), the sent vector with the greatest correlation, the first id on ties.

    The sent side is the batch that was exported, a stated query set. It is read in blocks of bounded
    size, and each task keeps one best row per received id and block. Vectors of different lengths
    are not compared.
    """
    kind = received.schema["id"].dataType.simpleString()

    def against(ids: list, vecs: np.ndarray):
        b = _centred(vecs)
        norms = np.sqrt((b * b).sum(1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.column(1).to_pylist()
                at = np.array([i for i, v in enumerate(rows) if v is not None and len(v) == b.shape[1]], np.int64)
                if not len(at):
                    continue
                a = _centred(np.array([rows[i] for i in at], float))
                r = (a @ b.T) / (np.sqrt((a * a).sum(1))[:, None] * norms + 1e-9)
                best = r.argmax(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([ids[k] for k in best], sent_kind), pa.array(r[np.arange(len(at)), best])], names=["received", "sent", "r"])

        return received.select("id", "vec").mapInArrow(run, f"received {kind}, sent {sent.schema['id'].dataType.simpleString()}, r double")

    sent_kind = pa.int64()
    found, held = None, {}
    for row in sent.where("vec IS NOT NULL").select("id", "vec").orderBy("id").toLocalIterator():
        part = held.setdefault(len(row["vec"]), ([], []))
        part[0].append(row["id"])
        part[1].append(row["vec"])
        if len(part[0]) == block:
            more = against(part[0], np.array(part[1], float))
            found = more if found is None else found.unionAll(more)
            del held[len(row["vec"])]
    for ids, vecs in held.values():
        more = against(ids, np.array(vecs, float))
        found = more if found is None else found.unionAll(more)
    if found is None:
        return received.sparkSession.createDataFrame([], f"received {kind}, sent long, r double")
    best = F.max_by(F.struct("sent", "r"), F.struct(F.col("r"), -F.col("sent")))
    return found.groupBy("received").agg(best.alias("m")).select("received", "m.sent", "m.r")


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """Full outer alignment of segments(name, seq, size, digest) of two files: their n-th segments of a name side by side.

    Rows are (name, n, a, b): each entry as size/digest, or null where a file has no n-th one.
    """
    entry = F.concat(F.col("size").cast("string"), F.lit("/"), F.col("digest"))
    side = lambda df, p: numbered(df.select("name", "seq", entry.alias(p)), ["name"], "seq", "n").select("name", "n", p, F.col("seq").alias(f"{p}_seq"))
    return side(a, "a").join(side(b, "b"), ["name", "n"], "full_outer")


def differences(aligned: DataFrame) -> DataFrame:
    """Per name of aligned rows: how many entries each file has, whether they differ, and its place: names of the first file by first appearance, then those of the second alone."""
    out = aligned.groupBy("name").agg(F.count("a").alias("a"), F.count("b").alias("b"), F.bool_or(~F.col("a").eqNullSafe(F.col("b"))).alias("differs"), F.min("a_seq").alias("_a"), F.min("b_seq").alias("_b"))
    return out.select("name", "a", "b", "differs", F.when(F.col("_a").isNull(), 1).otherwise(0).alias("side"), F.coalesce("_a", "_b").alias("place"))


def listed(segs: DataFrame, key: str = "path") -> DataFrame:
    """Per file and name the entries as one text, '-- absent --' for a file that lacks a name; a file has a few dozen segments."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "size", "digest"))), lambda x: F.concat(x["size"].cast("string"), F.lit("/"), x["digest"]))
    own = segs.groupBy(key, "name").agg(F.array_join(parts, ", ").alias("entries"))
    every = own.select(key).distinct().join(own.select("name").distinct())
    return every.join(own, [key, "name"], "left").withColumn("entries", F.coalesce("entries", F.lit("-- absent --")))


_CHILD = r"^(.*)-([1-9][0-9]{0,8})$"


def _claimed(stems: list[tuple[str, list[tuple]]]) -> Iterator[tuple[str, list[int], int]]:
    """(stem, numbers that others claimed before the stem reached them, its first number) of one family, shorter stems first.

    A claim is (time, number, rows of the stem before it); without a time the name has always been taken.
    """
    lost: set[str] = set()
    for stem, claims in stems:
        begin, blocked = int(stem in lost), []
        for at, number, before in claims:
            reached = begin + (0 if at is None else before)
            for k in sorted(blocked):
                reached += begin <= k <= reached
            if begin <= number < reached and number not in blocked:
                lost.add(f"{stem}-{number}")
            else:
                blocked.append(number)
        yield stem, sorted(k for k in blocked if k >= begin), begin


def unique_names(rows: DataFrame, stem: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """Adds a name that no other row has: names are claimed in order, the stem first, then stem-1, stem-2, ... as they are free.

    taken(name) are names that exist already. Each stem's rows are numbered without a task per stem.
    Only a name that is a stem itself, or taken, can be in the way of another stem; these claims are
    played through per family of stems, from the number of rows that precede each, and rows behind
    skip the numbers found claimed. A family's claims (not its rows) meet in one task. Order must be
    an integer and differ from row to row; a null stem gets no name.
    """
    own = rows.where(F.col(stem).isNotNull())
    n = numbered(own, [stem], order, "_n")
    firsts = own.groupBy(F.col(stem).alias("_name")).agg(F.min(order).cast("long").alias("_at"))
    always = None
    if taken is not None:
        always = taken.select(F.col(taken.columns[0]).alias("_name"), F.lit(None).cast("long").alias("_at")).dropDuplicates(["_name"])
        firsts = firsts.join(always.select("_name"), "_name", "left_anti").unionAll(always)
    number = F.regexp_extract("_name", _CHILD, 2)
    claims = firsts.where(F.regexp_like("_name", F.lit(_CHILD))).select(F.regexp_extract("_name", _CHILD, 1).alias("_stem"), number.cast("long").alias("_number"), "_at")
    if always is not None:
        claims = claims.unionAll(always.select(F.col("_name").alias("_stem"), F.lit(0).cast("long").alias("_number"), "_at"))
    counted = own.select(F.col(stem).alias("_stem"), F.lit(None).cast("long").alias("_number"), F.col(order).cast("long").alias("_at"), F.lit(1).alias("_w"))
    counted = counted.join(claims.select("_stem").distinct(), "_stem", "left_semi").unionAll(claims.withColumn("_w", F.lit(0)))
    placed = numbered(counted, ["_stem"], "_at", "_rows", weight="_w").where("_w = 0")
    per_stem = placed.groupBy("_stem").agg(F.array_sort(F.collect_list(F.struct("_at", "_number", "_rows"))).alias("claims"))
    root = F.regexp_replace("_stem", r"(-[1-9][0-9]{0,8})+$", "")
    families = per_stem.groupBy(root.alias("_root")).agg(F.array_sort(F.collect_list(F.struct(F.length("_stem").alias("size"), F.col("_stem").alias("stem"), "claims"))).alias("stems"))

    def run(_, stems) -> Iterator[tuple]:
        yield from _claimed([(s["stem"], [(c["_at"], c["_number"], c["_rows"]) for c in s["claims"]]) for s in stems])

    played = mapped(families, run, "_stem string, _blocked array<long>, _begin int")
    parents = played.select(F.col("_stem").alias("_up"), F.col("_blocked").alias("_around"))
    out = n.join(played, n[stem] == played["_stem"], "left")
    out = out.join(parents, F.nullif(F.regexp_extract(F.col(stem), _CHILD, 1), F.lit("")) == F.col("_up"), "left")
    k = F.nullif(F.regexp_extract(F.col(stem), _CHILD, 2), F.lit("")).cast("long")
    # a stem whose name its parent reached first begins at 1
    begin = F.coalesce(F.greatest("_begin", F.when(F.col("_around").isNotNull() & ~F.array_contains("_around", k), 1).otherwise(0)), F.lit(0))
    reached = F.aggregate(F.coalesce("_blocked", F.array().cast("array<bigint>")), F.col("_n") + begin, lambda at, b: F.when(b <= at, at + 1).otherwise(at))
    named = out.withColumn("name", F.when(reached == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-"), reached.cast("string"))))
    return named.select(*rows.columns, "name").unionByName(rows.where(F.col(stem).isNull()).withColumn("name", F.lit(None).cast("string")))
