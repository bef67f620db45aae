"""Embedding near-duplicates with randomised-rotation binary codes.

Equal vectors form a class first. A class stores its code, the signs of its randomly rotated unit
vector, and its correction factor <code, vector>. Two codes differ in a share of bits that estimates the
angle without bias; and the inner product of a code with another rotated vector, divided by the code's
factor, estimates the cosine without bias, with an error within
BOUND * sqrt((1 - f^2) / f^2 / (d - 1)) but for a chance of about exp(-BOUND^2 / 2).

Candidates come from hash tables on bits of further random rotations. The number of bits follows the
number of vectors, and the number of tables the chance MISS that a pair exactly at the threshold
shares no bucket (closer pairs are missed far less often). Only codes go to the buckets: a class
stays in a bucket if some other code there is within the angle's confidence bound. Vectors are
fetched for these alone. Then each pair is judged in the first table in which it meets: its
estimated cosine and bound decide whether it is recomputed in double precision, and only pairs at or
above the threshold link. A bucket of more than CHUNK classes is dealt to cells of chunk pairs, so no
task holds more than two chunks of it; cells give out degrees and spanning stars, never all pairs.

Edge cases: null and zero vectors, and vectors with null or non-finite components, link with nothing
and are their own component; vectors of different lengths never link; a row with a null id links with
nothing; ids that repeat, with equal or different vectors, each give a row by its own vector; very
large and very small components are scaled by a power of two; an empty table gives an empty table;
only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph
from .arrow import durable

MISS = 0.002
BOUND = 5.0
CHUNK = 2048
#: Cosines this near to the threshold are taken from the vectors themselves, not from a matrix product.
CLOSE = 1e-9


@lru_cache(maxsize=256)
def rotation(d: int, number: int) -> np.ndarray:
    """Random orthogonal d x d matrix, the same for each number wherever it is made; a worker makes it once."""
    rng = np.random.default_rng((d, number, 77))
    q, r = np.linalg.qr(rng.standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def parameters(n: int, threshold: float) -> tuple[int, int]:
    """Bits per table and number of tables for n vectors."""
    bits = min(62, max(6, math.ceil(math.log2(max(2, n))) - 3))  # 62: a bucket's number is a long
    p = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-p))


def unlike(d: int, threshold: float) -> float:
    """BOUND standard deviations over the mean number of unlike bits of a pair at the threshold, bits taken as independent (for d = 64 exceeded with a chance of 1.2e-5)."""
    p = math.acos(threshold) / math.pi
    return d * p + BOUND * math.sqrt(d * p * (1 - p))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _keyed(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, key, vec): key is null for a vector that links with nothing; its greatest component is scaled to 0.5..1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held = [], []
            for v in batch.column(1):
                x = None if v.as_py() is None else v.values
                ok = x is not None and len(x) and not x.null_count
                x = x.to_numpy(zero_copy_only=False).astype("<f8") if ok else None
                ok = ok and np.isfinite(x).all() and (x != 0).any()
                if ok:
                    x = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) + 0.0
                held.append(x.tobytes() if ok else None)
                keys.append(hashlib.blake2b(held[-1], digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], names=["id", "key", "vec"])

    return df.select(F.col(id_col).cast("long").alias("id"), vec_col).mapInArrow(run, "id long, key binary, vec binary")


def _by_length(vecs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = np.array([len(v) for v in vecs])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, np.frombuffer(b"".join([vecs[i] for i in at]), "<f8").reshape(len(at), -1)


def coded(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (rows of booleans) of rotated unit vectors, and their correction factors."""
    r = u @ rotation(u.shape[1], 0).T
    signs = r >= 0
    return signs, np.abs(r).sum(1) / math.sqrt(u.shape[1])


def buckets_of(u: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Bucket of each unit vector in each table; the length is mixed in, so that lengths do not meet."""
    d = u.shape[1]
    need = -(-bits * tables // d)
    signs = np.concatenate([u @ rotation(d, i + 1).T >= 0 for i in range(need)], 1)[:, : bits * tables]
    code = signs.reshape(len(u), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
    return (code * 1_000_003) ^ d


def _codes(classes: DataFrame) -> DataFrame:
    """classes with code and factor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(3).to_pylist()
            code, factor = [b""] * len(vecs), np.zeros(len(vecs))
            for at, x in _by_length(vecs) if vecs else ():
                signs, factor[at] = coded(_unit(x))
                for i, c in zip(at, np.packbits(signs, axis=1), strict=True):
                    code[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.binary()), pa.array(factor)], names=["cid", "rep", "n", "vec", "key", "code", "factor"])

    return classes.select("cid", "rep", "n", "vec", "key").mapInArrow(run, "cid long, rep long, n long, vec binary, key binary, code binary, factor double")


def _tables(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(t, bucket, cid, code): a row per class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vecs = batch.column(1).to_pylist()
            found = np.zeros((len(vecs), tables), np.int64)
            for at, x in _by_length(vecs):
                found[at] = buckets_of(_unit(x), bits, tables)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vecs), t, np.int32)), pa.array(found[:, t]), batch.column(0), batch.column(2)], names=["t", "bucket", "cid", "code"])

    return classes.select("cid", "vec", "code").mapInArrow(run, "t int, bucket long, cid long, code binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows that agree in the first columns, from rows in their order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        edges = graph.group_bounds(*columns)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield held


def near_codes(codes: np.ndarray, most: float) -> np.ndarray:
    """Which rows of packed codes have another row within so many bits."""
    wide = np.zeros((len(codes), -(-codes.shape[1] // 8) * 8), np.uint8)
    wide[:, : codes.shape[1]] = codes
    words = wide.view(np.uint64)
    near = np.zeros(len(codes), bool)
    for a in range(0, len(words), 256):
        differ = np.bitwise_count(words[a : a + 256, None, :] ^ words[None, :, :]).sum(2, dtype=np.int64)
        close = differ <= most
        close[np.arange(len(close)), np.arange(a, a + len(close))] = False
        near[a : a + 256] = close.any(1)
    return near


def _survivors(threshold: float) -> Callable:
    """Over rows sorted by table and bucket: (t, bucket, cid) of classes whose code comes near to another's; whole buckets of over CHUNK classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[pa.RecordBatch] = []
        size = 0
        for held in _groups(batches, 2):
            n = sum(h.num_rows for h in held)
            if n < 2:
                continue
            rows = pa.Table.from_batches(held).select(["t", "bucket", "cid", "code"])
            if n <= CHUNK:
                codes = rows.column("code").to_pylist()
                lengths = np.array([len(c) for c in codes])
                keep = np.zeros(n, bool)
                for k in np.unique(lengths):
                    at = np.flatnonzero(lengths == k)
                    packed = np.frombuffer(b"".join([codes[i] for i in at]), np.uint8).reshape(len(at), k)
                    keep[at] = near_codes(packed, unlike(8 * int(k), threshold))
                rows = rows.filter(pa.array(keep))
            if rows.num_rows:
                out += rows.select(["t", "bucket", "cid"]).to_batches()
                size += rows.num_rows
            if size > 10_000:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
                out, size = [], 0
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def linked_cells(x: np.ndarray, y: np.ndarray, threshold: float, signs: np.ndarray | None = None, factor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of x and y whose cosine is at least the threshold, and how many pairs were recomputed; y's codes and factors may be given."""
    d = x.shape[1]
    a, b = _unit(x), _unit(y)
    if signs is None:
        signs, factor = coded(b)
    code = np.where(signs, 1.0, -1.0) / math.sqrt(d)
    error = BOUND * np.sqrt(np.maximum(0, 1 - factor**2) / factor**2 / max(1, d - 1))
    maybe = (a @ rotation(d, 0).T @ code.T) / factor + error >= threshold
    tried = int(maybe.sum())
    if 4 * tried > maybe.size:  # most are near: one product for all
        cos = a @ b.T
        keep = maybe & (cos >= threshold)
        i, j = np.nonzero(maybe & (np.abs(cos - threshold) < CLOSE))
    else:
        keep = np.zeros(maybe.shape, bool)
        i, j = np.nonzero(maybe)
    for s in range(0, len(i), 1 << 15):
        p, q = i[s : s + (1 << 15)], j[s : s + (1 << 15)]
        u, v = x[p], y[q]
        keep[p, q] = (u * v).sum(1) / np.sqrt((u * u).sum(1) * (v * v).sum(1)) >= threshold
    i, j = np.nonzero(keep)
    return i, j, tried


def _scan(threshold: float, bits: int, tables: int) -> Callable:
    """Over rows sorted by table, bucket and cell: (cid, degree, null) and (cid, 0, to) for links of spanning stars."""

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        rows = pa.Table.from_batches(held)
        column = lambda c: rows.column(c).to_numpy()
        cid, n, chunk, factor = column("cid"), column("n"), column("chunk"), column("factor")
        t, ci, cj = (int(held[0].column(k)[0].as_py()) for k in (0, 2, 3))
        vecs, codes = rows.column("vec").to_pylist(), rows.column("code").to_pylist()
        degree, links = np.zeros(len(cid), np.int64), []
        for at, x in _by_length(vecs):
            signs = np.unpackbits(np.frombuffer(b"".join([codes[i] for i in at]), np.uint8).reshape(len(at), -1), axis=1)[:, : x.shape[1]].astype(bool)
            met = buckets_of(_unit(x), bits, tables)[:, :t]
            left, right = np.flatnonzero(chunk[at] == ci), np.flatnonzero(chunk[at] == cj)
            for s in range(0, len(left), 256):
                own = left[s : s + 256]
                i, j, _ = linked_cells(x[own], x[right], threshold, signs[right], factor[at[right]])
                i, j = own[i], right[j]
                ok = cid[at[i]] < cid[at[j]] if ci == cj else np.ones(len(i), bool)
                i, j = i[ok], j[ok]
                if t and len(i):
                    first = np.concatenate([~(met[i[p : p + 65_536]] == met[j[p : p + 65_536]]).any(1) for p in range(0, len(i), 65_536)])
                    i, j = i[first], j[first]
                if len(i):
                    i, j = at[i], at[j]
                    degree += np.bincount(i, n[j], len(cid)).astype(np.int64) + np.bincount(j, n[i], len(cid)).astype(np.int64)
                    links += graph.forest(zip(cid[i].tolist(), cid[j].tolist(), strict=True))
        links = graph.forest(links)
        at = np.flatnonzero(degree)
        if not len(at):
            return None
        a = np.concatenate([cid[at], np.array([p for p, _ in links], np.int64)])
        d = np.concatenate([degree[at], np.zeros(len(links), np.int64)])
        to = pa.array([None] * len(at) + [q for _, q in links], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(d), to], names=["cid", "degree", "to"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 4):
            if sum(h.num_rows for h in held) > 1 and (made := judge(held)) is not None:
                yield made

    return run


def link(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; ids are 64-bit integers."""
    rows = durable(_keyed(df, id_col, vec_col))
    classes = rows.where("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    # classes are known by numbers that the table fixes, as ids may repeat with different vectors
    classes = durable(_codes(classes.withColumn("cid", F.monotonically_increasing_id())))
    bits, tables = parameters(classes.count(), threshold)
    dealt = _tables(classes, bits, tables).repartition("t", "bucket").sortWithinPartitions("t", "bucket")
    near = durable(dealt.mapInArrow(_survivors(threshold), "t int, bucket long, cid long"))
    hot = near.groupBy("t", "bucket").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    found = near.join(hot, ["t", "bucket"]).withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
    found = found.withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    # a class meets its own chunk and, in a cell for each, all others
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    found = found.join(classes.select("cid", "n", "vec", "code", "factor"), "cid")
    found = found.select("t", "bucket", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", "cid", "n", "vec", "code", "factor")
    found = found.repartition("t", "bucket", "ci", "cj").sortWithinPartitions("t", "bucket", "ci", "cj")
    judged = durable(found.mapInArrow(_scan(threshold, bits, tables), "cid long, degree long, to long"))
    degrees = judged.groupBy("cid").agg(F.sum("degree").alias("degree"))
    parts = graph.components(judged.where("to IS NOT NULL"), "cid", "to")
    named = classes.select("key", "n", "rep", "cid").join(degrees, "cid", "left").join(parts, F.col("cid") == F.col("node"), "left").withColumn("part", F.coalesce("component", "cid"))
    least = named.groupBy("part").agg(F.min("rep").alias("least"))  # components are named by their smallest id
    named = named.join(least, "part").select("key", (F.col("n") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.col("least").alias("component_id"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
