"""N-gram Jaccard join by universe partition and pigeonhole.

Two texts link when their shingle sets' Jaccard similarity reaches 80 %. Texts with equal sets form
a class first, so all further work is on classes.

*Size bands.* Sets are put into bands whose sizes differ by at most a quarter. A set looks for
partners that are no larger than itself, in its own band and the one or two below.

*Segments.* In each band, tokens are hashed into segments. For a set r and a band whose partners have
up to n tokens, a link implies that the symmetric difference is at most H = (|r| + n) // 9. Each segment i is given v_i in
{-1: left out, 0: equal, 1: equal but for one token}; where the v_i + 1 add up to H + 1, some segment
of any partner differs by at most v_i tokens. All segments of a set are indexed; in bands of small
sets, so are the segments less each one token (one-deletion neighbourhoods), which find segments
that differ by one token.

*Allocation.* The v_i that cost least are taken. The cost is the number of signatures plus the hits
expected, from the number of sets in the band and the tokens in the segment. Large bands have more
segments than needed; there all are looked up, and once it is known which signatures many sets share,
a set leaves those out, as they cost most, where H + 1 others remain. Such a set is *free* in that
band: all its partners there share one of the rarer signatures.

*Verification.* Every set also has a histogram of its tokens over power-of-two hash groups; the sum
of the smaller counts of two histograms bounds their intersection from above. Signatures are dealt
to buckets as packed arrays. A signature's sets form pairs; where more than FEW share one, only
pairs with the smallest (the hub) are formed. First each set is compared with its likeliest partner,
which brings copies together. Then the pairs whose ends are still apart are compared, and at last each
set that is not free with those sets of its hubs that are no larger, still apart and allowed by their
histograms: the sets that have such a pair are named, never the pairs, and of their links no more are
given out than join what is apart. So no link that could join two components is left out, and no group
of sets, copies or not, emits all its pairs. A hub with many sets is dealt to cells of chunk pairs. Sets that have several hubs in common
form a pair in the smallest of these only.

*Counts.* That gives the components. Links lie within these, so each component's sets are then dealt to
cells of chunk pairs, where all pairs of sizes that can link are compared exactly; cells give out each
set's number of links, never the links.

Edge cases: null, empty and blank texts have the empty set and link with nothing; ids that repeat,
with the same or with different texts, each give a row by its own text; a row whose id is null takes
part only through an equal text that has an id, and is never the smallest; an empty table gives an
empty table; only the named columns are read. Hashes are of 64 bits: two given sets of a thousand
shingles are misjudged with a chance below 1e-13.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph, shingles
from .arrow import discard, durable, release, slices, thrifty, thrifty_group

#: Links need 100 * |A and B| >= PER_CENT * |A or B|. The band bounds below hold for 80.
PER_CENT = 80
SMALL = 32
FEW = 5
CHUNK = 1024
#: Tokens of a chunk of sets, about, when links are counted.
CELL_TOKENS = 4_000_000
INDEX, PROBE, DELETED = 1, 2, 4
#: Roles also hold how many bands below its own a set looks, from this bit on.
BELOW = 3
#: Bits of `bound`: for 0 to 2 bands below its own, whether a set is not free there.
REACH = 3
_U = np.uint64


def _bands(limit: int = 1 << 40) -> list[tuple[int, int]]:
    out, low = [], 1
    while low < limit:
        high = low * 5 // 4
        out.append((low, high))
        low = high + 1
    return out


BANDS = _bands()
_HIGHS = np.array([h for _, h in BANDS])


def band_of(n: int) -> int:
    return int(np.searchsorted(_HIGHS, n))


def budget(n: int, high: int) -> int:
    """Most tokens by which a set of n may differ from a linked set of at most min(n, high)."""
    return (n + min(n, high)) // 9


def segments(band: int) -> int:
    """Number of segments of a band: enough for its largest budget, with some to leave out."""
    high = BANDS[band][1]
    most = budget(high * 5 // 4, high)
    if not most:
        return 0
    return (most + 1) // 2 + 1 if high <= SMALL else (most + 1) * 5 // 4 + 2


def _cost(k: int, v: int, others: float) -> float:
    """Signatures to look up plus expected hits for a segment of k tokens."""
    if v < 0:
        return 0.0
    hits = lambda j: others * (0.2 if j == 0 else 0.02 * 0.05 ** (j - 1))
    if v == 0:
        return 1 + hits(k)
    return 1 + k + hits(k) + (k * hits(k - 1) if k else 0) + hits(k + 1)


def allocate(counts: list[int], need: int, others: float) -> list[int]:
    """The cheapest v per segment whose v + 1 add up to need (or to all there is)."""
    need = min(need, 2 * len(counts))
    best: list[tuple[float, list[int]] | None] = [None] * (need + 1)
    best[0] = (0.0, [])
    for k in counts:
        nxt: list[tuple[float, list[int]] | None] = [None] * (need + 1)
        for got, held in enumerate(best):
            if held is not None:
                for v in (-1, 0, 1):
                    to, cost = min(need, got + v + 1), held[0] + _cost(k, v, others)
                    if nxt[to] is None or cost < nxt[to][0]:
                        nxt[to] = (cost, [*held[1], v])
        best = nxt
    return best[need][1]


def signatures(u: np.ndarray, others: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signatures of a set and their roles (INDEX, PROBE, DELETED)."""
    n = len(u)
    own, sigs, roles = band_of(n), [], []
    token = ((u * _U(0xA24BAED4963EE407)) >> _U(24)).astype(np.float64)  # 40 bits: sums are exact
    for band in range(band_of(-(-n * 4 // 5)), own + 1):
        m = segments(band)
        if not m or band != own and not others.get(band):
            continue
        low, high = BANDS[band]
        seg = (((u >> _U(32)) * _U(m)) >> _U(32)).astype(np.int64)
        total = np.bincount(seg, token, m)
        if high > SMALL:
            sums, segs, role = total, np.arange(m), np.full(m, INDEX | PROBE if band == own else PROBE, np.uint8)
        else:
            need = budget(n, high) + 1
            v = np.array(allocate(np.bincount(seg, minlength=m).tolist(), need, others.get(band, 0)))
            base = INDEX if band == own else 0
            role = np.where(v >= 0, base | PROBE, base)
            gone = np.where(v[seg] > 0, base | PROBE, base) | DELETED
            sums = np.concatenate([total, total[seg] - token])
            segs = np.concatenate([np.arange(m), seg])
            role = np.concatenate([role, gone]).astype(np.uint8)
            keep = (role & (INDEX | PROBE)) > 0
            sums, segs, role = sums[keep], segs[keep], role[keep]
        salt = (segs + 1).astype(_U) * _U(0x9FB21C651E98DF25) + _U(band + 1) * _U(0xC13FA9A902A6328F & 0xFFFFFFFFFFFF)
        sigs.append(shingles.mix(sums.astype(_U) ^ salt))
        roles.append(role | np.uint8((own - band) << BELOW))
    if not sigs:
        return np.zeros(0, _U), np.zeros(0, np.uint8)
    return np.concatenate(sigs), np.concatenate(roles)


def bound(n: int, frequent: list[int]) -> int:
    """Bits of the bands (own, one and two below) where a set of n tokens is not free, from its numbers of frequent signatures."""
    own, bits = band_of(n), 0
    for o, f in enumerate(frequent[: own + 1]):
        high = BANDS[own - o][1]
        if f and (high <= SMALL or segments(own - o) - f - 1 <= budget(n, high)):  # one less, if two fall together
            bits |= 1 << o
    return bits


def histogram(u: np.ndarray) -> bytes:
    """Tokens per hash group; larger sets have more groups, which can be summed to fewer."""
    bits = 8 if len(u) <= 2000 else 10 if len(u) <= 10_000 else 12
    return np.minimum(np.bincount((u >> _U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_sums(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Sums of the smaller counts of one histogram, or a row for each, and each of others (rows)."""
    pairs = np.minimum(others, own).view(_U)
    lanes = (pairs & _U(0x00FF00FF00FF00FF)) + ((pairs >> _U(8)) & _U(0x00FF00FF00FF00FF))  # up to 510 in 16 bits
    out = np.zeros(len(others), np.int64)
    for i in range(0, lanes.shape[1], 128):
        four = lanes[:, i : i + 128].sum(1)
        out += sum(((four >> _U(k)) & _U(0xFFFF)).astype(np.int64) for k in (0, 16, 32, 48))
    return out


def _folded(h: np.ndarray, groups: int) -> np.ndarray:
    """Histograms with fewer groups; counts stop at 255."""
    return h if h.shape[-1] == groups else np.minimum(h.reshape(*h.shape[:-1], groups, -1).sum(-1, dtype=np.int64), 255).astype(np.uint8)


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where sets of n and m tokens with histograms x and y (rows; numbers of groups may differ) can be similar."""
    k = min(x.shape[-1], y.shape[-1])
    x, y = _folded(x, k), _folded(y, k)
    both = least_sums(x, y)
    full = (x.max(-1) == 255) | (y.max(-1) == 255)  # such counts may be larger
    return full | (100 * both >= PER_CENT * (n + m - both))


def _plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that their sets' histograms do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            n, m = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            keep = np.zeros(len(x), bool)
            kinds = np.array([(len(h), len(g)) for h, g in zip(x, y, strict=True)]).reshape(-1, 2)
            for one, two in np.unique(kinds, axis=0):
                at = np.flatnonzero((kinds == (one, two)).all(1))
                for some in np.array_split(at, -(-len(at) // CHUNK)):
                    rows = lambda h, k: np.frombuffer(b"".join(h[i] for i in some), np.uint8).reshape(-1, k)  # noqa: B023, E731
                    keep[some] = may_link(rows(x, one), rows(y, two), n[some], m[some])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda x: classes.select(F.col("cid").alias(x), F.col("histogram").alias(f"h{x}"), F.col("n").alias(f"n{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb", "na", "nb")
    return joined.mapInArrow(thrifty(run), "a long, b long")


def _cell(one: np.ndarray, two: np.ndarray, x: np.ndarray, part: np.ndarray, n: np.ndarray, bits: np.ndarray, hist: list, before: list[np.ndarray]) -> Iterator[tuple]:
    """Pairs of a set in `one` that is not free and a smaller set in `two` whose histograms allow a link.

    before: each row's hubs that are smaller than this one. A pair that has such a hub in common is left to the smallest.
    """
    two = two[np.argsort(n[two], kind="stable")]
    sizes, parts = n[two], part[two]
    held: dict[tuple[int, int], list] = {}  # rows of `two` with so many groups, folded to so many

    def folded(size: int, groups: int) -> tuple:
        if (size, groups) not in held:
            at = np.flatnonzero([len(hist[i]) == size for i in two])
            h = np.frombuffer(b"".join(hist[two[i]] for i in at), np.uint8).reshape(len(at), size)
            h = _folded(h, groups)
            held[size, groups] = (int(at[0]) if len(at) else 0, h, h.max(1, initial=0) == 255)
        return held[size, groups]

    kinds = sorted({len(hist[i]) for i in two})
    for i in one[bits[one] > 0]:
        size, own, mine_before = int(n[i]), band_of(int(n[i])), set(before[i].tolist())
        for o in range(min(REACH, own + 1)):
            if not bits[i] >> o & 1:
                continue
            low, high = BANDS[own - o]
            a, b = np.searchsorted(sizes, max(low, -(-size * PER_CENT // 100))), np.searchsorted(sizes, min(high, size), "right")
            if a >= b or not (parts[a:b] != part[i]).any():
                continue
            for kind in kinds:  # sets with as many groups are next to each other, as they are in order of size
                groups = min(kind, len(hist[i]))
                start, h, full = folded(kind, groups)
                c, d = max(a - start, 0), min(b - start, len(h))
                if c >= d:
                    continue
                mine = _folded(np.frombuffer(hist[i], np.uint8), groups)
                apart = np.flatnonzero(parts[start + c : start + d] != part[i])
                if not len(apart):
                    continue
                rows = h[c:d] if 2 * len(apart) > d - c else h[c:d][apart]
                both = least_sums(mine, rows)
                both = both[apart] if len(rows) > len(apart) else both
                at = start + c + apart
                ok = full[c:d][apart] | (mine.max() == 255) | (100 * both >= PER_CENT * (size + sizes[at] - both))
                for j in two[at[ok]]:
                    if x[j] != x[i] and mine_before.isdisjoint(before[j].tolist()):
                        yield min(x[i], x[j]), max(x[i], x[j])


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of sorted batches by their first columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        edges = graph.group_bounds(*columns)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            key = tuple(int(c[a]) for c in columns)
            if key != last:
                if held:
                    yield pa.Table.from_batches(held)
                held, last = [], key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _within_hubs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(hub, ci, cj, looks, x, part, n): cells of a hub's members(hub, x, part, bits, n), with those sets only that have a pair there.

    Pairs are of sets in different parts that histograms allow; one is not free. They are not given out, as their
    number grows with the square of a hub's sets: _hub_links compares what is left in a cell. A cell has a chunk of those that are not free (looks) and a chunk of those whose sizes come into question for some.
    Sets often have many hubs in common: each row names the set's smaller hubs, so that only the smallest common one emits a pair.
    """
    names = ("hub", "ci", "cj", "looks", "x", "part", "bits", "n", "histogram", "before")
    given = ["hub", "ci", "cj", "looks", "x", "part", "n"]

    def judge(rows: dict) -> Iterator[tuple]:
        yield from _cell(np.flatnonzero(rows["looks"]), np.flatnonzero(~rows["looks"]), *(rows[c] for c in ("x", "part", "n", "bits", "histogram", "before")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 3):
            if len(t) < 2:
                continue
            rows = {c: t.column(c).to_pylist() if c == "histogram" else np.array(t.column(c).to_numpy()) for c in names[:-1]}
            lists = t.column("before").combine_chunks()
            rows["before"] = np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            found = {x for pair in judge(rows) for x in pair}
            if found:
                yield from t.select(given).filter(pa.array(np.isin(rows["x"], list(found)))).combine_chunks().to_batches()

    looks, low = F.col("bits") > 0, F.ceil(F.col("n") * PER_CENT / 100)
    mixed = members.groupBy("hub").agg(
        F.min("part").alias("p"), F.max("part").alias("q"), F.ceil(F.count("*") / CHUNK).cast("int").alias("kj"), F.ceil(F.count_if(looks) / CHUNK).cast("int").alias("ki"),
        F.min(F.when(looks, low)).alias("low"), F.max(F.when(looks, F.col("n"))).alias("high"),
    )
    rows = members.join(mixed.where("p <> q AND ki > 0"), "hub")
    cell = lambda looks, i, j: F.struct(F.lit(looks).alias("looks"), i.alias("ci"), j.alias("cj"))
    chunk = lambda k: F.pmod(F.xxhash64("x"), F.col(k)).cast("int")
    near = F.col("n").between(F.col("low"), F.col("high"))
    one = F.filter(F.transform(F.sequence(F.lit(0), F.col("kj") - 1), lambda j: cell(True, chunk("ki"), j)), lambda _: looks)
    two = F.filter(F.transform(F.sequence(F.lit(0), F.col("ki") - 1), lambda i: cell(False, i, chunk("kj"))), lambda _: near)
    rows = rows.where(looks | near)
    of_set = rows.groupBy("x").agg(F.collect_list("hub").alias("hubs")).join(classes.select(F.col("cid").alias("x"), "histogram"), "x")
    rows = rows.select("hub", "x", "part", "bits", "n", F.explode(F.concat(one, two)).alias("cell")).join(of_set, "x")
    before = F.filter("hubs", lambda g: g < F.col("hub"))  # a set has at most as many hubs as signatures
    rows = rows.select("hub", "cell.ci", "cell.cj", "cell.looks", "x", "part", "bits", "n", "histogram", before.alias("before"))
    rows = rows.repartition("hub", "ci", "cj").sortWithinPartitions("hub", "ci", "cj")
    return rows.mapInArrow(thrifty(run), "hub long, ci int, cj int, looks boolean, x long, part long, n long")


def _joined(looks: np.ndarray, part: np.ndarray, n: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links (row, row) of a set that looks and a smaller one that does not, as many as join their parts: fewer than there are rows."""
    one, two = np.flatnonzero(looks), np.flatnonzero(~looks)
    if not len(one) or not len(two):
        return
    two = two[np.argsort(n[two], kind="stable")]
    sizes = n[two]
    ids = np.unique(np.concatenate([*(sets[i] for i in two), *(sets[i] for i in one)]), return_inverse=True)[1]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    ends = edges[-1] + np.concatenate([[0], np.cumsum(n[one])])
    mark = np.zeros(ids.max() + 1, bool)
    label = np.unique(part, return_inverse=True)[1]
    for at, i in enumerate(one):
        a, b = np.searchsorted(sizes, -(-n[i] * PER_CENT // 100)), np.searchsorted(sizes, n[i], "right")
        apart = a + np.flatnonzero(label[two[a:b]] != label[i])
        if not len(apart):
            continue
        own = ids[ends[at] : ends[at + 1]]
        mark[own] = True
        if 2 * len(apart) > b - a:
            both = np.add.reduceat(mark[ids[edges[a] : edges[b]]], edges[a:b] - edges[a], dtype=np.int64)[apart - a]
        else:
            both = np.array([np.count_nonzero(mark[ids[edges[j] : edges[j + 1]]]) for j in apart])
        mark[own] = False
        for j in two[apart[100 * both >= PER_CENT * (n[i] + sizes[apart] - both)]]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield i, j


def _hub_links(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that join all parts of a cell that links join, from the sets(cid, set) of the rows of _within_hubs.

    A cell whose sets have many tokens is dealt to cells of parts of its two sides.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, 5):
            x, tokens = t.column("x").to_numpy(), [np.frombuffer(u.as_buffer(), _U) for u in t.column("set")]
            found = list(_joined(t.column("looks").to_numpy(), t.column("part").to_numpy(), np.array([len(u) for u in tokens]), tokens))
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x[i], x[j])), pa.array(np.maximum(x[i], x[j]))], names=["a", "b"])

    cell = ["hub", "ci", "cj"]
    parts = lambda looks: F.ceil(F.coalesce(F.sum(F.when(F.col("looks") == looks, F.col("n"))), F.lit(1)) / CELL_TOKENS).cast("int")
    rows = asked.join(asked.groupBy(*cell).agg(parts(True).alias("ki"), parts(False).alias("kj")), cell)
    mine = F.pmod(F.xxhash64("x"), F.when(F.col("looks"), F.col("ki")).otherwise(F.col("kj"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("looks"), F.col("kj")).otherwise(F.col("ki")) - 1)
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(other)).join(sets.withColumnRenamed("cid", "x"), "x")
    rows = rows.withColumns({"di": F.when(F.col("looks"), F.col("mine")).otherwise(F.col("other")), "dj": F.when(F.col("looks"), F.col("other")).otherwise(F.col("mine"))})
    cell += ["di", "dj"]
    rows = rows.select(*cell, "looks", "x", "part", "set").repartition(*cell).sortWithinPartitions(*cell)
    return rows.mapInArrow(thrifty(run), "a long, b long")


def describe(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, class, band, histogram); the last three are null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            found = [(len(u), shingles.digest(u), band_of(len(u)), histogram(u)) if len(u) else (0, None, None, None) for u in shingles.sets(s)]
            n, c, b, h = map(list, zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(b, pa.int32()), pa.array(h, pa.binary())], names=["id", "n_shingles", "class", "band", "histogram"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(thrifty(run), f"id {kind}, n_shingles long, class binary, band int, histogram binary")


def _packed(docs: DataFrame, id_col: str, text_col: str, others: dict[int, int], bits: int) -> DataFrame:
    """Signatures dealt to 2^bits buckets; a row has many, as arrays. A set that a task has seen is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            classes = np.frombuffer(b"".join(c for c, _, _ in held), "V16")
            sig = np.concatenate([x for _, x, _ in held])
            role = np.concatenate([x for _, _, x in held])
            ref = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for _, x, _ in held])
            bucket = (sig >> _U(64 - bits)).astype(np.uint32)
            order = np.argsort(bucket, kind="stable")
            sig, role, ref, bucket = ((sig >> _U(8)) & _U(0xFFFFFFFF)).astype(np.uint32)[order], role[order], ref[order], bucket[order]
            edges = graph.group_bounds(bucket)
            rows = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                own, local = np.unique(ref[a:b], return_inverse=True)
                rows.append((int(bucket[a]), classes[own].tobytes(), local.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes(), sig[a:b].tobytes(), role[a:b].tobytes()))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "classes", "refs", "sigs", "roles"])

        for s in slices(batches):
            for u in shingles.sets(s):
                if not len(u) or (c := shingles.digest(u)) in seen:
                    continue
                seen.add(c)
                sig, role = signatures(u, others)
                if len(sig):
                    held.append((c, sig, role))
                    size += len(sig)
                    if size >= 1_500_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), "bucket int, classes binary, refs binary, sigs binary, roles binary")


def _bucket_pairs(table: pa.Table) -> pa.Table:
    """Candidate pairs of one bucket; hub pairs where more than FEW sets share a signature, the hub with itself too.

    rare: whether they share a signature that is not frequent. f0, f1, f2: how many frequent signatures b has with that hub in its own band, one and two below.
    """
    classes, sigs, refs, roles, base = [], [], [], [], 0
    for c, r, s, o in zip(*(table.column(x).to_pylist() for x in ("classes", "refs", "sigs", "roles")), strict=True):
        own, sig = np.frombuffer(c, "V16"), np.frombuffer(s, np.uint32)
        refs.append(np.frombuffer(r, np.uint32 if len(r) == 4 * len(sig) else np.uint16).astype(np.int64) + base)
        classes.append(own)
        sigs.append(sig)
        roles.append(np.frombuffer(o, np.uint8))
        base += len(own)
    # equal classes from different tasks become one; numbers follow the order of the classes
    raw = np.concatenate(classes).view(np.uint8).reshape(-1, 16)
    key = raw.view(">u8").reshape(-1, 2).astype(_U)
    order = np.lexsort((key[:, 1], key[:, 0]))
    key = key[order]
    new = np.append(True, (key[1:] != key[:-1]).any(1))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    names = raw[order][new]
    ref, sig, role = number[np.concatenate(refs)], np.concatenate(sigs), np.concatenate(roles)
    count = len(names)
    order = np.argsort(sig, kind="stable")
    sig, ref, role = sig[order], ref[order], role[order]
    edges = graph.group_bounds(sig)
    lengths = np.diff(edges)
    at = edges[:-1][lengths == 2]
    a, b = np.minimum(ref[at], ref[at + 1]), np.maximum(ref[at], ref[at + 1])
    x, y = role[at], role[at + 1]
    good = (a != b) & (((x & PROBE) & ((y & INDEX) << 1)) | ((y & PROBE) & ((x & INDEX) << 1)) > 0) & ((x & y & DELETED) == 0)
    plain = [a[good] * count + b[good]]
    hubs = []
    for i in np.flatnonzero(lengths > 2):
        here = np.unique(ref[edges[i] : edges[i + 1]] * REACH + (role[edges[i] : edges[i + 1]] >> BELOW))  # tasks may have the same set
        own = np.unique(here // REACH)
        if len(own) > FEW:
            hubs.append(own[0] * count * REACH + here)
        elif len(own) > 1:
            j, k = np.triu_indices(len(own), 1)
            plain.append(own[j] * count + own[k])
        if len(plain) > 20000:
            plain = [np.unique(np.concatenate(plain))]
    plain = np.unique(np.concatenate(plain))
    hub, at = np.unique(np.concatenate(hubs) // REACH if hubs else np.zeros(0, np.int64), return_inverse=True)
    often = np.bincount(at * REACH + np.concatenate(hubs) % REACH, minlength=REACH * len(hub)) if hubs else np.zeros(0, np.int64)
    both = np.union1d(hub, plain)
    left, right = (pa.array([x.tobytes() for x in names[i]], pa.binary()) for i in (both // max(1, count), both % max(1, count)))
    counts = np.zeros((len(both), REACH), np.int32)
    counts[np.searchsorted(both, hub)] = often.reshape(-1, REACH)
    return pa.table({"a": left, "b": right, "hub": pa.array(np.isin(both, hub)), "rare": pa.array(np.isin(both, plain)), **{f"f{o}": pa.array(counts[:, o]) for o in range(REACH)}})


def _sets_of(rows: DataFrame) -> DataFrame:
    """(cid, set) of rows (cid, class, text) whose text has the set of its class; an id may have other texts as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = pa.array(np.arange(batch.num_rows))
                classes.clear()
                classes.append((batch.column(0), batch.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([at, batch.column(2)], names=["at", "text"])

        classes: list[tuple] = []
        for s in slices(numbered()):
            cids, own = classes[-1]
            made = [(i, u) for i, u in zip(s.ids.to_pylist(), shingles.sets(s), strict=True) if shingles.digest(u) == own[i]]
            if made:
                yield pa.RecordBatch.from_arrays([cids.take(pa.array([i for i, _ in made])), pa.array([u.tobytes() for _, u in made], pa.binary())], names=["cid", "set"])

    return rows.select("cid", "class", "text").mapInArrow(thrifty(run), "cid long, set binary")


def similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, _U), np.frombuffer(b, _U)
    if min(len(x), len(y)) * 100 < PER_CENT * max(len(x), len(y)):
        return False
    z = np.sort(np.concatenate([x, y]))
    both = int((z[1:] == z[:-1]).sum())
    return 100 * both >= PER_CENT * (len(x) + len(y) - both)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    side = lambda x: sets.select(F.col("cid").alias(x), F.col("set").alias(f"s{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    out = durable(joined.mapInArrow(thrifty(run), "a long, b long"))
    release(pairs)
    return out


def _flat(rows: DataFrame) -> DataFrame:
    """(a, ca, b) of rows (a, ca, bs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bs = batch.column(2)
            at = pa.array(np.repeat(np.arange(batch.num_rows), bs.value_lengths().to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), bs.flatten()], names=["a", "ca", "b"])

    return rows.select("a", "ca", "bs").mapInArrow(thrifty(run), "a long, ca long, b long")


def _across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose ends are in different parts; parts(node, component) names every class.

    A class carries its partners as one row until its component is known, and only pairs across
    components leave the join: a group of copies that has come together gives none.
    """
    lists = pairs.groupBy("a").agg(F.collect_set("b").alias("bs"))  # a class has at most FEW - 1 partners a signature
    known = lists.join(parts.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a")
    other = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    flat = _flat(known)
    return flat.join(other, (flat["b"] == other["b"]) & (flat["ca"] != other["cb"])).select(flat["a"], flat["b"])


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    return graph.components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(links.select("a", "b")), "a", "b")


def _bounds(often: DataFrame) -> DataFrame:
    """(x, bits, n) of rows (x, f0, f1, f2, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f0, f1, f2, n = (batch.column(i).to_pylist() for i in range(1, 5))
            bits = [bound(m, f) for m, *f in zip(n, f0, f1, f2, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.int32()), batch.column(4)], names=["x", "bits", "n"])

    return often.select("x", "f0", "f1", "f2", "n").mapInArrow(thrifty(run), "x long, bits int, n long")


def _degrees(classes: list[bytes], sets: list[np.ndarray], copies: np.ndarray, chunk: np.ndarray, cross: bool) -> np.ndarray:
    """Per set, the copies of all sets that are similar to it; with cross, of those in the other chunk."""
    n = np.array([len(u) for u in sets])
    order = np.lexsort((classes, n))
    n, copies, chunk = n[order], copies[order], chunk[order]
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    edges = np.concatenate([[0], np.cumsum(n)])
    mark = np.zeros(ids.max() + 1, bool)
    degree = np.zeros(len(n), np.int64)
    low = np.searchsorted(n, -(-n * PER_CENT // 100))
    for i in range(len(n)):
        own, a = ids[edges[i] : edges[i + 1]], low[i]
        if a >= i or cross and (chunk[a:i] == chunk[i]).all():
            continue
        mark[own] = True
        both = np.add.reduceat(mark[ids[edges[a] : edges[i]]], edges[a:i] - edges[a], dtype=np.int64)
        mark[own] = False
        ok = 100 * both >= PER_CENT * (n[i] + n[a:i] - both)
        if cross:
            ok &= chunk[a:i] != chunk[i]
        degree[i] += copies[a:i][ok].sum()
        degree[a:i][ok] += copies[i]
    out = np.empty_like(degree)
    out[order] = degree
    return out


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(cid, links): how many rows of other classes each class of classes(cid, class, rep, n, copies, part) links with.

    Links lie within components. A component's sets are dealt to cells of chunk pairs, where all pairs are compared; cells give sums, not pairs.
    """
    names = ("part", "ci", "cj", "chunk", "class", "copies", "cid", "text")

    def judge(held: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(held)
        found: dict[bytes, tuple] = {}
        own, copies, chunk, cid = t.column("class").to_pylist(), t.column("copies").to_numpy(), t.column("chunk").to_numpy(), t.column("cid").to_numpy()
        at = 0
        for s in slices(pa.table({"at": np.arange(len(t)), "text": t.column("text")}).to_batches()):
            for u in shingles.sets(s):
                if own[at] not in found and shingles.digest(u) == own[at]:  # ids may repeat with other texts
                    found[own[at]] = (u, copies[at], chunk[at], cid[at])
                at += 1
        if len(found) < 2:
            return None
        sets, copies, chunk, cid = zip(*found.values(), strict=True)
        degree = _degrees(list(found), list(sets), np.array(copies), np.array(chunk), held[0].column(1)[0] != held[0].column(2)[0])
        return pa.RecordBatch.from_arrays([pa.array(cid, pa.int64()), pa.array(degree)], names=["cid", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(3)]
            edges = graph.group_bounds(*keys)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                key = tuple(k[a] for k in keys)
                if key != last:
                    if held and (made := judge(held)) is not None:
                        yield made
                    held, last = [], key
                held.append(batch.slice(a, b - a))
        if held and (made := judge(held)) is not None:
            yield made

    sizes = classes.groupBy("part").agg(F.count("*").alias("c"), F.sum("n").alias("tokens")).where("c > 1")
    chunks = F.greatest(F.ceil(F.col("c") / CHUNK), F.ceil(F.col("tokens") / CELL_TOKENS)).cast("int")
    rows = classes.join(sizes.select("part", chunks.alias("chunks")), "part").select("part", "rep", "cid", "class", "copies", "chunks", F.pmod(F.xxhash64("class"), "chunks").cast("int").alias("chunk"))
    rows = rows.join(docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")), "rep")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.withColumns({"ci": F.least("chunk", "other"), "cj": F.greatest("chunk", "other")}).select(*names)
    rows = rows.repartition("part", "ci", "cj").sortWithinPartitions("part", "ci", "cj")
    return rows.mapInArrow(thrifty(run), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))


def _repeats(rows: DataFrame) -> bool:
    """Whether any id has several rows."""
    return not rows.groupBy("id").count().where("count > 1").isEmpty()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: bool = True) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row: the smallest id that links reach, itself included, and its number of links.

    Without count, n_links is left out, for those who need components only.
    """
    rows = durable(describe(docs, id_col, text_col))
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("rep"), F.min("band").alias("band"), F.max("n_shingles").alias("n"), F.max("histogram").alias("histogram"), F.count("*").alias("copies"))
    # classes are known by numbers that the table fixes, as ids may repeat with different texts
    classes = durable(classes.withColumn("cid", F.monotonically_increasing_id()))
    stats = classes.groupBy("band").agg(F.count("*").alias("c"), F.sum("n").alias("n")).collect()  # one row per size band
    others = {r["band"]: r["c"] for r in stats}
    # signatures are about half as many as tokens; a bucket holds about a million
    bits = max(6, int(np.ceil(np.log2(max(1, sum(r["n"] for r in stats) / 2_000_000)))))
    packed = _packed(docs, id_col, text_col, others, bits)
    pairs = packed.groupBy("bucket").applyInArrow(thrifty_group(_bucket_pairs), "a binary, b binary, hub boolean, rare boolean, f0 int, f1 int, f2 int")
    pairs = pairs.groupBy("a", "b").agg(F.max("hub").alias("hub"), F.max("rare").alias("rare"), F.count("*").alias("k"), *(F.sum(f).alias(f) for f in ("f0", "f1", "f2")))
    for x in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("class").alias(x), F.col("cid").alias(f"c{x}")), x)
    pairs = durable(pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "hub", "rare", "k", "f0", "f1", "f2"))
    hubs, pairs = pairs.where("hub"), pairs.where("a <> b").select("a", "b", "k", "rare")
    del packed
    release(docs)
    unique = not _repeats(rows)

    def sets_of(nodes: DataFrame) -> DataFrame:
        """(cid, set) of the classes that nodes(cid) names."""
        nodes = nodes.distinct().join(classes.select("cid", "class", "rep"), "cid")
        texts = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text")).join(nodes, "rep")
        sets = _sets_of(texts)
        sets = durable(sets if unique else sets.groupBy("cid").agg(F.first("set").alias("set")))
        release(docs)
        return sets

    def linked(some: DataFrame) -> DataFrame:
        """Those of some pairs that link, from the sets of the texts that they name."""
        some = durable(some)
        sets = sets_of(some.select(F.explode(F.array("a", "b")).alias("cid")))
        out = _linked(some, sets)
        discard(sets)
        discard(some)
        return out

    def every(parts: DataFrame) -> DataFrame:
        """(node, component) of all classes."""
        return classes.select("cid").join(parts, F.col("cid") == F.col("node"), "left").select(F.col("cid").alias("node"), F.coalesce("component", "cid").alias("component"))

    # first each set's likeliest partner: copies come together, and their other pairs need no look
    best = Window.partitionBy("b").orderBy(F.desc("k"), F.desc("a"))
    ranked = pairs.withColumn("top", F.row_number().over(best) == 1)
    first = ranked.where("top").select("a", "b")
    parts = every(graph.components(linked(_plausible(first, classes)), "a", "b"))
    # pairs that only frequent signatures have brought together are left to their hubs
    rest = _across(ranked.where("rare AND NOT top").select("a", "b"), parts)
    # they come together before hubs are looked at, as these compare what is apart
    parts = every(_merged(parts, linked(_plausible(rest, classes))))
    often = hubs.groupBy(F.col("b").alias("x")).agg(*(F.sum(f).alias(f) for f in ("f0", "f1", "f2")))
    often = often.join(classes.select(F.col("cid").alias("x"), "n"), "x")
    members = hubs.select(F.col("a").alias("hub"), F.col("b").alias("x")).join(_bounds(often), "x")
    members = members.join(parts.select(F.col("node").alias("x"), F.col("component").alias("part")), "x")
    asked = durable(_within_hubs(members.select("hub", "x", "part", "bits", "n"), classes))
    sets = sets_of(asked.select(F.col("x").alias("cid")))
    more = durable(_hub_links(asked, sets))
    discard(asked)
    discard(sets)
    parts = every(_merged(parts, more))
    # components are named by their smallest id
    own = classes.join(parts, F.col("cid") == F.col("node")).select("cid", "class", "rep", "n", "copies", F.col("component").alias("part"))
    named = own.join(own.groupBy("part").agg(F.min("rep").alias("least")), "part")
    links = F.lit(0)
    if count:
        release(docs)
        named = named.join(durable(_links(docs, own, id_col, text_col)), "cid", "left")
        links = F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0))
    out = rows.join(named.drop("rep", "n", "part", "cid"), "class", "left").withColumn("n_links", links)
    out = out.select(F.col("id").alias(id_col), "n_shingles", F.coalesce("least", "id").alias("component_id"), "n_links")
    return out if count else out.drop("n_links")
