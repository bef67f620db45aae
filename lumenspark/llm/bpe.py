"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest.

Edge cases: a null or empty text has no ids (count 0, digests of the empty string); special tokens
are never produced, their strings are ordinary text; repeated rows each give a row; an empty table
gives an empty table; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .arrow import kept, slices, thrifty

#: Distinct pre-tokens that a worker remembers before it starts afresh; a memory bound, results do not depend on it.
REMEMBERED = 400_000
_MASK = (1 << 64) - 1


def _hash(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little")


def _slot(h: int, seed: int, n: int) -> int:
    x = (h ^ (seed * 0x9E3779B97F4A7C15)) & _MASK
    x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 29)) % n


class PerfectHash:
    """Minimal perfect hash over fixed keys by hash and displace: n slots for n keys, one seed per bucket."""

    def __init__(self, keys: list[bytes], load: int = 3):
        n = self.n = len(keys)
        self.buckets = max(1, n // load)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        self.values = [0] * n
        by: list[list[tuple[int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            a, b = _hash(key)
            by[a % self.buckets].append((b, i))
        free = bytearray(b"\1") * n
        left = 0
        for bucket in sorted(range(self.buckets), key=lambda k: -len(by[k])):
            members = by[bucket]
            if not members:
                break
            if len(members) == 1:  # placed last, each in the next free slot, which its bucket names
                left = free.index(1, left)
                i = members[0][1]
                free[left] = 0
                self.seeds[bucket], self.keys[left], self.values[left] = -1 - left, keys[i], i
                continue
            seed = 0
            while True:
                seed += 1
                slots = [_slot(h, seed, n) for h, _ in members]
                if all(free[s] for s in slots) and len(set(slots)) == len(slots):
                    break
            self.seeds[bucket] = seed
            for s, (_, i) in zip(slots, members, strict=True):
                free[s] = 0
                self.keys[s], self.values[s] = keys[i], i

    def get(self, key: bytes) -> int | None:
        """Position of the key among those given, or None if it is not one of them."""
        if not self.n:
            return None
        a, b = _hash(key)
        seed = self.seeds[a % self.buckets]
        s = _slot(b, seed, self.n) if seed >= 0 else -1 - seed
        return self.values[s] if self.keys[s] == key else None


def load_ranks(path: str) -> list[tuple[bytes, int]]:
    with open(path, "rb") as f:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, f)]


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.whole = PerfectHash([token for token, _ in ranks])
        self.ids = [i for _, i in ranks]
        self.ranks = dict(ranks)
        self.bytes_of = {i: token for token, i in ranks}
        self.memory: dict[str, tuple[str, bytes, int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token that is no token itself: lowest rank first, leftmost among equals."""
        n = len(piece)
        rank = self.ranks.get
        start = list(range(n + 1))  # start[i]: the part that begins at i; its end is nxt[i]
        nxt, prev = [i + 1 for i in start], [i - 1 for i in start]
        alive = bytearray(b"\1") * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or nxt[j] != end or not alive[j]:
                continue  # one of its parts was merged meanwhile
            alive[j] = 0
            nxt[i] = end
            if end < n:
                prev[end] = i
                if (r := rank(piece[i : nxt[end]])) is not None:
                    heapq.heappush(heap, (r, i, nxt[end]))
            if (p := prev[i]) >= 0 and (r := rank(piece[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : nxt[i]]])
            i = nxt[i]
        return out

    def piece(self, token: str) -> list[int]:
        raw = token.encode("utf-8", "surrogatepass")
        at = self.whole.get(raw)
        return [self.ids[at]] if at is not None else self.merge(raw)

    def encode(self, text: str | None) -> list[int]:
        return [i for token in self.split(text or "") for i in self.piece(token)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _learn(self, tokens: set[str]) -> None:
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        for token in [t for t in tokens if t not in self.memory]:
            ids = self.piece(token)
            self.memory[token] = (",".join(map(str, ids)), self.decode(ids), len(ids))

    def _parts(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens in lists of bounded length, whatever the text's."""
        if len(text) <= 1 << 17:
            if text:
                yield self.split(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, 1 << 16)):
            yield part

    def digest(self, text: str) -> tuple[int, str, str]:
        """Count of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
        n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
        for part in self._parts(text):
            self._learn(set(part))
            known = [self.memory[t] for t in part]
            ids.update(((b"," if n else b"") + ",".join([k[0] for k in known]).encode()))
            raw.update(b"".join([k[1] for k in known]))
            n += sum([k[2] for k in known])
        return n, ids.hexdigest(), raw.hexdigest()


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process, file and pattern, until another operator works there."""
    return kept((path, pattern), lambda: Codec(load_ranks(path), pattern))


def encode_table(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every text. The rank file must exist on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for s in slices(batches, 1 << 18):
            ids = [c.encode(t) for t in s.texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids], pa.binary())], names=["id", "ids", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(thrifty(run, keeps=True), f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digest_table(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, read from its ids and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for s in slices(batches):
            found = [c.digest(t) for t in s.texts.to_pylist()]
            n, a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(np.array(n, np.int64)), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(thrifty(run, keeps=True), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
