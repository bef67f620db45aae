"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m characters may occur in a text with up to k = m * EDIT_RATE edits. Cut into
k + 1 pieces, at least one piece occurs unchanged, at about its own place in the item. An
Aho-Corasick automaton finds exact piece hits in one pass over each whole text; around each hit,
Myers' bit-parallel algorithm finds the least edit distance of the item to any part of the text.
Items shorter than MIN_CHARS have no edits: they are one piece, found where they stand verbatim and do
not begin or end inside a word (in scripts that set blanks between words).

Texts and items are compared in lower case with runs of white space as one blank; positions refer to
that form. The benchmark is read in blocks of BLOCK_CHARS characters, one pass over the texts per
block, so what is sent to executors stays bounded whatever the benchmark's size.

Edge cases: null and empty texts match nothing, nor do items that are null or empty after
normalisation; items with equal text each give their rows; repeated documents each give rows; empty
tables give an empty table; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices, thrifty

EDIT_RATE = 0.08
#: Shorter items must occur without edits.
MIN_CHARS = 40
#: Scripts whose words are not set apart by blanks, or take endings without one.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def in_word(text: str, at: int) -> bool:
    """Whether the characters on both sides of a position belong to one word."""
    both = text[max(0, at - 1) : at + 1]
    return 0 < at < len(text) and all(c.isalnum() or c == "_" for c in both) and not _UNSPACED.search(both)


def pieces(m: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces of as equal lengths as can be."""
    cuts = [m * i // (k + 1) for i in range(k + 2)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


class Pattern:
    """One item: its bit masks for Myers' algorithm."""

    def __init__(self, text: str, k: int):
        self.text, self.m, self.k = text, len(text), k
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: str, stop: bool = True) -> tuple[int, int] | None:
        """Least distance of the item to a part of text and the part's last position, if within k edits."""
        masks, full, top = self.masks, self.full, self.top
        up, down, score, found = full, 0, self.m, None
        least = self.k + 1
        left = len(text)
        for i, c in enumerate(text):
            x = masks.get(c, 0) | down
            d = (((x & up) + up) ^ up) | x
            h_up = down | (full & ~(d | up))
            h_down = up & d
            if h_up & top:
                score += 1
            elif h_down & top:
                score -= 1
                if score < least:
                    least, found = score, i
            elif score - (left - i - 1) >= least:
                break  # each further character lowers the score by one at most
            h_up = h_up << 1 & full
            down = d & h_up
            up = (h_down << 1 & full) | (full & ~(d | h_up))
        return None if found is None else (least, found + 1)


class Matcher:
    """Finds all items of a block in a text."""

    def __init__(self, items: list[tuple[object, str]], rate: float = EDIT_RATE):
        by_text: dict[str, list] = {}
        for i, text in items:
            if text and (t := normal(text)):
                by_text.setdefault(t, []).append(i)
        self.patterns = [Pattern(t, int(len(t) * rate) if len(t) >= MIN_CHARS else 0) for t in by_text]
        self.ids = list(by_text.values())
        where: dict[str, list[tuple[int, int]]] = {}
        for p, pattern in enumerate(self.patterns):
            for a, b in pieces(pattern.m, pattern.k):
                where.setdefault(pattern.text[a:b], []).append((p, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, edits, end) of the best occurrence of each item in the text, with the number of piece hits."""
        text = normal(text)
        starts: dict[int, list[int]] = {}
        if not self.patterns or not text:
            return []
        for end, (n, places) in self.automaton.iter(text):
            for p, a in places:
                starts.setdefault(p, []).append(end + 1 - n - a)
        out = []
        for p, at in starts.items():
            pattern, best = self.patterns[p], None
            k, done = pattern.k, -1
            if pattern.m < MIN_CHARS:
                ends = (s + pattern.m for s in at if not in_word(text, s) and not in_word(text, s + pattern.m))
                if end := next(ends, None):
                    out += [(i, 0, end, len(at)) for i in self.ids[p]]
                continue
            for s in sorted(at):  # the item would begin about here, k places off at most
                if best and not best[0]:
                    break
                if s + pattern.m + k <= done:
                    continue
                low = max(0, s - k)
                done = s + pattern.m + 2 * k
                hit = pattern.best(text[low:done])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                out += [(i, best[0], best[1], len(at)) for i in self.ids[p]]
        return out


def _blocks(benchmark: DataFrame, item_id: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, read one after the other."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").toLocalIterator():
        block.append((row["i"], row["t"]))
        size += len(row["t"])
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_id="item_id", item_text="text", rate: float = EDIT_RATE) -> DataFrame:
    """(id, item, edits, end): every text in which an item occurs within its edit budget, at its best place."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, edits int, end_pos long"

    def part(block):
        made: list[Matcher] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for s in slices(batches):
                if not made:
                    made.append(Matcher(block, rate))
                ids, found = s.ids.to_pylist(), [made[0].find(t) for t in s.texts.to_pylist()]
                rows = [(i, *x[:3]) for i, xs in zip(ids, found, strict=True) for x in xs]
                if rows:
                    a, b, c, d = map(list, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(a, s.ids.type), pa.array(b), pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["id", "item", "edits", "end_pos"])

        return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)

    out = None
    for block in _blocks(benchmark, item_id, item_text):
        out = part(block) if out is None else out.unionAll(part(block))
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_id})


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """Rows whose text holds no benchmark item; all columns are kept. One pass: a row is judged where it is read."""
    blocks = list(_blocks(benchmark, options.pop("item_id", "item_id"), options.pop("item_text", "text")))
    at = docs.columns.index(text_col)
    out = docs
    for block in blocks:

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = None
            for batch in batches:
                matcher = matcher or Matcher(block, **options)
                keep = [not (t and matcher.find(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(thrifty(run), docs.schema)
    return out
