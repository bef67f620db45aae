"""Language identification by mixture inference.

Per language, a table of smoothed log likelihoods of hashed byte trigrams is learnt, from whole texts of
a bounded sample of rows (TRAIN_ROWS) that are counted where they lie. A text is cut
into windows of WINDOW bytes; each window's log likelihood under every language is the sum over its
trigrams. Expectation maximisation then estimates the text's language proportions from the windows.
The language set is chosen among the leading 1, 2, ... up to all languages by likelihood less a penalty
of PENALTY * log(windows) per language. The prediction is the leading language of the chosen set, the
score its proportion; mixture holds the proportions of the whole set.

Edge cases: a null text, or one without a letter, is ``und`` with score 0 and an empty mixture; repeated rows each give a
row; an empty table gives an empty table; rows without a language are not learnt from; without any
language training raises ValueError; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import Slice, row_sums, slices
from .toxicity import sampled

#: Training rows at most, about, in equal shares of the languages.
TRAIN_ROWS = 8_000
BITS = 16
WINDOW = 48
ROUNDS = 12
PENALTY = 1.0
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 13]] = 32


def trigrams(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hashed trigram that ends at each byte; blanks stand before the first byte of each text that bounds delimit."""
    b = _LOWER[data].astype(np.uint32)
    blank = np.uint32(32)
    last, before = np.full(len(b), blank), np.full(len(b), blank)
    last[1:], before[2:] = b[:-1], b[:-2]
    first = bounds[:-1][np.diff(bounds) > 0]
    last[first] = before[first] = blank
    before[bounds[:-1][np.diff(bounds) > 1] + 1] = blank
    out = b * np.uint32(0x9E3779B1) + last * np.uint32(0x85EBCA6B) + before * np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    return out >> np.uint32(32 - BITS)


@dataclass
class Model:
    languages: list[str]
    log: np.ndarray  # [language, trigram], float32


def _model(counts: dict[str, np.ndarray]) -> Model:
    names = sorted(counts)
    if not names:
        raise ValueError("training needs rows with a language")
    smooth = np.array([counts[n] for n in names], float) + 0.5
    return Model(names, np.log(smooth / smooth.sum(1, keepdims=True)).astype(np.float32))


def _counted(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.bincount(trigrams(data, bounds), minlength=1 << BITS)


def train(texts: list[str], languages: list[str]) -> Model:
    counts: dict[str, np.ndarray] = {}
    for text, name in zip(texts, languages, strict=True):
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        counts[name] = counts.get(name, np.zeros(1 << BITS, np.int64)) + _counted(raw, np.array([0, len(raw)]))
    return _model(counts)


def fit(docs: DataFrame, keep, rows: int = TRAIN_ROWS, id_col="doc_id", text_col="text", lang_col="lang") -> Model:
    """Train on a bounded sample of the rows that keep (a condition) lets through and that have a language.

    Each task adds up the trigrams of its texts; what comes to the driver is one table a language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(1).to_pylist()
            for s in slices([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(0)], names=["i", "t"])]):
                for k, i in enumerate(s.ids.to_pylist()):
                    piece = s.data[s.bounds[k] : s.bounds[k + 1]]
                    own[names[i]] = own.get(names[i], np.zeros(1 << BITS, np.int64)) + _counted(piece, np.array([0, len(piece)]))
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own)), pa.array([c.tobytes() for c in own.values()], pa.binary())], names=["lang", "counts"])

    def add(tables: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c, np.int64) for c in tables.column("counts").to_pylist())
        return pa.table({"lang": tables.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    found = sampled(docs, docs, lang_col, keep, rows, id_col, text_col).select("_t", F.col("_y").cast("string"))
    parts = found.mapInArrow(count, "lang string, counts binary")
    added = parts.groupBy("lang").applyInArrow(add, "lang string, counts binary")
    return _model({r["lang"]: np.frombuffer(r["counts"], np.int64) for r in added.collect()})


def _mixture(like: np.ndarray, shift: np.ndarray, bounds: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood per text; like: exp(log likelihood - shift) per window and language."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    n = np.maximum(np.diff(bounds), 1)[:, None]
    pi = mask / mask.sum(1, keepdims=True)
    for _ in range(ROUNDS):
        part = like * pi[owner]
        total = part.sum(1, keepdims=True) + 1e-300
        pi = np.column_stack([row_sums(c, bounds) for c in (part / total).T]) / n
        pi = np.where(mask, np.maximum(pi, 1e-12), 0)
        pi /= pi.sum(1, keepdims=True)
    total = np.log((like * pi[owner]).sum(1) + 1e-300)
    return pi, row_sums(total + shift, bounds)


def infer(model: Model, s: Slice) -> np.ndarray:
    """Proportions [text, language] of the chosen set; 0 outside it."""
    k = len(model.languages)
    codes = trigrams(s.data, s.bounds)
    n = len(s)
    per = np.maximum(-(-np.diff(s.bounds) // WINDOW), 0)
    bounds = np.concatenate([[0], np.cumsum(per)])
    first = np.repeat(s.bounds[:-1], per) + WINDOW * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], per))
    edges = np.append(first, len(codes))
    log = np.column_stack([np.diff(np.concatenate([[0.0], np.cumsum(row[codes], dtype=np.float64)])[edges]) for row in model.log]) if len(codes) else np.zeros((0, k))
    shift = log.max(1) if len(log) else np.zeros(0)
    like = np.exp(log - shift[:, None])
    order = np.argsort(-_mixture(like, shift, bounds, np.ones((n, k), bool))[0], axis=1, kind="stable")
    best, chosen = np.full(n, -np.inf), np.zeros((n, k))
    for size in range(1, k + 1):
        mask = np.zeros((n, k), bool)
        np.put_along_axis(mask, order[:, :size], True, axis=1)
        pi, ll = _mixture(like, shift, bounds, mask)
        value = ll - PENALTY * (size - 1) * np.log(np.maximum(per, 2))
        better = value > best
        best = np.where(better, value, best)
        chosen = np.where(better[:, None], pi, chosen)
    return chosen


def predict_table(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, lang_pred, score, mixture) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            pi = infer(model, s)
            letter = np.array([_LETTER.search(t) is not None for t in s.texts.to_pylist()], bool)
            names = [model.languages[x] if ok else "und" for x, ok in zip(pi.argmax(1), letter, strict=True)]
            score = pa.array(np.where(letter, np.clip(pi.max(1), 0, 1), 0.0))
            sets = [[(model.languages[x], float(row[x])) for x in np.flatnonzero(row)] if ok else [] for row, ok in zip(pi, letter, strict=True)]
            mixture = pa.array(sets, pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(names), score, mixture], names=["id", "lang_pred", "score", "mixture"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double, mixture map<string,double>").withColumnRenamed("id", id_col)


def fold(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(n))
