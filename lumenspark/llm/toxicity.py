"""Toxicity by compression distance: one zstandard dictionary per class, compared window by window.

Training takes a bounded sample of labelled rows (TRAIN_ROWS) and reads their whole texts. A window is one word (a run of
letters), written ECHO times so that even a short one has a compressed form. The ordinary
dictionary holds the most frequent words of ordinary rows; the toxic dictionary the same and, before
them, the words whose share of toxic rows far exceeds their share of ordinary rows. The bytes that
the toxic dictionary saves in a window against the ordinary one, beyond a threshold, are summed over
the text; a logistic curve over that sum, its share of all windows and the text's number of windows
gives the score. How many words mark toxic rows, and the threshold, are those of MARKED and THRESHOLDS
with the best likelihood in cross-validation: a third of the sample is read with dictionaries and a
curve made from the others. The curve is fitted to what the rows save with dictionaries made without them.

Edge cases: null and empty texts, and texts without letters, get the score of a text without toxic
windows; repeated rows each give a row; an empty table gives an empty table; null labels are not
learnt from; without labels of both classes training raises ValueError; only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import row_sums, slices, thrifty

#: Labelled rows that training reads at most, about; the classes have equal limits.
TRAIN_ROWS = 8_000
ECHO = 3
#: Words of the ordinary dictionary at most; what a worker remembers of words is bounded as well.
ORDINARY_WORDS, REMEMBERED = 300, 200_000
#: Tried in cross-validation: words that mark toxic rows at most (all fit in zstandard's window), and thresholds in bytes.
MARKED, THRESHOLDS, FOLDS = (20, 40, 80, 160, 320, 640), (1, 2, 3, 4, 5, 6), 3
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def written(word: bytes) -> bytes:
    return (word + b" ") * ECHO


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: float
    weights: list[float]

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """A worker's compressors and the savings of words that it has seen."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.toxic, self.ordinary = (self._compressor(x) for x in (model.toxic, model.ordinary))

    @staticmethod
    def _compressor(content: bytes):
        params = zstandard.ZstdCompressionParameters.from_level(
            3, strategy=zstandard.STRATEGY_GREEDY, min_match=4, window_log=15, search_log=5, hash_log=14, chain_log=14,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=params)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress

    def savings(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        words, known = _WORD.findall(text), self.known
        try:
            return np.array([known[w] for w in words], np.int64)
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for w in words:
            if w not in known:
                e = written(w)
                known[w] = len(self.ordinary(e)) - len(self.toxic(e))
        return np.array([known[w] for w in words], np.int64)

    def features(self, text: bytes) -> list[float]:
        gain = self.savings(text)
        over = float(np.maximum(gain - self.model.threshold, 0).sum())
        return _columns(np.array([over]), np.array([len(gain)]))[0].tolist()

    def score(self, text: bytes) -> float:
        z = float(np.dot(self.model.weights, self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def window_counts(text: bytes) -> dict[bytes, int]:
    """How often each window stands in a text."""
    found: dict[bytes, int] = {}
    for w in _WORD.findall(text):
        found[w] = found.get(w, 0) + 1
    return found


def train(toxic: Iterable, ordinary: Iterable) -> Model:
    """Dictionaries, threshold and curve from texts of the two classes, or from their windows and how often they stand there.

    Texts are taken one by one; of each only the numbers of its windows and their counts stay.
    """
    number: dict[bytes, int] = {}
    rows, counts, sizes = [], [], []
    for texts in (toxic, ordinary):
        for t in texts:
            own = window_counts(t.encode("utf-8", "replace").lower()) if isinstance(t, str) else t
            rows.append(np.array([number.setdefault(w, len(number)) for w in own], np.int32))
            counts.append(np.array(list(own.values()), np.int32))
        sizes.append(len(rows) - sum(sizes))
    if not all(sizes):
        raise ValueError("training needs labelled rows of both classes")
    words = list(number)
    y = np.repeat([1.0, 0.0], sizes)
    fold = np.concatenate([np.arange(n) for n in sizes]) % FOLDS
    flat, times, edges = np.concatenate(rows), np.concatenate(counts), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    windows = row_sums(times, edges)
    some = lambda keep: [(rows[i], counts[i]) for i in np.flatnonzero(keep)]
    made = lambda keep, size: _dictionaries(some(keep & (y == 1)), some(keep & (y == 0)), words, size)
    best, chosen = -np.inf, None
    for size in MARKED:
        gain = np.zeros(len(flat), np.int16)
        for f in range(FOLDS):
            own = np.repeat(fold == f, np.diff(edges))
            gain[own] = _gains(*made(fold != f, size), words)[flat[own]]
        for threshold in THRESHOLDS:
            over = row_sums(np.maximum(gain - threshold, 0).astype(np.float64) * times, edges)
            x, p = _columns(over, windows), np.zeros(len(y))
            for f in range(FOLDS):
                z = x[fold == f] @ np.array(_logistic(x[fold != f], y[fold != f]))
                p[fold == f] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            fit_ = float(np.log(np.where(y == 1, p, 1 - p) + 1e-12).mean())
            if fit_ > best:
                best, chosen = fit_, (size, float(threshold), _logistic(x, y))
    size, threshold, weights = chosen
    return Model(*made(fold >= 0, size), threshold, weights)


def _dictionaries(bad: list[tuple], good: list[tuple], words: list[bytes], size: int) -> tuple[bytes, bytes]:
    """Toxic and ordinary dictionary from the windows (numbers of words, and how often) of each class's texts; size: words that mark toxic texts, at most."""
    texts = lambda rows: np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, _ in rows)]), minlength=len(words))
    in_bad, in_good = texts(bad), texts(good)
    odds = in_bad / max(1, len(bad)) / ((in_good + 0.5) / max(1, len(good)))
    able = (np.array([len(w) for w in words]) > 2) & (in_bad >= max(2, 0.006 * len(bad))) & (odds > 1)
    marked = sorted(np.flatnonzero(able).tolist(), key=lambda i: (odds[i], words[i]))[-size:]
    often = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, _ in good)]), np.concatenate([np.zeros(0), *(c for _, c in good)]), len(words))
    often[marked] = 0
    plain = [i for i in np.argsort(-often, kind="stable")[:ORDINARY_WORDS].tolist() if often[i]]
    shared = b"".join(written(words[i]) for i in plain[::-1]) or b" " * 16
    return b"".join(written(words[i]) for i in marked) + shared, shared


def _gains(toxic: bytes, ordinary: bytes, words: list[bytes]) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each word's window."""
    reader = Model(toxic, ordinary, 0.0, []).reader()
    return np.array([len(reader.ordinary(e)) - len(reader.toxic(e)) for e in map(written, words)], np.int64)


def _columns(over: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Rows of the curve's features."""
    return np.column_stack([np.ones(len(over)), np.log1p(over), np.log1p(100 * over / (windows + 30)), np.log1p(windows)])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def sampled(docs: DataFrame, labels: DataFrame, label: str, keep, rows: int, id_col="doc_id", text_col="text") -> DataFrame:
    """(_id, _t, _y): whole texts of about rows labelled ids at most, chosen by a hash of the id; null labels are left out.

    The ids that are chosen are few by construction, so they are broadcast. Of an id that repeats the
    greatest text is taken, its copies falling together before anything is shuffled.
    """
    marked = labels.where(F.col(label).isNotNull()).where(keep).select(F.col(id_col).alias("_id"), F.col(label).alias("_y"))
    marked = marked.where(F.col("_id").isNotNull()).groupBy("_id").agg(F.max("_y").alias("_y"))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    each = rows / max(1, len(counts))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("_y") == y, F.lit(min(1.0, each / n))).otherwise(share)
    chosen = marked.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < share * (1 << 30))
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    found = texts.join(F.broadcast(chosen), "_id")  # at most about `rows` ids
    return found.groupBy("_id").agg(F.max("_t").alias("_t"), F.max("_y").alias("_y"))


def fit(docs: DataFrame, labels: DataFrame, keep, label="toxic", rows: int = TRAIN_ROWS, id_col="doc_id", text_col="text") -> Model:
    """Train on the labelled rows that keep (a condition on labels) lets through; texts are cut into windows where they lie, and windows are counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [window_counts(t.encode().lower()) for t in batch.column(1).to_pylist()]
            windows = [b" ".join(x) for x in found]  # a window holds letters only
            times = [np.array(list(x.values()), np.int32).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(windows, pa.binary()), pa.array(times, pa.binary())], names=["id", "y", "windows", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    some = sampled(docs, labels, label, keep, rows, id_col, text_col).select("_id", "_t", "_y")
    found = some.mapInArrow(thrifty(count), f"id {kind}, y int, windows binary, times binary").toArrow().sort_by("id")
    own = lambda y: (dict(zip(w.as_py().split(), np.frombuffer(t.as_py(), np.int32).tolist(), strict=True)) for w, t in zip(*(found.filter(pc.equal(found["y"], y))[c] for c in ("windows", "times")), strict=True))
    return train(own(1), own(0))


def score_table(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for s in slices(batches):
            scores = [reader.score(s.piece(i).lower()) for i in range(len(s))]
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(scores, pa.float64())], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(thrifty(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_ordinary(df: DataFrame, model: Model, threshold: float, text_col="text") -> DataFrame:
    """The rows whose text scores below the threshold, with all columns; a null text is scored as empty."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.reader()
        for batch in batches:
            keep = [reader.score((t or "").encode().lower()) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(thrifty(run), df.schema)
