"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

Each class has a mean and a covariance shrunk towards its own diagonal and the pooled one; the
score comes from the difference of the two log densities, each a Mahalanobis distance through a
cached Cholesky factor, and a logistic calibration of that difference fitted on the same rows.
Training takes a bounded sample of labelled rows (TRAIN_ROWS); the statistics of their whole texts
are made where the texts lie, and only these come to the driver.

Edge cases: null and empty texts have all-zero statistics and are scored like any other; repeated
rows each give a row; an empty table gives an empty table; null labels are not learnt from; without
labels of both classes training raises ValueError; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrow import slices
from .toxicity import _logistic, sampled

TRAIN_ROWS = 12_000
#: Weights of the class's own diagonal and of the pooled covariance.
TO_DIAGONAL, TO_POOLED = 0.1, 0.1

_CLASS = np.zeros(256, np.int64)  # 0: other
for _k, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\f\v", b"\n", b".,;:'\"()-", b"!?", b"|", b"#$%&*+/<=>@[\\]^_`{}~"), 1):
    _CLASS[list(_set)] = _k
_CLASS[128:] = 10


def statistics(raw: bytes, text: str) -> list[float]:
    """Transformed statistics of one whole text."""
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    by = np.bincount(_CLASS, counts, 11)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    w, d = len(words), len(set(words))
    share = counts[counts > 0] / max(1, n)
    entropy = float(-(share * np.log2(share)).sum())
    logit = lambda x, of: float(np.log((x + 0.5) / (max(of - x, 0) + 0.5)))
    return [
        float(np.log1p(n)),
        float(np.log1p(w)),
        (n - by[4] - by[5]) / max(1, w),
        entropy,
        logit(by[2], n),
        logit(by[3], n),
        logit(by[6], n),
        logit(by[7], n),
        logit(by[8], n),
        logit(by[9] + by[0], n),
        logit(by[5], n),
        logit(d, w),
        float(np.log((d + 1.0) / (w + 1.0) ** 0.8)),
        logit(len(lines) - len(set(lines)), len(lines)),
        float(np.log1p(max((len(x) for x in words), default=0))),
    ]


@dataclass
class Model:
    """Means, Cholesky factors of the covariances, half log determinants, and the calibration."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    half_logdet: list[float]
    weights: list[float]

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0."""
        log = []
        for mean, factor, half in zip(self.means, self.factors, self.half_logdet, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            log.append(-0.5 * (z * z).sum(0) - half)
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        # the root keeps far-out texts from saturating the calibration
        d = self.difference(x)
        z = np.column_stack([np.ones(len(x)), np.sign(d) * np.sqrt(np.abs(d))]) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[str], labels: list[int]) -> Model:
    return solve(np.array([statistics(t.encode("utf-8", "replace"), t) for t in texts]), labels)


def solve(x: np.ndarray, labels: list[int]) -> Model:
    """The model of rows of statistics and their labels."""
    y = np.array(labels, float)
    if not (0 < y.sum() < len(y)):
        raise ValueError("training needs labelled rows of both classes")
    own = [x[y == k] for k in (0, 1)]
    scatter = [(o - o.mean(0)).T @ (o - o.mean(0)) for o in own]
    pooled = sum(scatter) / max(1, len(x) - 2)
    model = Model([], [], [], [0.0, 1.0])
    for o, s in zip(own, scatter, strict=True):
        cov = s / max(1, len(o) - 1)
        cov = (1 - TO_DIAGONAL - TO_POOLED) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + TO_POOLED * pooled
        factor = np.linalg.cholesky(cov + 1e-3 * np.eye(len(cov)))
        model.means.append(o.mean(0))
        model.factors.append(factor)
        model.half_logdet.append(float(np.log(np.diag(factor)).sum()))
    d = model.difference(x)
    model.weights = _logistic(np.column_stack([np.ones(len(x)), np.sign(d) * np.sqrt(np.abs(d))]), y)
    return model


def fit(docs: DataFrame, labels: DataFrame, keep, label="quality", rows: int = TRAIN_ROWS, id_col="doc_id", text_col="text") -> Model:
    """Train on the labelled rows that keep (a condition on labels) lets through."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.encode(), t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    some = sampled(docs, labels, label, keep, rows, id_col, text_col).select("_id", "_t", "_y")
    found = sorted(some.mapInArrow(measure, f"id {kind}, y int, x array<double>").collect(), key=lambda r: r["id"])
    return solve(np.array([r["x"] for r in found]), [r["y"] for r in found])


def score_table(df: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            x = np.array([statistics(s.piece(i), t) for i, t in enumerate(s.texts.to_pylist())])
            yield pa.RecordBatch.from_arrays([s.ids, pa.array(model.score(x))], names=["id", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
