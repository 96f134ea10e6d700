"""Quality: ordinal cumulative-link regression over hashed text features.

One weight vector gives each text a value f; ordered thresholds t0 < t1 < ... cut it
into grades, P(grade <= k) = sigmoid(tk - f). The tail P(grade >= k) selects, the sum of
the tails is the expected grade. The features are frequencies of grams over bytes, hashed:
grams of 3 over character classes (shape) and grams of 4 over the bytes themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import texts

_SHAPE = np.arange(256, dtype=np.uint64)  # letters, digits, bytes of other scripts and blanks each become one class
for _a, _b, _to in ((ord("a"), ord("z"), ord("a")), (ord("A"), ord("Z"), ord("A")), (ord("0"), ord("9"), ord("0")), (128, 255, 128), (9, 9, 32), (11, 13, 32)):
    _SHAPE[_a : _b + 1] = _to
_STEP = 1 << 20


def features(text: str, bits: int = 12) -> np.ndarray:
    """2 * 2**bits float32: square roots of gram frequencies, shapes first; all zero for texts under 4 bytes."""
    size = 1 << bits
    out = np.zeros(2 * size)
    raw = np.frombuffer(text.encode(), np.uint8)
    for i in range(0, max(0, len(raw) - 3), _STEP):
        b = raw[i : i + _STEP + 3]
        s, r = _SHAPE[b], b.astype(np.uint64)
        shapes = (s[:-3] << np.uint64(16)) | (s[1:-2] << np.uint64(8)) | s[2:-1]
        grams = (r[:-3] << np.uint64(24)) | (r[1:-2] << np.uint64(16)) | (r[2:-1] << np.uint64(8)) | r[3:]
        for j, g in enumerate((shapes, grams)):
            slot = (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            out[j * size : (j + 1) * size] += np.bincount(slot.astype(np.int64), minlength=size)
    n = max(1.0, out[:size].sum())
    return np.sqrt(out / n).astype(np.float32)


@dataclass
class Ordinal:
    """Weights and thresholds of a fitted model of grades 0 to len(cuts)."""

    weights: np.ndarray
    cuts: np.ndarray
    bits: int

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k from 1, a row for each row of x."""
        return 1 / (1 + np.exp(-np.clip((x @ self.weights)[:, None] - self.cuts[None, :], -30, 30)))


def fit(x: np.ndarray, grade: np.ndarray, grades: int, bits: int, steps: int = 300, l2: float = 1e-4, rate: float = 0.05) -> Ordinal:
    """Adam on the mean negative log likelihood, thresholds kept in order by positive gaps."""
    w, base, gaps = np.zeros(x.shape[1]), -1.0, np.zeros(grades - 2)
    n, k = len(grade), grades - 1
    moment = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros(1), np.zeros(1)], [np.zeros_like(gaps), np.zeros_like(gaps)]]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        cuts = base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        below = np.concatenate([np.zeros((n, 1)), 1 / (1 + np.exp(-np.clip(cuts[None, :] - (x @ w.astype(np.float32))[:, None], -30, 30))), np.ones((n, 1))], axis=1)
        hi, lo = below[rows, grade + 1], below[rows, grade]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p  # of log p by the cut above and below
        g_w = x.T @ ((d_hi - d_lo) / n).astype(np.float32) + l2 * w
        g_cut = np.array([(d_lo * (grade == j + 1)).sum() - (d_hi * (grade == j)).sum() for j in range(k)]) / n
        g_gap = np.array([g_cut[j + 1 :].sum() * np.exp(gaps[j]) for j in range(k - 1)])
        new = []
        for value, g, m in ((w, g_w, moment[0]), (np.array([base]), np.array([g_cut.sum()]), moment[1]), (gaps, g_gap, moment[2])):
            m[0], m[1] = 0.9 * m[0] + 0.1 * g, 0.999 * m[1] + 0.001 * g * g
            new.append(value - rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8))
        w, base, gaps = new[0], float(new[1][0]), new[2]
    return Ordinal(w.astype(np.float32), base + np.concatenate([[0.0], np.cumsum(np.exp(gaps))]), bits)


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample_rows: int = 3000, bits: int = 12) -> Ordinal | None:
    """A model from the `sample_rows` rated documents that come first by hash; None where there are under two grades.

    ratings: doc_id, grade (0 to grades - 1; others and nulls are passed over; of two
    grades for one document the lower holds). The sample is the documented bound of what
    goes to the driver: sample_rows sparse rows, fitted in one order, so reruns agree; of
    rows with one doc_id the least text stands for all.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                x = features(t, bits)
                at = np.flatnonzero(x)
                rows.append((at.astype(np.uint16).tobytes(), x[at].tobytes()))
            at, value = list(zip(*rows, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([b.column("grade"), pa.array(at, pa.binary()), pa.array(value, pa.binary())], ["grade", "at", "value"])

    rated = ratings.select("doc_id", F.col("grade").cast("int").alias("grade")).where(F.col("grade").between(0, grades - 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = F.broadcast(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    got = texts(docs).join(chosen, "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade").mapInArrow(each, "grade int, at binary, value binary").collect()
    got.sort(key=lambda r: (r["grade"], r["at"], r["value"]))
    y = np.array([r["grade"] for r in got], int)
    if len(set(y.tolist())) < 2:
        return None
    x = np.zeros((len(got), 2 << bits), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float32)
    return fit(x, y, grades, bits)


def score(docs: DataFrame, model: Ordinal | None, least_grade: int = 1, least_tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail, accepted) per row of docs (doc_id, text).

    tail: P(grade >= least_grade); accepted: tail >= least_tail. Null and empty texts
    have no features and get what the thresholds alone say. Without a model (no ratings
    of two grades) the scores are null and all is accepted. Repeated rows stay; an empty
    table gives an empty result. Other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                none = [None] * b.num_rows
                columns = [pa.array(none, pa.float64()), pa.array(none, pa.float64()), pa.array([True] * b.num_rows, pa.bool_())]
            else:
                f = np.array([features(t.as_py(), model.bits) @ model.weights for t in b.column(1)], np.float64)
                t = 1 / (1 + np.exp(-np.clip(f[:, None] - model.cuts[None, :], -30, 30)))
                tail = t[:, least_grade - 1]
                columns = [pa.array(t.sum(1)), pa.array(tail), pa.array(tail >= least_tail)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "expected_grade", "tail", "accepted"])

    return texts(docs).mapInArrow(each, f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, tail double, accepted boolean")


def label_grades(labels: DataFrame) -> DataFrame:
    """Ratings from quality and toxic marks: 0 low quality, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
