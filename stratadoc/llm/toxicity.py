"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are the first six letters of words; every term of every example is indexed. A
term's weight is (1 + log tf) * idf * (1 + relevance), where relevance, |log odds ratio| *
max(|z| - 2, 0) of the term's share in the examples of label 1 against label 0, is zero
for terms that say nothing about the label. Plain weights leave the neighbours to the
many words of no meaning for the label (README, figures).

The examples' postings are kept by term: of terms in many examples in blocks of examples,
each with its greatest weight, of the others as lists. A search adds up the lists, and
for every block the query's weights times those maxima; the blocks with the greatest
sums are scored first, then all others whose sum reaches the k-th best similarity
found, so the result is the exact nearest k. Their votes, weighted
by similarity, are calibrated by centred isotonic regression over the examples' own
votes, each example left out of its own search and of its own terms' counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import texts

#: A term: a word's letters, the first six of them.
_TERM = re.compile(r"([^\W\d_]{1,6})[^\W\d_]*")
_BLOCK = 64
_FIRST = 4  # blocks that are scored before the others are judged by their bound
_OFTEN = 16  # a term that one in so many examples holds has postings in whole blocks


def doc_terms(text: str) -> Counter:
    """How often each term occurs in a text."""
    return Counter(_TERM.findall(text.lower()))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, end), one range after the other."""
    n = end - start
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def weights(n: np.ndarray, n1: np.ndarray, all_n: float, all_n1: float) -> np.ndarray:
    """idf * (1 + relevance) of terms held by n of all_n examples, n1 of them among the all_n1 of label 1."""
    p1, p0 = (n1 + 0.5) / (all_n1 + 1.0), (n - n1 + 0.5) / (all_n - all_n1 + 1.0)
    pooled = (n + 1.0) / (all_n + 2.0)
    z = (p1 - p0) / np.sqrt(pooled * (1 - pooled) * (1 / max(all_n1, 1) + 1 / max(all_n - all_n1, 1)))
    return (np.log((1 + all_n) / (1 + n)) + 1) * (1 + np.abs(np.log(p1 / p0)) * np.maximum(np.abs(z) - 2, 0))


class Examples:
    """Labelled examples with a block-max inverted index over all their terms."""

    def __init__(self, ids: list, terms: list[Counter], labels: np.ndarray, k: int = 15, prior: float = 0.1, shrink: float = 0.1):
        self.k, self.prior, self.shrink = k, prior, shrink
        self.steps = (np.zeros(0), np.zeros(0))
        self.term = {t: i for i, t in enumerate(sorted(set().union(*terms)))}
        counts = [self._counts(c) for c in terms]
        self.all_n, self.all_n1 = len(ids), float(np.sum(labels))
        flat = np.concatenate([a for a, _ in counts]) if counts else np.zeros(0, np.int64)
        y = np.repeat(np.asarray(labels, np.float64), [len(a) for a, _ in counts])
        self.n = np.bincount(flat, minlength=len(self.term)).astype(np.float64)
        self.n1 = np.bincount(flat, y, minlength=len(self.term))
        self.weight = weights(self.n, self.n1, self.all_n, self.all_n1)
        self._index(ids, [self._unit(a, n, self.weight[a]) for a, n in counts], np.asarray(labels, np.float64))

    def _counts(self, terms: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, how often each occurs) of a text's known terms."""
        at = np.fromiter((self.term.get(t, -1) for t in terms), np.int64, len(terms))
        n = np.fromiter(terms.values(), np.float64, len(terms))
        return at[at >= 0], n[at >= 0]

    @staticmethod
    def _unit(at: np.ndarray, n: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(n)) * weight
        return at, v / max(np.sqrt((v * v).sum()), 1e-12)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(term numbers, weights of length 1); none for a text without a known term."""
        at, n = self._counts(doc_terms(text))
        return self._unit(at, n, self.weight[at])

    def _index(self, ids: list, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> None:
        """Postings by term and block; examples stand in the order of their heaviest term that many hold, so that blocks are alike."""
        many = self.n * 20 >= self.all_n
        lead = [int(at[np.argmax(np.where(many[at], v, 0))]) if len(at) else -1 for at, v in vectors]
        order = sorted(range(len(ids)), key=lambda i: (lead[i], labels[i], str(ids[i])))
        self.ids, self.labels = [ids[i] for i in order], labels[order] if len(order) else labels
        self.place = {i: j for j, i in enumerate(order)}
        size = [len(vectors[i][0]) for i in order]
        doc = np.repeat(np.arange(len(order)), size)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        value = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        self.blocks = -(-len(order) // _BLOCK)
        # Postings of terms that many examples hold are whole blocks; those of the others are lists.
        often = np.flatnonzero(self.n * _OFTEN >= max(self.all_n, 1))
        self.row = np.full(len(self.term), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.table = np.zeros((self.blocks, len(often), _BLOCK), np.float32)
        row = self.row[term]
        full = row >= 0
        self.table[doc[full] // _BLOCK, row[full], doc[full] % _BLOCK] = value[full]
        self.most = np.ascontiguousarray(self.table.max(2).T) if self.blocks else np.zeros((len(often), 0), np.float32)
        doc, term, value = doc[~full], term[~full], value[~full]
        by = np.lexsort((doc, term))
        self.doc, self.value = doc[by].astype(np.int32), value[by].astype(np.float32)
        self.start = np.searchsorted(term[by], np.arange(len(self.term) + 1)).astype(np.int32)

    def nearest(self, at: np.ndarray, v: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, similarities) of the k nearest with a similarity over 0; ties go to the lower number."""
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        if not self.blocks or not len(at):
            return best_at, best
        row = self.row[at]
        full = row >= 0
        row, x, few = row[full], v[full].astype(np.float32), at[~full]
        s, e = self.start[few], self.start[few + 1]
        hold = _ranges(s, e)
        own = np.bincount(self.doc[hold], np.repeat(v[~full], e - s) * self.value[hold], minlength=self.blocks * _BLOCK).reshape(self.blocks, _BLOCK)
        bound = own.max(1) + x @ self.most[row]
        left = bound > 0
        while left.any():
            if len(best) < self.k:
                some = np.flatnonzero(left)
                go = some[np.argsort(-bound[some], kind="stable")[:_FIRST]]
            else:
                left &= bound >= best[-1] - 1e-5
                go = np.flatnonzero(left)
            left[go] = False
            got = own[go] + x @ self.table[go[:, None], row[None, :]]
            number = (go[:, None] * _BLOCK + np.arange(_BLOCK)).ravel()
            hit = (got.ravel() > 0) & (number != without)
            best_at, best = np.concatenate([best_at, number[hit]]), np.concatenate([best, got.ravel()[hit]])
            top = np.lexsort((best_at, -best))[: self.k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def vote(self, near: np.ndarray, similarity: np.ndarray) -> float:
        return float(((similarity * self.labels[near]).sum() + self.shrink * self.prior) / (similarity.sum() + self.shrink))

    def own_vote(self, number: int, terms: Counter, label: float) -> float:
        """The vote of an example that is itself left out: of the search, and of the counts that weigh its terms."""
        at, n = self._counts(terms)
        weight = weights(self.n[at] - 1, self.n1[at] - label, self.all_n - 1, self.all_n1 - label)
        return self.vote(*self.nearest(*self._unit(at, n, weight), without=number))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, share: np.ndarray) -> None:
        """Centred isotonic regression: pooled groups of votes, each at its mean, straight lines between them."""
        order = np.argsort(votes, kind="stable")
        groups: list[list[float]] = []  # sums of weighted votes, of weighted labels, of weights
        for v, y, w in zip(votes[order], labels[order], share[order], strict=True):
            if groups and groups[-1][0] == v * groups[-1][2]:
                groups[-1] = [groups[-1][0] + v * w, groups[-1][1] + y * w, groups[-1][2] + w]
            else:
                groups.append([v * w, y * w, w])
            while len(groups) > 1 and groups[-2][1] * groups[-1][2] >= groups[-1][1] * groups[-2][2]:
                a = groups.pop()
                groups[-1] = [x + z for x, z in zip(groups[-1], a, strict=True)]
        g = np.array(groups)
        if len(g):
            self.steps = (np.concatenate([[0.0], g[:, 0] / g[:, 2], [1.0]]), np.concatenate([g[:1, 1] / g[:1, 2], g[:, 1] / g[:, 2], g[-1:, 1] / g[-1:, 2]]))

    def score(self, near: np.ndarray, similarity: np.ndarray) -> float:
        """The calibrated vote; without neighbours the share of label 1."""
        if not len(near) or not len(self.steps[0]):
            return float(self.prior)
        return float(np.interp(self.vote(near, similarity), *self.steps))


def train(docs: DataFrame, labels: DataFrame, held_out: Column, examples: int = 4000, k: int = 15, calibration: int = 2000) -> Examples:
    """Index and calibration from labelled rows outside `held_out`.

    labels: doc_id, label (0 or 1; others and nulls are passed over; a document with
    both is of label 1). The documented bounds: of each label, the `examples` / 2 rows
    first by hash make the index and its counts, the `calibration` / 2 first the
    calibration. The terms of these alone reach the driver; of rows with one doc_id the
    least text stands for all.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("h", F.xxhash64("doc_id"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    rows = sum(totals.values())
    prior = totals.get(1, 0) / rows if rows else 0.5
    if len(totals) < 2:
        return Examples([], [], np.zeros(0), k, prior)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [doc_terms(x.as_py()) for x in b.column("text")]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), b.column("h"), pa.array([" ".join(c) for c in found], pa.string()), pa.array([np.array(list(c.values()), np.int32).tobytes() for c in found], pa.binary())],
                ["doc_id", "label", "h", "terms", "times"],
            )

    first = lambda y: known.where(F.col("label") == y).orderBy("h", "doc_id").limit(examples // 2)
    chosen = F.broadcast(first(1).unionByName(first(0)))  # `examples` rows of numbers
    got = texts(docs).join(chosen, "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).mapInArrow(terms, f"doc_id {dict(docs.dtypes)['doc_id']}, label int, h long, terms string, times binary").collect()
    got.sort(key=lambda r: (r["label"], r["h"], str(r["doc_id"]), r["terms"]))
    count = [Counter(dict(zip(r["terms"].split(), np.frombuffer(r["times"], np.int32).tolist(), strict=True))) for r in got]
    y = np.array([r["label"] for r in got], np.float64)
    if not 0 < y.sum() < len(y):  # labelled rows without a document
        return Examples([], [], np.zeros(0), k, prior)
    e = Examples([r["doc_id"] for r in got], count, y, k, prior)
    share = {c: totals[c] / (y == c).sum() for c in (0, 1)}  # rows that an example stands for
    some = np.concatenate([np.flatnonzero(y == c)[: calibration // 2] for c in (0, 1)])
    votes = np.array([e.own_vote(e.place[i], count[i], y[i]) for i in some])
    e.calibrate(votes, y[some], np.array([share[int(c)] for c in y[some]]))
    return e


def score(docs: DataFrame, examples: Examples, threshold: float = 0.3, evidence: int = 3) -> DataFrame:
    """(doc_id, score, predicted, evidence) per row of docs (doc_id, text).

    evidence: the nearest examples, each with its doc_id, similarity and label. Null and
    empty texts, and texts without a known term, have no neighbours and get the share of
    label 1. Repeated rows stay; an empty table gives an empty result. Other columns are
    ignored. Without labels of both kinds every score is the share of label 1, or 0.5.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(examples)  # bounded by the parameters of train()
    kind = dict(docs.dtypes)["doc_id"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = held.value
        for b in batches:
            scores, found = [], []
            for x in b.column(1):
                near, similarity = e.nearest(*e.vector(x.as_py()))
                scores.append(e.score(near, similarity))
                found.append([{"example": e.ids[i], "similarity": float(s), "label": int(e.labels[i])} for i, s in zip(near[:evidence], similarity[:evidence], strict=True)])
            s = pa.array(scores, pa.float64())
            shape = pa.list_(pa.struct([("example", b.column(0).type), ("similarity", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), s, pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(found, shape)], ["doc_id", "score", "predicted", "evidence"])

    return texts(docs).mapInArrow(each, f"doc_id {kind}, score double, predicted int, evidence array<struct<example: {kind}, similarity: double, label: int>>")
