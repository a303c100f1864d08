"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-case terms, hashed into ``2 ** BITS`` buckets.
The buckets that tell the classes apart best in the labelled sample are the
features; each has a linear weight and a factor vector, so that the product of
two factors scores a pair of terms that appear together.  Training is full-batch
Adam on the logistic loss, on the driver, over a sample of at most about
``MOST_ROWS`` labelled rows; every whole text is scored.

Defined cases: a null or empty text has no terms and gets the bias alone; without
labelled rows of both classes the score is the smoothed share of label 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import labelled
from blockloom.llm.common import fold, texts

BITS, FEATURES, FACTORS, EPOCHS, MOST_ROWS, LEAST_DOCS = 20, 1024, 8, 200, 20_000, 3
PUNCTUATION = {ord(c): " " for c in ".,;:!?\"'()[]{}<>*#$%&|/\\-_=+~^`@«»¿¡„“”…–—"}


def term_hashes(text: str) -> list[int]:
    """Buckets of the distinct terms of a text."""
    return list({zlib.crc32(t.encode("utf-8", "replace")) & (1 << BITS) - 1 for t in set(text.lower().translate(PUNCTUATION).split())})


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values`` between ``starts`` (empty stretches give 0)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[starts[1:]] - total[starts[:-1]]


@dataclass
class Machine:
    """A factorization machine over the sorted ``buckets``."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def features(self, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.fromiter((h for d in docs for h in d), np.int64)
        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        owner = np.repeat(np.arange(len(docs)), lengths)
        at = np.searchsorted(self.buckets, flat)
        hit = at < len(self.buckets)
        hit[hit] = self.buckets[at[hit]] == flat[hit]
        return at[hit], np.concatenate([[0], np.cumsum(np.bincount(owner[hit], minlength=len(docs)))]).astype(np.int64)

    def margin(self, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = self.factors[at]
        s = sums(v, starts)
        pairs = 0.5 * ((s**2).sum(axis=1) - sums((v**2).sum(axis=1), starts))
        return self.bias + sums(self.weights[at], starts) + pairs, s

    def score(self, docs: list[list[int]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.features(docs))[0], -30, 30)))


def informative(docs: list[list[int]], y: np.ndarray, features: int, least_docs: int) -> np.ndarray:
    """Sorted buckets with the largest chi-square statistic against the label."""
    flat = np.fromiter((h for d in docs for h in d), np.int64)
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    names, inverse = np.unique(flat, return_inverse=True)
    seen = np.bincount(inverse, minlength=len(names)).astype(float)
    positive = np.bincount(inverse, weights=y[owner], minlength=len(names))
    n, p = len(y), y.mean()
    expected = seen * p
    chi = (positive - expected) ** 2 / np.maximum(expected * (1 - p) * (1 - seen / (n + 1)), 1e-12)
    chi[seen < least_docs] = -1
    best = np.argsort(-chi, kind="stable")[:features]
    return np.sort(names[best[chi[best] > 0]])


def fit(docs: list[list[int]], y: np.ndarray, features: int = FEATURES, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Train on sets of buckets and labels of 0 and 1."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(p / (1 - p)))
    if len(y) == 0 or y.min() == y.max():
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, factors)))
    buckets = informative(docs, y.astype(float), features, LEAST_DOCS if len(y) > 500 else 1)
    rng = np.random.default_rng(seed)
    m = Machine(buckets, bias, np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), factors)))
    at, starts = m.features(docs)
    owner = np.repeat(np.arange(len(docs)), np.diff(starts))
    params = {"weights": m.weights, "factors": m.factors}
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in params.items()}
    for step in range(1, epochs + 1):
        z, s = m.margin(at, starts)
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        m.bias -= rate * 5 * g.sum()
        grad_v = np.zeros_like(m.factors)
        each = g[owner][:, None] * (s[owner] - m.factors[at])
        for k in range(factors):
            grad_v[:, k] = np.bincount(at, weights=each[:, k], minlength=len(buckets))
        grads = {"weights": np.bincount(at, weights=g[owner], minlength=len(buckets)), "factors": grad_v}
        for name, value in params.items():
            grad = grads[name] + decay * value / len(y)
            a, b = moments[name]
            a += 0.1 * (grad - a)
            b += 0.001 * (grad**2 - b)
            value -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return m


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Machine:
    """Fit on labelled rows outside of the held-out fold (crc32 of the id mod 5 is 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([term_hashes(t) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))], names=["y", "terms"])

    rows = labelled.sample(texts(docs), labels, "toxic", fold(F.col("doc_id"), 5) != 0, most_rows).select("y", "text").mapInArrow(run, "y int, terms array<int>").toArrow()
    return fit([t for t in rows.column("terms").to_pylist()], np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    machine = train(docs, labels, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = machine.score([term_hashes(t) for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
