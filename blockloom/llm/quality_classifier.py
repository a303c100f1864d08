"""Quality by histogram gradient-boosted trees over document statistics.

The statistics describe a whole text (size, word and line repetition, shares of
byte classes); none of them depends on labels, language, source or id.  The
trees are fitted on the driver over a sample of at most about ``MOST_ROWS``
labelled rows and score every document.

Defined cases: a null or empty text has all statistics 0 and is scored like any
other; without labelled rows of both classes the score is the smoothed share of
label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm import boosting, labelled
from blockloom.llm.common import fold, sliced, texts

MOST_ROWS, CUTOFF = 20_000, 0.7
CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "blank": [32, *range(9, 14)],
    "stop": b".,;:?",
    "shout": b"!",
    "symbol": b"#*$%&|<>{}[]=+~^_\\/@",
    "control": [*range(0, 9), *range(14, 32), 127],
    "other": range(128, 256),
}
_OF_BYTE = np.zeros((256, len(CLASSES)))
for _i, _members in enumerate(CLASSES.values()):
    _OF_BYTE[list(_members), _i] = 1

WIDTH = 11 + len(CLASSES)


def statistics(text: str) -> np.ndarray:
    """The features of one text."""
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ _OF_BYTE / max(len(raw), 1)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    pairs = len(set(zip(words, words[1:])))
    used = counts[counts > 0] / max(len(raw), 1)
    letters = sum(map(len, words))
    lengths = [len(w) for w in set(words)]
    own = [
        np.log1p(len(text)),
        np.log1p(n),
        letters / max(n, 1),
        len(lengths) / max(n, 1),
        sum(lengths) / max(len(lengths), 1),
        max(lengths, default=0),
        pairs / max(n - 1, 1),
        np.log1p(len(lines)),
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        float(-(used * np.log(used)).sum()),
    ]
    return np.concatenate([own, shares])


def _features(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in sliced(batches, 2_000):
        rows = [statistics(t) for t in b.column("text").to_pylist()]
        yield b, np.array(rows) if rows else np.zeros((0, WIDTH))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> boosting.Forest:
    """Fit on labelled rows outside of the held-out fold (crc32 of the id mod 4 is 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _features(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = labelled.sample(texts(docs), labels, "quality", fold(F.col("doc_id"), 4) != 2, most_rows).select("y", "text").mapInArrow(run, "y int, x array<double>").toArrow()
    return boosting.fit(np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, WIDTH), np.array(rows.column("y").to_pylist(), float))


def score(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    forest = train(docs, labels, most_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _features(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(forest.score(x), pa.float64())], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def accepted(docs: DataFrame, forest: boosting.Forest) -> DataFrame:
    """The documents, with all their columns, whose score reaches ``CUTOFF``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2_000):
            rows = [statistics(t or "") for t in b.column("text").to_pylist()]
            if rows:
                yield b.filter(pa.array(forest.score(np.array(rows)) >= CUTOFF))

    return docs.mapInArrow(run, docs.schema)
