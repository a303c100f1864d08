"""Hard-negative mining by blocked dense products.

Components become whole numbers (``vectors.scaled``), so that products in float64 are exact while their sums stay below 2 ** 53;
a table that could exceed it raises ValueError.  Anchors are cut into blocks of a bounded size.  A block is broadcast and
multiplied with all candidates, batch by batch: the first pass keeps each anchor's best positives, the second the best
negatives inside the window that each positive sets.  Tasks keep bounded lists for each anchor of the block, and the lists merge by rank.

Rows with a null label, a null vector, or a null or non-finite component take no part.  Scores rank from high to low, then by ``vec_id``
(null last).  Repeated rows are rows of their own: a copy of an anchor is one of its positives, and a repeated anchor has
results of its own.  Shorter vectors count as filled up with zeros.  An empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm.common import sliced
from blockloom.llm.vectors import column, matrix, scaled
from blockloom.session import keep

POSITIVES, NEGATIVES = 5, 3
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Components of a block of anchors, and rows of the pieces that are multiplied at once.
BLOCK, PIECE, BATCH = 4 << 20, 512, 2048
EXACT = 2**53
NO_ID = np.iinfo(np.int64).max  # a null id, after all others
OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def prepared(embeddings: DataFrame) -> DataFrame:
    """``row, vec_id, label, v, largest`` of the rows that take part; ``row`` numbers them, ``largest`` is the greatest component without sign."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in sliced(batches, 8192):
            good, x = scaled(batch.column("embedding"))
            ids, labels = (batch.column(c).take(pa.array(good)) for c in ("vec_id", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(good))), ids, labels, column(x), pa.array(np.abs(x).max(axis=1, initial=0))], names=["row", "vec_id", "label", "v", "largest"])
            row += len(good)

    rows = embeddings.where("label is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return keep(moved.select("vec_id", "label", "embedding").mapInArrow(run, "row bigint, vec_id bigint, label bigint, v array<bigint>, largest bigint"), "vectors")


class Best:
    """The best candidates of many lists: score from high to low, then id."""

    def __init__(self, n: int, k: int) -> None:
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), NO_ID)

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Candidates in the order of ``ids`` for the lists ``at``: ``scores`` (lists by candidates; minus infinity: none) is used up."""
        k = self.scores.shape[1]
        top = scores.max(axis=1, initial=-np.inf)
        live = np.flatnonzero((top > -np.inf) & (top >= self.scores[at, -1]))
        if not len(live):
            return
        scores, at = scores[live], at[live]
        found_s, found_i = np.full((len(live), k), -np.inf), np.full((len(live), k), NO_ID)
        each = np.arange(len(live))
        for j in range(min(k, scores.shape[1])):
            c = scores.argmax(axis=1)  # the first of equals has the least id
            found_s[:, j], found_i[:, j] = scores[each, c], ids[c]
            scores[each, c] = -np.inf
        s, i = np.concatenate([self.scores[at], found_s], axis=1), np.concatenate([self.ids[at], found_i], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[at], self.ids[at] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)


def _table(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, ids, labels and vectors, in the order of ids."""
    row, ids, labels = (rows.column(c).fill_null(NO_ID).to_numpy() if isinstance(rows, pa.Table) else rows.column(c).fill_null(NO_ID).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label"))
    v = rows.column("v")
    x = matrix(v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v)
    order = np.argsort(ids, kind="stable")
    return row[order], ids[order], labels[order], x[order].astype(np.float64)


def _products(batches: Iterator[pa.RecordBatch], anchors: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces: numbers of anchors, ids of candidates in order, exact scores, whether labels are equal, whether both are the same row."""
    a_row, _, a_label, a = anchors
    for batch in sliced(batches, BATCH):
        row, ids, label, x = _table(batch)
        width = min(a.shape[1], x.shape[1])  # what one side lacks is zero
        for begin in range(0, len(a_row), PIECE):
            at = np.arange(begin, min(begin + PIECE, len(a_row)))
            yield at, ids, a[at, :width] @ x[:, :width].T, a_label[at, None] == label, a_row[at, None] == row


def best_positives(candidates: DataFrame, block: pa.Table, k: int) -> DataFrame:
    """``anchor`` (its row), ``positive_id, positive_score, place`` of the first ``k`` other rows of the anchor's label."""
    sent = candidates.sparkSession.sparkContext.broadcast(_table(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        best = Best(len(anchors[0]), k)
        for at, ids, scores, alike, same in _products(batches, anchors):
            scores[~alike | same] = -np.inf
            best.offer(at, scores, ids)
        who, which = np.nonzero(best.scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(anchors[0][who]), _ids(best.ids[who, which]), pa.array(best.scores[who, which].astype(np.int64))], names=["anchor", "positive_id", "positive_score"])

    found = candidates.mapInArrow(run, "anchor bigint, positive_id bigint, positive_score bigint")
    return _ranked(found, ["anchor"], "positive_score", "positive_id", k, "place")


def best_negatives(candidates: DataFrame, block: pa.Table, positives: pa.Table, k: int) -> DataFrame:
    """``anchor, place, negative_id, negative_score, rank`` of the first ``k`` rows of other labels inside each positive's window."""
    anchors = _table(block)
    lists = 1 + int(positives.column("place").to_numpy().max()) if len(positives) else 1
    windows = np.full((2, len(anchors[0]), lists), np.nan)
    by_row = np.argsort(anchors[0])
    who = by_row[np.searchsorted(anchors[0][by_row], positives.column("anchor").to_numpy())]
    place, score = (positives.column(c).to_numpy() for c in ("place", "positive_score"))
    windows[0, who, place], windows[1, who, place] = -(-LOW * score // 100), HIGH * score // 100
    sent = candidates.sparkSession.sparkContext.broadcast((anchors, windows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (low, high) = sent.value
        best = [Best(len(anchors[0]), k) for _ in range(lists)]
        for at, ids, scores, alike, _ in _products(batches, anchors):
            scores[alike] = np.nan
            for j in range(lists):
                inside = (scores >= low[at, j, None]) & (scores <= high[at, j, None])
                best[j].offer(at, np.where(inside, scores, -np.inf), ids)
        for j, b in enumerate(best):
            who, which = np.nonzero(b.scores > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(anchors[0][who]), pa.array(np.full(len(who), j, np.int32)), _ids(b.ids[who, which]), pa.array(b.scores[who, which].astype(np.int64))], names=["anchor", "place", "negative_id", "negative_score"])

    found = candidates.mapInArrow(run, "anchor bigint, place int, negative_id bigint, negative_score bigint")
    return _ranked(found, ["anchor", "place"], "negative_score", "negative_id", k, "rank", first=1)


def _ids(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _ranked(found: DataFrame, by: list[str], score: str, ident: str, k: int, name: str, first: int = 0) -> DataFrame:
    """The first ``k`` of each list; Spark cuts the lists before the shuffle, too."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(ident).asc_nulls_last())
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k).withColumn(name, (F.col(name) - 1 + first).cast("int"))


def blocks(anchors: DataFrame, block: int) -> Iterator[pa.Table]:
    """The stored anchors in blocks of at most ``block`` components, chosen by a hash of their rows."""
    size = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(1, block // max(size[1] or 1, 1))
    n = -(-2 * size[0] // most)  # half full in the mean
    for k in range(n):
        found = anchors.where(F.pmod(F.xxhash64("row"), F.lit(n)) == k).toArrow()
        for begin in range(0, len(found), most):
            yield found.slice(begin, most)


def mine(embeddings: DataFrame, is_anchor: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK) -> DataFrame:
    """For each anchor (``vec_id`` divisible by 50, or ``is_anchor``) and each of its positives the hardest negatives of the window."""
    spark = embeddings.sparkSession
    rows = prepared(embeddings)
    chosen = rows.where(F.col("vec_id") % 50 == 0 if is_anchor is None else is_anchor)
    bound = rows.agg(F.max("largest"), F.max(F.size("v"))).first()
    if bound[0] is not None and bound[1] * int(bound[0]) ** 2 >= EXACT:
        raise ValueError("components are too large for exact products in float64")
    made = []
    for table in blocks(chosen, block):
        near = keep(best_positives(rows, table, positives), "positives")
        far = best_negatives(rows, table, near.select("anchor", "place", "positive_score").toArrow(), negatives)
        ids = spark.createDataFrame(table.select(["row", "vec_id"]).rename_columns(["anchor", "anchor_id"]))
        made.append(keep(far.join(near, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"))
    return reduce(DataFrame.union, made) if made else spark.createDataFrame([], OUT)
