"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Components become whole numbers (``vectors.scaled``).  A vector is cut into ``PARTS`` equal parts, each with a codebook of its own; the codebooks start
as the parts of the first ``ENTRIES`` vectors in the order of ``vec_id`` (null last; rows of an id by their components), and ``ROUNDS`` rounds of assignment
and means follow.  All distances are exact.  The entries of a codebook are sorted by norm.  An entry nearer to a part than a distance ``d`` has a norm
within ``d`` of the part's norm, so only that annulus, borders included, is evaluated; it is narrowed again by binary search whenever ``d`` has shrunk.

Vectors shorter than the longest count as filled up with zeros, and the common length is rounded up to a multiple of ``PARTS``.
With fewer vectors than entries all of them are entries; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import bounded_broadcast, sliced
from blockloom.llm.vectors import scaled
from blockloom.session import keep

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Differences stay below this, so that squared distances of whole vectors fit 64 bits.
FURTHEST = 1 << 28
#: Totals per label are broadcast up to so many labels.
MOST_LABELS = 100_000


@dataclass
class Annuli:
    """One part's codebook, sorted by norm."""

    entries: np.ndarray  # in the order of the codebook
    order: np.ndarray
    norms: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Annuli:
        norms = np.sqrt((entries.astype(np.float64) ** 2).sum(axis=1))
        order = np.argsort(norms, kind="stable")
        return cls(entries, order, norms[order])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of ``x`` (of equally near ones that of the least index) and its squared distance."""
        n = len(self.order)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        start = np.minimum(np.searchsorted(self.norms, norm), n - 1)
        best = self.order[start]
        least = ((x - self.entries[best]) ** 2).sum(axis=1)
        # entries are visited alternately below and above the start, while the side lies in the annulus
        for side in (-1, 1):
            live = np.arange(len(x))
            at = start.copy()
            while len(live):
                at[live] += side
                live = live[(at[live] >= 0) & (at[live] < n)]
                reach = np.sqrt(least[live].astype(np.float64))
                edge = norm[live] + side * reach
                slack = 1e-9 * (1 + norm[live] + reach)  # the border belongs to the annulus, however roots are rounded
                last = np.searchsorted(self.norms, edge - slack, "left") if side < 0 else np.searchsorted(self.norms, edge + slack, "right") - 1
                live = live[at[live] >= last if side < 0 else at[live] <= last]
                e = self.order[at[live]]
                d = ((x[live] - self.entries[e]) ** 2).sum(axis=1)
                nearer = (d < least[live]) | (d == least[live]) & (e < best[live])
                hit = live[nearer]
                least[hit], best[hit] = d[nearer], e[nearer]
        return best, least


def fitted(x: np.ndarray, width: int) -> np.ndarray:
    """Rows filled up to ``width`` components and checked to be exact in 64 bits."""
    if np.abs(x).max(initial=0) >= FURTHEST:
        raise ValueError("a component is too large for exact squared distances of 64 bits")
    return np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x


def coded(x: np.ndarray, books: list[Annuli]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances of the parts, both rows by parts."""
    cut = x.shape[1] // len(books)
    found = [book.nearest(x[:, p * cut : (p + 1) * cut]) for p, book in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in sliced(batches, 8192):
        good, x = scaled(batch.column("embedding"))
        yield batch, good, x


def first_vectors(rows: DataFrame, entries: int) -> tuple[np.ndarray, int]:
    """The first ``entries`` vectors in order, and the length of the longest of all (0: there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, width = [], 0
        for batch, good, x in _batches(batches):
            ids = np.array(batch.column("vec_id").to_pylist(), object)[good]
            width = max(width, x.shape[1])
            if len(good) > entries:  # only rows that can be among the first need an order by components
                key = np.array([np.inf if i is None else i for i in ids], float)
                near = np.flatnonzero(key <= np.partition(key, entries - 1)[entries - 1])
                ids, x = ids[near], x[near]
            least += zip(ids.tolist(), x.tolist())
            least = sorted(least, key=_order)[:entries]
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in least], pa.int64()), pa.array([v for _, v in least], pa.list_(pa.int64())), pa.array([width] * len(least), pa.int64())], names=["vec_id", "v", "width"])

    stored = keep(rows.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, v array<bigint>, width bigint"), "first-vectors")
    width = stored.agg(F.max("width")).first()[0] or 0
    found = stored.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    out = np.zeros((len(found), width), np.int64)
    for k, r in enumerate(found):
        out[k, : len(r.v)] = r.v
    return out, width


def _order(row: tuple[int | None, list[int]]) -> tuple:
    return row[0] is None, row[0] or 0, row[1]


def means(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks (parts, entries, components) after a round: floors of the means of the parts assigned to each entry; unused entries stay."""
    parts, entries, cut = books.shape
    annuli = [Annuli.of(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, cut), np.int64), np.zeros((parts, entries), np.int64)
        for _, _, x in _batches(batches):
            x = fitted(x, parts * cut)
            codes, _ = coded(x, annuli)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(sums[p], codes[:, p], x[:, p * cut : (p + 1) * cut])
        p, e = np.nonzero(counts)
        at = [np.repeat(k, cut).astype(np.int32) for k in (p, e)] + [np.tile(np.arange(cut, dtype=np.int32), len(p))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(sums[p, e].reshape(-1)), pa.array(np.repeat(counts[p, e], cut))], names=["part", "entry", "at", "total", "n"])

    summed = rows.select("embedding").mapInArrow(run, "part int, entry int, at int, total bigint, n bigint").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.copy()
    for r in summed.collect():  # as many rows as the codebooks have components
        out[r.part, r.entry, r.at] = r.total // r.n
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in the order of part, entry, place."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """The codebooks of ``rows``; None if no row has a vector that counts."""
    first, width = first_vectors(rows, entries)
    if not len(first):
        return None
    cut = max(1, -(-width // parts))
    first = np.pad(first, ((0, 0), (0, parts * cut - width)))
    books = np.ascontiguousarray(first.reshape(len(first), parts, cut).transpose(1, 0, 2))
    for _ in range(rounds):
        books = means(rows, books)
    return books


def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of the rows whose vectors count."""
    parts, _, cut = books.shape
    annuli = [Annuli.of(b) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, good, x in _batches(batches):
            codes, errors = coded(fitted(x, parts * cut), annuli)
            text = codes.astype(np.uint8).tobytes().hex()
            width = 2 * parts
            kept = [batch.column(c).take(pa.array(good)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([text[k : k + width] for k in range(0, len(text), width)], pa.string()), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, "vec_id bigint, label bigint, code string, error bigint")


def compress(embeddings: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each vector that counts.

    A label's errors are summed in parts before the shuffle and joined back; null labels count as one label.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("long").alias("label"))
    books = trained(rows)
    if books is None:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    found = keep(assigned(rows, books), "codes")
    totals = bounded_broadcast(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), MOST_LABELS)
    return found.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
