"""Packing of documents into sequences by cutting stock.

A document's ids are cut into pieces of at most ``capacity``; only the histogram
of piece lengths (rounded up to ``GRAIN``) goes to the driver, where column
generation (``cutting_stock``) turns it into patterns.  Pieces are then ranked
inside their length class, and each pattern serves a range of ranks, so that
sequences are assigned without gathering documents.

Defined cases: a null or empty text is the end id alone; documents of any length
are cut, none is dropped; repeated rows are packed as often as they come; an
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.llm import bpe, cutting_stock
from blockloom.llm.common import shuffle_partitions, sliced, texts
from blockloom.session import keep

CAPACITY, GRAIN, END_ID = 2048, 8, 1
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document; with ``keep_ids`` their ids too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe.word_bpe(path), np.array([END_ID], "<u4").tobytes()
        for b in sliced(batches, 1_000):
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, at, len(piece) // 4, zlib.crc32(piece), n, *([np.frombuffer(piece, "<i4")] if keep_ids else [])))
            for k in range(0, len(rows), 10_000):
                columns = [*zip(*rows[k : k + 10_000])]
                names = [f.split()[0] for f in PIECES.split(", ")]
                arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(c, pa.list_(pa.int32())) for c in columns[5:]]
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * keep_ids)

    return texts(docs).mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def assignments(histogram: dict[int, int], capacity: int, grain: int) -> list[tuple]:
    """For each length class the ranges of ranks and the sequences that they fill.

    Rows ``(cls, [(from_rank, to_rank, copies, first_sequence, first_slot)])``:
    rank ``r`` of a range goes to sequence ``first_sequence + (r - from_rank) div
    copies`` and slot ``first_slot + (r - from_rank) mod copies``.
    """
    sizes = np.array(sorted(histogram), np.int64)
    ranges, used, sequence = {int(s): [] for s in sizes}, {int(s): 0 for s in sizes}, 0
    for pattern, times in cutting_stock.solve(sizes, np.array([histogram[int(s)] for s in sizes], np.int64), capacity // grain):
        slot = 0
        for k in np.flatnonzero(pattern):
            s, copies = int(sizes[k]), int(pattern[k])
            ranges[s].append((used[s], used[s] + copies * times, copies, sequence, slot))
            used[s] += copies * times
            slot += copies
        sequence += times
    return [(s, r) for s, r in ranges.items()]


def place(cut: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces.

    ``cut`` is read twice: give it a stored table.  The histogram has at most
    ``capacity / grain`` rows.  Ranks are counted inside (class, salt) groups and
    shifted by the groups before, so that a class with many pieces isn't gathered.
    """
    spark = cut.sparkSession
    shares = 4 * shuffle_partitions(spark)
    cut = cut.withColumn("cls", F.ceil(F.col("length") / grain).cast("int")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shares)).cast("int"))
    counts = cut.groupBy("cls", "salt").agg(F.count("*").alias("n"))
    before = counts.select("cls", "salt", (F.sum("n").over(Window.partitionBy("cls").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r["cls"]: r["n"] for r in cut.groupBy("cls").agg(F.count("*").alias("n")).collect()}
    schema = "cls int, ranges array<struct<a: bigint, b: bigint, copies: bigint, sequence: bigint, slot: bigint>>"
    table = F.broadcast(spark.createDataFrame(assignments(histogram, capacity, grain), schema))  # a row per class
    rank = F.row_number().over(Window.partitionBy("cls", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = cut.withColumn("rank", rank).join(before, ["cls", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    ranked = ranked.join(table, "cls").withColumn("range", F.element_at(F.filter("ranges", lambda r: (r["a"] <= F.col("rank")) & (F.col("rank") < r["b"])), 1))
    j = F.col("rank") - F.col("range.a")
    ranked = ranked.select(*[c for c in cut.columns if c not in ("cls", "salt")], (F.col("range.sequence") + F.expr("(rank - range.a) div range.copies")).alias("sequence_id"), (F.col("range.slot") + j % F.col("range.copies")).alias("slot"))
    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return ranked.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long")).drop("slot")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, grain: int = GRAIN, keep_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return place(keep(pieces(docs, path, capacity, keep_ids), "pieces"), capacity, grain)
