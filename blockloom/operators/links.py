"""Links between the rows of adjacent blocks, and the gaps between linked rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.align import wavefront
from blockloom.functions.scalars import reverse_complement
from blockloom.operators.columns import SHARD
from blockloom.operators.shards import block_starts, by_shard, with_halo
from blockloom.session import keep

#: Bases of a piece of a sequence, and pieces of a batch.
PIECE, PIECES = 1 << 13, 1 << 10


def block_ordinals(rows: DataFrame) -> DataFrame:
    """``block_id, ordinal``: dense numbers of the blocks, counted inside shards and shifted."""
    blocks = rows.select("block_id").distinct().withColumn("shard", F.expr(f"block_id div {SHARD}"))
    totals = blocks.groupBy("shard").agg(F.count("*").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # one record per shard
    rank = F.row_number().over(Window.partitionBy("shard").orderBy("block_id")) - 1
    return blocks.withColumn("rank", rank).join(before, "shard").select("block_id", (F.col("rank") + F.col("before")).alias("ordinal"))


def _follows(left: tuple, right: tuple) -> bool:
    """Whether a row (name, strand, start, end) may continue another: strand, order, then name."""
    return left[1] == right[1] and left[3] <= right[2] and left[0] == right[0]


def aligned(left: list[tuple], right: list[tuple], substitutions: bool = True) -> list[int | None]:
    """For each right row (name, strand, start, end) the left row that it is linked to, by an ordered alignment of both lists.

    A pair that isn't a predecessor is a substitution and counts as one edit, if allowed.
    """
    to: list[int | None] = [None] * len(right)
    for i, j in wavefront(left, right, _follows, 1, 1 if substitutions else 10**8):
        if i is not None and j is not None:
            to[j] = i
    return to


@lru_cache(maxsize=1 << 16)
def _paired(n: int, m: int, may: int, substitutions: bool) -> list[int]:
    """``aligned`` of ``n`` and ``m`` rows, of which ``i`` and ``j`` may be linked if bit ``i * m + j`` of ``may`` is set (-1: none)."""
    to = [-1] * m
    for i, j in wavefront(range(n), range(m), lambda i, j: may >> (i * m + j) & 1, 1, 1 if substitutions else 10**8):
        if i is not None and j is not None:
            to[j] = i
    return to


def _small_links(starts: np.ndarray, blocks: np.ndarray, rows: tuple[np.ndarray, ...], substitutions: bool) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``blocks`` and those that they are linked to, for blocks of at most 62 pairs with the rows of the block before; equal patterns are aligned once."""
    names, strand, begin, end = rows
    n, m = starts[blocks] - starts[blocks - 1], starts[blocks + 1] - starts[blocks]
    at = np.cumsum(n * m) - n * m
    of = np.repeat(np.arange(len(blocks)), n * m)
    inner = np.arange(len(of)) - at[of]
    l, r = starts[blocks - 1][of] + inner // m[of], starts[blocks][of] + inner % m[of]
    may = (names[l] == names[r]) & (strand[l] == strand[r]) & (end[l] <= begin[r])
    patterns, which = np.unique(np.stack([n, m, np.bitwise_or.reduceat(may.astype(np.int64) << inner, at)]), axis=1, return_inverse=True)
    found = np.full((patterns.shape[1], int(m.max())), -1)
    for k, (i, j, bits) in enumerate(patterns.T.tolist()):
        found[k, :j] = _paired(i, j, bits, substitutions)
    mine = np.repeat(np.arange(len(blocks)), m)
    column = np.arange(len(mine)) - (np.cumsum(m) - m)[mine]
    to = found[which.ravel()[mine], column]
    return starts[blocks][mine] + column, np.where(to < 0, -1, starts[blocks - 1][mine] + to)


def shard_links(table: pa.Table, how: str = "diff") -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of a shard the place of the row that it is linked to (-1: none), whether its whole block pairs one to one, and where the shard's own rows begin.

    ``how``: ``diff`` and ``exact`` align the lists, with substitutions and without, where rows don't pair one to one; ``index`` takes the row of the same index.
    """
    starts, halo = block_starts(table)
    n = len(table)
    names = table.column("sequence_name").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    strand = table.column("strand").to_numpy().astype(np.int8)
    begin = table.column("start").to_numpy()
    end = begin + table.column("length").to_numpy()
    sizes = np.diff(starts)
    block = np.repeat(np.arange(len(sizes)), sizes)
    first, size_before = np.append(-1, starts[:-2]), np.append(0, sizes[:-1])
    inside = np.arange(n) - starts[block]
    same = np.where(inside < size_before[block], first[block] + inside, -1)  # the row of the same index in the block before
    ok = (same >= 0) & (names[same] == names) & (strand[same] == strand) & (end[same] <= begin)
    fast = np.logical_and.reduceat(ok, starts[:-1]) & (sizes == size_before) if n else np.zeros(0, bool)
    left = same.copy()
    if how != "index":
        left[~fast[block]] = -1
        odd = np.flatnonzero(~fast)
        odd = odd[odd > 0]
        small = size_before[odd] * sizes[odd] <= 62
        if small.any():
            here, to = _small_links(starts, odd[small], (names, strand, begin, end), how == "diff")
            left[here] = to
        for b in odd[~small].tolist():
            lo, mid, hi = starts[b - 1 : b + 2].tolist()
            rows = [*zip(*(x[lo:hi].tolist() for x in (names, strand, begin, end)))]
            left[mid:hi] = [-1 if i is None else lo + i for i in aligned(rows[: mid - lo], rows[mid - lo :], how == "diff")]
    return left, fast[block], int(starts[halo])


LINKED = "block_id bigint, row_index bigint, sequence_name string, start bigint, length bigint, strand boolean, sequence_length bigint, l_block_id bigint, l_row_index bigint, l_end bigint, ok boolean, fast boolean"


def linked(rows: DataFrame, how: str = "diff") -> DataFrame:
    """Each row with the row of the block before that it is linked to (``l_block_id, l_row_index``, its end ``l_end``; null: none), whether it continues that row
    (``ok``), and whether its whole block continues the one before row by row (``fast``).  One pass over shards with halos; ``how`` as in ``shard_links``.
    """
    own = ["block_id", "row_index", "sequence_name", "start", "length", "strand", "sequence_length"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_shard(batches):
            left, fast, begin = shard_links(table, how)
            at = pa.array(np.maximum(left, 0), mask=left < 0)
            before = table.take(at)
            end = pc.add(before.column("start"), before.column("length"))
            ok = pc.and_(pc.and_(pc.equal(before.column("strand"), table.column("strand")), pc.less_equal(end, table.column("start"))), pc.equal(before.column("sequence_name"), table.column("sequence_name")))
            out = table.select(own).append_column("l_block_id", before.column("block_id")).append_column("l_row_index", before.column("row_index"))
            out = out.append_column("l_end", end).append_column("ok", pc.fill_null(ok, False)).append_column("fast", pa.array(fast))
            yield from out.slice(begin).to_batches(max_chunksize=10_000)

    return with_halo(rows.select(*own)).mapInArrow(run, LINKED)


def fast_links(rows: DataFrame) -> DataFrame:
    """``block_id, row_index, l_block_id, l_row_index`` of the blocks whose rows continue those before one to one."""
    return linked(rows, "index").where("fast").select("block_id", "row_index", "l_block_id", "l_row_index")


def diff_links(rows: DataFrame, substitutions: bool = True) -> DataFrame:
    """``block_id, row_index, l_row_index`` (null: inserted) by an ordered alignment of the two row lists.

    Rows may pair only in order; a pair that isn't a predecessor is a substitution and counts as one edit, if allowed.
    Lists that pair one to one are linked so without an alignment, which is the only one without edits.
    """
    return linked(rows, "diff" if substitutions else "exact").select("block_id", "row_index", "l_row_index")


def _pairs(rows: DataFrame, same_index: bool) -> DataFrame:
    return linked(rows, "index" if same_index else "diff").withColumn("gap", F.when(F.col("ok"), F.col("start") - F.col("l_end")))


def common_rows(rows: DataFrame, same_index: bool = False) -> DataFrame:
    """``block_id, common, max_gap`` for each block: how many rows continue the row before that they are linked to, and the widest gap.

    ``same_index`` takes the row of the same index instead of the linked one, which is exact where no row comes or goes.
    """
    both = _pairs(rows, same_index).groupBy("block_id").agg(F.sum(F.col("ok").cast("long")).alias("common"), F.max("gap").alias("max_gap"))
    return both.select("block_id", "common", F.coalesce("max_gap", F.lit(0)).alias("max_gap"))


def gap_lengths(rows: DataFrame, same_index: bool = False) -> DataFrame:
    """``block_id, row_index, gap`` between each row and the one it continues; ``same_index`` as in ``common_rows``."""
    return _pairs(rows, same_index).where("ok").select("block_id", "row_index", "gap")


def sequence_pieces(sequences: DataFrame) -> DataFrame:
    """``name, piece, seq``: ``name, seq`` cut into pieces of ``PIECE`` bases, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, seq in zip(b.column("name"), b.column("seq")):
                name, seq = name.as_py(), seq.as_py() or ""
                for at in range(0, len(seq), PIECE * PIECES):
                    some = [seq[k : k + PIECE] for k in range(at, min(at + PIECE * PIECES, len(seq)), PIECE)]
                    numbers = np.arange(at // PIECE, at // PIECE + len(some), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(numbers), pa.array(some, pa.string())], names=["name", "piece", "seq"])

    return sequences.select("name", "seq").mapInArrow(run, "name string, piece bigint, seq string")


def gap_bases(rows: DataFrame, sequences: DataFrame, most: int = 50, same_index: bool = False, made: str = "seq") -> DataFrame:
    """``block_id, row_index, left_gap_sequence``: the bases between linked rows, from ``name, seq``; null where there are none to give.

    ``most`` caps the gap (-1: no cap); ``same_index`` as in ``common_rows``.  On the - strand the bases are those of the reverse complement.
    Sequences are cut into pieces of ``PIECE`` bases, or come so as ``name, piece, seq``; a gap meets the pieces that it touches, and parts of one in several are put together.
    ``made`` gives the bases of a piece from its columns; it is evaluated for the pieces that gaps touch.  Plans tell little of the size of pieces, so they are never broadcast.
    """
    wanted = _pairs(rows, same_index).where((F.col("gap") > 0) & (F.lit(most < 0) | (F.col("gap") <= most)))
    begin = F.when(F.col("strand"), F.col("l_end")).otherwise(F.col("sequence_length") - F.col("start"))  # on the + strand
    wanted = keep(wanted.select("block_id", "row_index", "sequence_name", "strand", begin.alias("begin"), (begin + F.col("gap")).alias("end")), "gaps")
    first, last = F.expr(f"greatest(begin, 0) div {PIECE}"), F.expr(f"(greatest(end, 1) - 1) div {PIECE}")
    met = wanted.withColumn("first", first).withColumn("last", last).withColumn("at", F.explode(F.sequence("first", F.greatest("first", "last"))))
    cut = "piece" in sequences.columns
    pieces, known = sequences if cut else sequence_pieces(sequences), sequences.where("piece = 0" if cut else "seq is not null").select(F.col("name").alias("known"))
    met = met.join(pieces.hint("merge"), (F.col("sequence_name") == F.col("name")) & (F.col("at") == F.col("piece")), "left")
    low, high = F.greatest(F.col("begin") - F.col("at") * PIECE, F.lit(0)), F.least(F.col("end") - F.col("at") * PIECE, F.lit(PIECE))
    part = F.substring(F.expr(made), (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    met = met.select("block_id", "row_index", "sequence_name", "strand", "at", (F.col("first") < F.col("last")).alias("several"), part.alias("part"))
    whole = met.where("several").groupBy("block_id", "row_index", "sequence_name", "strand").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("parts"), F.count("part").alias("n"))
    whole = whole.select("block_id", "row_index", "sequence_name", "strand", F.when(F.col("n") > 0, F.array_join(F.transform("parts", lambda x: x["part"]), "")).alias("part"))
    found = met.where("not several").select("block_id", "row_index", "sequence_name", "strand", "part").unionByName(whole).join(known, F.col("sequence_name") == F.col("known"), "left")
    bases = F.coalesce("part", F.when(F.col("known").isNotNull(), ""))  # beyond the end there are none
    return found.select("block_id", "row_index", F.when(F.col("strand"), bases).otherwise(reverse_complement(bases)).alias("left_gap_sequence"))
