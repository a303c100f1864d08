"""Shards of consecutive blocks, each with the last block of the shard before (its halo).

Whatever looks at neighbouring blocks runs inside shards, in one pass over sorted rows.  Which block is a shard's last is found from the ids
alone; it goes to two shards in the same shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.session import bounded_broadcast, keep

#: Block ids of a shard, and records of shards that are broadcast at most.
SHARD, MOST_SHARDS = 2_000, 200_000
#: Bytes of bases that are looked at together.
CELLS = 1 << 21


def with_halo(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """``rows`` with ``shard``, dealt and sorted by shard, block and row; the rows of a shard's last block stand in the next shard, too.

    ``n_before`` counts the blocks before the row's own shard.
    """
    of = F.expr(f"floor(block_id / {size})").cast("long")
    along = Window.orderBy("of")  # one record per shard
    shards = rows.where("row_index = 0").groupBy(of.alias("of")).agg(F.count("*").alias("n"), F.max("block_id").alias("last"))
    shards = keep(shards.select("of", "last", (F.sum("n").over(along) - F.col("n")).alias("n_before"), F.lead("of").over(along).alias("then")), "shards")
    met = rows.withColumn("of", of).join(bounded_broadcast(shards, MOST_SHARDS), "of")
    both = F.array_compact(F.array(F.col("of"), F.when(F.col("block_id") == F.col("last"), F.col("then"))))
    out = met.select(*rows.columns, "n_before", F.explode(both).alias("shard"))
    return out.repartition("shard").sortWithinPartitions("shard", "block_id", "row_index")


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard after the other."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        key = np.asarray(b.column("shard"))
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[-1].column("shard")[0].as_py() != key[lo]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def values(column: pa.Array | pa.ChunkedArray) -> list:
    """A column as Python values, without a step for each of them where numpy or a dictionary knows a shorter way."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count:
        return column.to_pylist()
    if pa.types.is_integer(column.type) or pa.types.is_boolean(column.type):
        return column.to_numpy(zero_copy_only=False).tolist()
    if pa.types.is_string(column.type):
        coded = column.dictionary_encode()
        known = coded.dictionary.to_pylist()
        return [known[k] for k in coded.indices.to_numpy(zero_copy_only=False).tolist()]
    return column.to_pylist()


def block_starts(table: pa.Table, size: int = SHARD) -> tuple[np.ndarray, int]:
    """Where the blocks of a shard begin, and its end at last; and how many of them (one or none) are its halo."""
    ids = table.column("block_id").to_numpy()
    starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    halo = int(ids[0] // size != table.column("shard")[0].as_py())
    return np.append(starts, len(ids)), halo


def by_block(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by block and sorted by block and row, for ``whole_blocks``."""
    return rows.repartition("block_id").sortWithinPartitions("block_id", "row_index", "sequence_name", "bases")


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of ``by_block`` as tables of whole blocks, with the places where blocks begin, and the table's end."""

    def found(held: list[pa.RecordBatch], more: bool) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column("block_id").combine_chunks()
        x, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (null[1:] != null[:-1])))
        return table, starts if more else np.append(starts, len(x))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        first, last = b.column("block_id")[0], b.column("block_id")[b.num_rows - 1]
        held.append(b)
        if first.as_py() == last.as_py():
            continue  # one block so far, or the end of the one before and nothing else
        table, starts = found(held, True)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts
        held = table.slice(starts[-1]).to_batches()
    if held:
        yield found(held, False)


def some_blocks(tables: Iterator[tuple[pa.Table, np.ndarray]]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of ``whole_blocks`` in parts of about ``CELLS`` bytes of bases, or of one block."""
    for table, starts in tables:
        cells = np.cumsum(pc.fill_null(pc.binary_length(table.column("bases")), 0).to_numpy())[starts[1:] - 1] // CELLS
        cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(starts[a], starts[b] - starts[a]).combine_chunks(), starts[a : b + 1] - starts[a]


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of a string column one after the other (a byte each, if all of them are in ASCII), and where each string begins, and the end."""
    column = column.fill_null("")
    begin = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None else np.zeros(0, np.uint8)
    if not len(text) or text.max() < 128:
        return text, begin - begin[0]
    wide = np.frombuffer(text.tobytes().decode().encode("utf-32-le"), np.uint32)
    return wide, np.append(0, np.cumsum(pc.utf8_length(column).to_numpy()))


def against(text: np.ndarray, begin: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells of rows (``characters``) where row ``ref`` of each has a base (no row: -1): the row, its character, the reference's, and how many reference bases stand before."""
    size = np.diff(begin)
    row = np.repeat(np.arange(len(size)), size)
    column = np.arange(len(text)) - begin[row]
    other = ref[row]
    here = (other >= 0) & (column < size[other])
    row, other, place, own = row[here], other[here], (begin[other] + column)[here], text[here]
    base = text != ord("-")
    here = base[place]
    ahead = np.append(0, np.cumsum(base))
    return row[here], own[here], text[place[here]], ahead[place[here]] - ahead[begin[other[here]]]


def strings(text: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The strings of ``characters`` that end at ``ends``."""
    if text.dtype == np.uint8:
        offsets = np.append(0, ends).astype(np.int32)
        return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text)))
    whole = np.ascontiguousarray(text, np.uint32).tobytes().decode("utf-32-le")
    return pa.array([whole[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())], pa.string())
