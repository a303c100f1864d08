"""Masks: bases that repeat the reference or the parent in a tree become ``*``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.rows import prefix_index
from blockloom.operators.shards import characters, some_blocks, strings, whole_blocks


def with_reference(rows: DataFrame, *columns: str) -> DataFrame:
    """Add ``ref_<column>`` of row 0 to every row of its block, in one pass over the block."""
    w = Window.partitionBy("block_id")
    for c in columns:
        rows = rows.withColumn(f"ref_{c}", F.max(F.when(F.col("row_index") == 0, F.col(c))).over(w))
    return rows


def mask_reference(rows: DataFrame, mask: str = "*") -> DataFrame:
    """Characters equal to the reference's, gaps included, become ``mask`` outside of row 0."""
    rows = with_reference(rows, "bases")
    same: Column = F.array_join(F.zip_with(F.split("bases", ""), F.split("ref_bases", ""), lambda b, r: F.when(b == r, mask).otherwise(b)), "")
    return rows.withColumn("bases", F.when(F.col("row_index") == 0, F.col("bases")).otherwise(same)).drop("ref_bases")


def mask(rows: DataFrame, reference: bool = False, parent_of: dict[str, str | None] | None = None) -> DataFrame:
    """The mask that is asked for: by the reference, else by the parents in a tree, else none."""
    if reference:
        return mask_reference(rows)
    return rows if parent_of is None else mask_lineage(rows, parent_of)


def mask_lineage(rows: DataFrame, parent_of: dict[str, str | None], mask: str = "*") -> DataFrame:
    """Bases equal, but for case, to any row of the parent node become ``mask``.

    ``parent_of`` maps node labels (name prefixes) to their parents; a root has none.
    """
    if len(mask) != 1:
        raise ValueError("a mask is one character")
    labels = list(parent_of)
    at = prefix_index(F.col("sequence_name"), labels)
    parents = F.array(*[F.lit(labels.index(p) if p in labels else -2) for p in parent_of.values()])
    known = rows.withColumn("node", F.coalesce(at, F.lit(-1)).cast("long")).withColumn("parent", F.when(F.col("node") >= 0, F.get(parents, F.col("node").cast("int"))).otherwise(-2).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in some_blocks(whole_blocks(batches)):
            column = table.column_names.index("bases")
            masked = table.set_column(column, table.field(column), _masked(table, starts, ord(mask)))
            yield from masked.drop_columns(["node", "parent"]).to_batches(max_chunksize=10_000)

    return known.repartition("block_id").sortWithinPartitions("block_id").mapInArrow(run, rows.schema)


def _masked(table: pa.Table, starts: np.ndarray, mask: int) -> pa.Array:
    """The bases of whole blocks, masked where a row of the ``parent`` has the same one."""
    bases, count = table.column("bases").combine_chunks(), np.diff(starts)
    text, begin = characters(bases)
    upper, size = np.where((text >= ord("a")) & (text <= ord("z")), text - 32, text), np.diff(begin)
    block = np.repeat(np.arange(len(count)), count)
    node, parent = table.column("node").to_numpy(), table.column("parent").to_numpy()
    labels = int(max(node.max(), 0)) + 1
    order = np.flatnonzero(node >= 0)
    order = order[np.argsort(block[order] * labels + node[order], kind="stable")]
    key = block[order] * labels + node[order]
    child = np.flatnonzero((parent >= 0) & (parent < labels))
    wanted = block[child] * labels + parent[child]
    low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
    hit = np.zeros(len(text), bool)
    for nth in range(int((high - low).max()) if len(child) else 0):  # the parent's rows, one after the other
        more = low + nth < high
        mine, other = child[more], order[(low + nth)[more]]
        width = np.minimum(size[mine], size[other])
        inside = np.arange(int(width.sum())) - np.repeat(np.cumsum(width) - width, width)
        here, there = np.repeat(begin[mine], width) + inside, np.repeat(begin[other], width) + inside
        hit[here[upper[here] == upper[there]]] = True
    out = text.copy()
    out[hit & (text != ord("-"))] = mask
    made = strings(out, begin[1:])
    return made if not bases.null_count else pa.array(made.to_pylist(), pa.string(), mask=bases.is_null().to_numpy(zero_copy_only=False))
