"""Pairwise records between the rows of a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.operators.shards import by_block, characters, strings, whole_blocks

#: Pairs, and characters of pairs, that are compared at once.
PAIRS, CHARACTERS = 1 << 16, 1 << 22
NEITHER, MATCH, MISMATCH, INSERTED, DELETED = range(5)
PAIRED = (
    "block_id bigint, target_row bigint, query_row bigint, query_name string, query_length bigint, query_start bigint, query_end bigint, strand string, "
    "target_name string, target_length bigint, target_start bigint, target_end bigint, matches bigint, block_length bigint, cigar string"
)


def paired(starts: np.ndarray, index: np.ndarray, all_to_all: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of targets and queries of the pairs inside blocks, ``PAIRS`` or little more at a time; ``index`` holds the row indices."""
    sizes = np.diff(starts)
    end = np.repeat(starts[1:], sizes)
    targets = np.arange(len(index)) if all_to_all else np.flatnonzero(index == 0)
    ahead = end[targets] - targets - 1
    total = np.cumsum(ahead)
    at = 0
    while at < len(targets):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        n = ahead[at:upto]
        t = np.repeat(targets[at:upto], n)
        q = t + 1 + np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
        ok = index[q] > index[t]
        t, q, at = t[ok], q[ok], upto
        for k in range(0, len(t), PAIRS):
            yield t[k : k + PAIRS], q[k : k + PAIRS]


def cigars(text: np.ndarray, begin: np.ndarray, t: np.ndarray, q: np.ndarray, forward: np.ndarray, differences: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Matches, events and the cigar of each pair; columns are read backwards where ``forward`` is false, and a string that ends early has gaps there.

    Runs of equal events are one entry, and each mismatch stands alone; without ``differences`` it is a match.
    """
    size = np.diff(begin)
    wide = np.maximum(size[t], size[q])
    pair = np.repeat(np.arange(len(t)), wide)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(wide) - wide, wide)

    def read(rows: np.ndarray) -> np.ndarray:
        n = size[rows][pair]
        at = begin[rows][pair] + np.where(forward[pair], k, n - 1 - k)
        return np.where(k < n, text[np.clip(at, 0, len(text) - 1)], text.dtype.type(ord("-")))

    a, b = (read(t), read(q)) if len(pair) else (text[:0], text[:0])
    base, other = a != ord("-"), b != ord("-")
    event = np.where(base & other, np.where((a != b) & differences, MISMATCH, MATCH), np.where(other, INSERTED, np.where(base, DELETED, NEITHER))).astype(np.int8)
    some = event != NEITHER
    event, pair, a, b = event[some], pair[some], a[some], b[some]
    begins = np.append(True, (event[1:] != event[:-1]) | (pair[1:] != pair[:-1]) | (event[1:] == MISMATCH)) if len(event) else np.zeros(0, bool)
    length = np.bincount(pair, minlength=len(t))
    matches = np.bincount(pair[event <= MISMATCH], minlength=len(t))
    if not differences:
        first = np.flatnonzero(begins)
        runs = pc.binary_join_element_wise(pa.array(np.diff(np.append(first, len(event)))).cast(pa.string()), pa.array(np.array(list(" MMID"))[event[first]].tolist(), pa.string()), "")
        of = np.append(0, np.cumsum(np.bincount(pair[first], minlength=len(t)))).astype(np.int32)
        return matches, length, pc.binary_join_element_wise("cg:Z:", pc.binary_join(pa.ListArray.from_arrays(pa.array(of), runs), ""), "")
    # an entry is its sign and its bases: the query's, or the target's where they are deleted, or both of a mismatch
    head = np.frombuffer(b" =*+-", np.uint8).astype(text.dtype)
    places = 1 + begins + (event == MISMATCH)
    last = np.cumsum(places)
    out = np.zeros(int(last[-1]) if len(last) else 0, text.dtype)
    out[last - 1] = np.where(event == DELETED, a, b)
    out[(last - places)[begins]] = head[event[begins]]
    out[last[event == MISMATCH] - 2] = a[event == MISMATCH]
    ends = np.append(0, last)[np.cumsum(length)]
    return matches, length, pc.binary_join_element_wise("cs:Z:", strings(out, ends), "")


def pairs(rows: DataFrame, all_to_all: bool = False, differences: bool = False) -> DataFrame:
    """One record per pair of rows of a block: row 0 is the target, or each earlier row with ``all_to_all``.

    Coordinates are on the + strand; on a - target the columns are read backwards. ``differences`` spells out the bases
    of each event instead of counting them.
    """

    def records(table: pa.Table, text: np.ndarray, begin: np.ndarray, t: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        target, query = table.take(pa.array(t)), table.take(pa.array(q))
        forward = target.column("strand").combine_chunks()
        matches, length, cigar = cigars(text, begin, t, q, forward.fill_null(False).to_numpy(zero_copy_only=False), differences)
        none = pc.or_(pc.is_null(target.column("bases")), pc.is_null(query.column("bases"))).to_numpy()

        def begins(r: pa.Table) -> pa.ChunkedArray:
            back = pc.subtract(r.column("sequence_length"), pc.add(r.column("start"), r.column("length")))
            return pc.if_else(pc.fill_null(r.column("strand"), False), r.column("start"), back)

        of_q, of_t = begins(query), begins(target)
        cells = [
            query.column("block_id"), target.column("row_index"), query.column("row_index"), query.column("sequence_name"), query.column("sequence_length"), of_q, pc.add(of_q, query.column("length")),
            pc.if_else(pc.fill_null(pc.equal(query.column("strand"), target.column("strand")), False), "+", "-"),
            target.column("sequence_name"), target.column("sequence_length"), of_t, pc.add(of_t, target.column("length")),
            pa.array(matches, pa.int64(), mask=none), pa.array(length, pa.int64(), mask=none), pc.if_else(pa.array(none), pa.scalar(None, pa.string()), cigar),
        ]
        names = [c.split()[0] for c in PAIRED.split(", ")]
        return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cells], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches):
            text, begin = characters(table.column("bases").combine_chunks())
            for t, q in paired(starts, table.column("row_index").to_numpy(), all_to_all):
                wide = np.cumsum(np.maximum(np.diff(begin)[t], np.diff(begin)[q])) // CHARACTERS
                for some in np.split(np.arange(len(t)), np.flatnonzero(np.diff(wide)) + 1):
                    yield from records(table, text, begin, t[some], q[some]).to_batches(max_chunksize=10_000)

    own = ["block_id", "row_index", "sequence_name", "start", "length", "strand", "sequence_length", "bases"]
    return by_block(rows.select(*own)).mapInArrow(run, PAIRED)


def lines(records: DataFrame) -> DataFrame:
    """Tab-separated text, with a constant mapping quality."""
    fields = ["query_name", "query_length", "query_start", "query_end", "strand", "target_name", "target_length", "target_start", "target_end", "matches", "block_length"]
    return records.select("block_id", "target_row", "query_row", F.concat_ws("\t", *fields, F.lit("255"), "cigar").alias("value"))
