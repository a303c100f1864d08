"""Columns of blocks, their encodings, and windows over columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.scalars import base_codes, one_hot
from blockloom.operators.shards import by_block, characters, strings, whole_blocks
from blockloom.session import keep

#: Block ids of a shard, and columns of a range of windows.
SHARD, WINDOWED = 100_000, 4_096
#: Characters that are turned from rows to columns at once.
CELLS = 1 << 21


def block_offsets(blocks: DataFrame) -> DataFrame:
    """``block_id, offset`` from ``block_id, w``: the number of columns before each block.

    Running totals inside shards of block ids are shifted by the totals of the
    shards before, so that no task orders all blocks.
    """
    blocks = blocks.withColumn("shard", F.expr(f"block_id div {SHARD}"))
    totals = blocks.groupBy("shard").agg(F.sum("w").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # one record per shard
    inside = F.sum("w").over(Window.partitionBy("shard").orderBy("block_id")) - F.col("w")
    return blocks.withColumn("inside", inside).join(before, "shard").select("block_id", (F.col("inside") + F.col("before")).alias("offset"))


def _plain_block(texts: list[str | None]) -> list[str]:
    """The columns of one block, of which rows may be missing or end early; as many as its first row has."""
    rows = [[*t] or [""] for t in texts if t is not None]
    return ["".join(r[i] for r in rows if i < len(r)) for i in range(len(rows[0]))] if texts[0] is not None else []


def _turned(text: np.ndarray, begin: np.ndarray, starts: np.ndarray, regular: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Characters by block, column and row, where each column ends, how many columns each block has, and for each column how many reference bases stand before it.

    Blocks of one shape are turned together; those that aren't ``regular`` by themselves.
    """
    size, n = np.diff(begin), np.diff(starts)
    wide = size[starts[:-1]].copy()
    alone = {b: _plain_block(table.column("bases").slice(starts[b], n[b]).to_pylist()) for b in np.flatnonzero(~regular).tolist()}
    for b, found in alone.items():
        wide[b] = len(found)
    area = np.where(regular, wide * n, 0)
    for b, found in alone.items():
        area[b] = sum(map(len, found))
    at, first = np.cumsum(area) - area, np.cumsum(wide) - wide
    out, height, ahead = np.zeros(int(area.sum()), text.dtype), np.zeros(int(wide.sum()), np.int64), np.zeros(int(wide.sum()), np.int64)
    _, shape = np.unique(np.stack([n, wide]), axis=1, return_inverse=True)
    order = np.argsort(np.where(regular, shape.ravel(), -1), kind="stable")[len(alone):]
    for same in np.split(order, np.flatnonzero(np.diff(shape.ravel()[order])) + 1) if len(order) else []:
        rows, w = int(n[same[0]]), int(wide[same[0]])
        step = max(1, CELLS // (rows * w))
        for k in range(0, len(same), step):
            some = same[k : k + step]
            cells = text[begin[starts[some]][:, None] + np.arange(rows * w)].reshape(len(some), rows, w)
            out[at[some][:, None] + np.arange(rows * w)] = cells.transpose(0, 2, 1).reshape(len(some), rows * w)
            base, places = cells[:, 0] != ord("-"), first[some][:, None] + np.arange(w)
            height[places], ahead[places] = rows, np.cumsum(base, axis=1) - base
    for b, found in alone.items():
        out[at[b] : at[b] + area[b]] = [ord(c) for x in found for c in x]
        here = slice(first[b], first[b] + wide[b])
        base = np.array([x[:1] not in ("", "-") for x in found], np.int64)
        height[here], ahead[here] = [len(x) for x in found], np.cumsum(base) - base
    return out, np.cumsum(height), wide, ahead


def _column_table(table: pa.Table, starts: np.ndarray, flat: bool) -> pa.Table:
    """Whole blocks (``whole_blocks``) as the records of ``packed_with_reference``, or one for each column with ``flat``."""
    text, begin = characters(table.column("bases").combine_chunks())
    size, n = np.diff(begin), np.diff(starts)
    odd = table.column("bases").combine_chunks().is_null().to_numpy(zero_copy_only=False) | (size == 0) | (size != np.repeat(size[starts[:-1]], n))
    odd_blocks = np.logical_or.reduceat(odd, starts[:-1])
    if odd_blocks.any() and text.dtype == np.uint8:
        text = text.astype(np.uint32)  # odd blocks are put together as text
    out, ends, wide, ahead = _turned(text, begin, starts, ~odd_blocks, table)
    found = strings(out, ends)
    # the reference's start: of the row of index 0, the greatest of several
    index, start = table.column("row_index").fill_null(-1).to_numpy(), table.column("start")
    known = (index == 0) & start.is_valid().to_numpy()
    least = np.iinfo(np.int64).min
    ref_start = np.maximum.reduceat(np.where(known, start.fill_null(0).to_numpy(), least), starts[:-1])
    none = ~np.logical_or.reduceat(known, starts[:-1])
    block = table.column("block_id").take(pa.array(starts[:-1])).combine_chunks()
    cuts = np.append(0, np.cumsum(wide)).astype(np.int32)
    if not flat:
        names = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), table.column("sequence_name").combine_chunks())
        missing = table.column("bases").take(pa.array(starts[:-1])).combine_chunks().is_null()
        lists = [pa.ListArray.from_arrays(pa.array(cuts), x) for x in (found, pa.array(ahead.astype(np.int32)))]
        cells = [block, *(pc.if_else(missing, pa.scalar(None, x.type), x) if pc.any(missing).as_py() else x for x in lists), pa.array(ref_start, mask=none), names]
        return pa.table(cells, names=["block_id", "columns", "offsets", "ref_start", "names"])
    of = np.repeat(np.arange(len(wide)), wide)
    cells = [block.take(pa.array(of)), pa.array(np.arange(len(of)) - cuts[:-1][of]), found, pa.array(ref_start[of] + ahead, mask=none[of]), pc.utf8_slice_codeunits(found, 0, 1)]
    return pa.table(cells, names=["block_id", "col", "bases", "ref_pos", "ref_base"])


def _turn(rows: DataFrame, schema: str, flat: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_blocks(batches):
            cells = np.cumsum(pc.binary_length(table.column("bases")).fill_null(0).to_numpy())[starts[1:] - 1] // CELLS  # so many characters at once, or one block
            for some in np.split(np.arange(len(cells)), np.flatnonzero(np.diff(cells)) + 1):
                a, b = starts[some[0]], starts[some[-1] + 1]
                yield from _column_table(table.slice(a, b - a), starts[some[0] : some[-1] + 2] - a, flat).to_batches(max_chunksize=10_000 if flat else 500)

    return by_block(rows.select("block_id", "row_index", "sequence_name", "start", "bases")).mapInArrow(run, schema)


def packed_with_reference(rows: DataFrame) -> DataFrame:
    """``packed_columns`` with ``offsets``: for each column how many reference bases stand before it."""
    return _turn(rows, "block_id bigint, columns array<string>, offsets array<int>, ref_start bigint, names array<string>", False)


def packed_columns(rows: DataFrame) -> DataFrame:
    """``block_id, columns, ref_start, names``: each block's columns as an array of strings of bases in row order, and the sequence names in row order."""
    return packed_with_reference(rows).select("block_id", "columns", "ref_start", "names")


def columns(rows: DataFrame, only_reference: bool = False, names: bool = False) -> DataFrame:
    """``block_id, col, bases, ref_pos, ref_base``: each column's bases in row order.

    ``ref_pos`` is the position of the column's reference base, or of the next one if
    the reference has a gap there; ``only_reference`` leaves such columns out.
    ``names`` adds the sequence names in row order.
    """
    if not names:
        out = _turn(rows, "block_id bigint, col bigint, bases string, ref_pos bigint, ref_base string", True)
    else:
        blocks = packed_with_reference(rows).select("block_id", "ref_start", "names", F.posexplode(F.arrays_zip("columns", "offsets")).alias("col", "x"))
        out = blocks.select("block_id", F.col("col").cast("long").alias("col"), F.col("x.columns").alias("bases"), (F.col("ref_start") + F.col("x.offsets")).alias("ref_pos"), F.substring("x.columns", 1, 1).alias("ref_base"), "names")
    return out.where("ref_base <> '-'") if only_reference else out


def codes(bases: Column) -> Column:
    return base_codes(bases)


def one_hots(bases: Column) -> Column:
    return F.transform(codes(bases), one_hot)


def column_at(rows: DataFrame, col: int) -> DataFrame:
    """One column of each block (negative: from its end), as ``block_id, bases``."""
    at = F.lit(col + 1) if col >= 0 else F.lit(col)
    picked = F.array_sort(F.collect_list(F.struct("row_index", F.substring(F.col("bases"), at, F.lit(1)).alias("b"))))
    return rows.groupBy("block_id").agg(F.array_join(F.transform(picked, lambda x: x["b"]), "").alias("bases"))


def tag_label(tags: Column, key: str, default: float = 0.0) -> Column:
    """The value of tag ``key`` as a number, ``default`` without it."""
    return F.coalesce(F.get(F.filter(tags, lambda t: t["key"] == key), 0)["value"].cast("double"), F.lit(default))


def set_tag(tags: Column, key: str, value: Column) -> Column:
    """Put a tag first; an older one of the same key goes."""
    return F.concat(F.array(F.struct(F.lit(key).alias("key"), value.alias("value"))), drop_tag(tags, key))


def drop_tag(tags: Column, key: str) -> Column:
    return F.filter(tags, lambda t: t["key"] != key)


def windows(cols: DataFrame, length: int, step: int) -> DataFrame:
    """``window, bases``: ``length`` consecutive ones of ``cols`` (``block_id, col, bases``; any type) every ``step`` columns, across blocks; a short tail is left out."""
    packed = cols.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("col", "bases"))).alias("x"))
    widths = keep(cols.groupBy("block_id").agg(F.count("*").alias("w")), "widths")
    return _windows(packed.select("block_id", F.transform("x", lambda x: x["bases"]).alias("x")), widths, length, step)


def row_windows(rows: DataFrame, length: int, step: int) -> DataFrame:
    """``windows`` of the columns of ``rows``, which needn't be told apart first."""
    widths = keep(rows.where("row_index = 0").select("block_id", F.length("bases").cast("long").alias("w")), "widths")  # narrow, read twice
    return _windows(packed_columns(rows).select("block_id", F.col("columns").alias("x")), widths, length, step)


def _windows(blocks: DataFrame, widths: DataFrame, length: int, step: int) -> DataFrame:
    """Windows over ``block_id, x`` (an array of columns each), whose sizes are ``widths``.

    Columns are dealt into ranges of ``span`` columns, each with ``length - 1`` more; a range slices its own windows.
    """
    span = step * max(1, -(-max(WINDOWED, length) // step))
    at = blocks.join(block_offsets(widths), "block_id").where(F.size("x") > 0)
    first, last = F.greatest(F.lit(0), F.floor((F.col("offset") - (length - 1)) / span)), F.floor((F.col("offset") + F.size("x") - 1) / span)
    spread = at.withColumn("part", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    begin = F.greatest(F.col("part") * span - F.col("offset"), F.lit(0)).cast("int")
    end = F.least((F.col("part") + 1) * span + length - 1 - F.col("offset"), F.size("x")).cast("int")
    pieces = spread.select("part", (F.col("offset") + begin).alias("o"), F.slice("x", begin + 1, end - begin).alias("x"))
    whole = pieces.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("o", "x"))).alias("pieces"))
    whole = whole.select("part", F.get("pieces", F.lit(0))["o"].alias("o"), F.flatten(F.transform("pieces", lambda p: p["x"])).alias("x"))
    # a range's first own column is there unless the file begins later, which it doesn't: columns are numbered without gaps
    most = F.least(F.floor((F.col("o") + F.size("x") - length) / step), F.expr(f"((part + 1) * {span} - 1) div {step}")).cast("long")
    least = F.expr(f"(part * {span} + {step - 1}) div {step}")
    own = F.transform(F.sequence(least, most), lambda k: F.struct(k.alias("window"), F.slice("x", (k * step - F.col("o") + 1).cast("int"), F.lit(length)).alias("bases")))
    return whole.where(most >= least).select(F.explode(own).alias("w")).select("w.*")
