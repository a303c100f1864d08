"""Operators that change the columns of blocks: drop all-gap columns, split at reference gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.operators.masks import with_reference
from blockloom.operators.shards import characters, some_blocks, strings, whole_blocks


def _slots(c: str = "bases"):
    return F.filter(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.substring(F.col(c), i + 1, F.lit(1)) != "-")


def gapless(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """Whole blocks (``whole_blocks``) without the columns in which every row has a gap; one stays if there are no others."""
    at, bases = table.column_names.index("bases"), table.column("bases").combine_chunks()
    text, begin = characters(bases)
    size, n = np.diff(begin), np.diff(starts)
    wide = np.maximum(np.maximum.reduceat(size, starts[:-1]), 1)
    first = np.cumsum(wide) - wide
    column = np.arange(len(text)) - np.repeat(begin[:-1] - np.repeat(first, n), size)  # of each character, counted over all blocks
    used = np.zeros(int(wide.sum()), bool)
    used[column[text != ord("-")]] = True
    used[first[np.add.reduceat(used, first, dtype=np.int64) == 0]] = True
    stays = np.repeat(np.repeat(np.add.reduceat(used, first, dtype=np.int64), n) >= size, size)  # rows no longer than what is used stay
    kept = used[column] | stays
    if kept.all():
        return table
    short = strings(text[kept], np.append(0, np.cumsum(kept))[begin[1:]])
    if bases.null_count:
        short = pa.array(short.to_pylist(), pa.string(), mask=bases.is_null().to_numpy(zero_copy_only=False))
    return table.set_column(at, table.field(at), short)


def drop_all_gap_columns(rows: DataFrame) -> DataFrame:
    """Without the columns in which every row has a gap; one stays if there are no others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in some_blocks(whole_blocks(batches)):
            yield from gapless(table, starts).to_batches(max_chunksize=10_000)

    return rows.repartition("block_id").sortWithinPartitions("block_id").mapInArrow(run, rows.schema)


def tags_without_gap_columns(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """``block_id, col, tags`` of the columns that ``drop_all_gap_columns`` keeps of ``rows``, at their new places."""
    used = rows.groupBy("block_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(_slots())))).alias("used"))
    used = used.withColumn("used", F.when(F.size("used") == 0, F.array(F.lit(0))).otherwise(F.col("used")))
    at = F.array_position("used", F.col("col").cast("int"))
    return tags.join(used, "block_id").withColumn("at", at).where("at > 0").select("block_id", (F.col("at") - 1).alias("col"), "tags")


def _with_cuts(rows: DataFrame) -> DataFrame:
    """``cuts`` of reference rows (null elsewhere): begin and end of each stretch of columns where they have bases."""
    # a segment begins at a base after a gap or at the front
    starts = F.filter(F.transform("places", lambda p, k: F.when((k == 0) | (p != F.get("places", k - 1) + 1), p)), lambda p: p.isNotNull())
    ends = F.filter(F.transform("places", lambda p, k: F.when(F.coalesce(F.get("places", k + 1) != p + 1, F.lit(True)), p + 1)), lambda p: p.isNotNull())
    rows = rows.withColumn("places", F.when(F.col("row_index") == 0, _slots()))
    return rows.withColumn("cuts", F.when(F.col("row_index") == 0, F.arrays_zip(starts.alias("a"), ends.alias("b")))).drop("places")


def unnormalised_tags(rows: DataFrame, tags: DataFrame) -> DataFrame:
    """``block_id, segment, col, tags`` of the columns that ``unnormalise`` keeps of ``rows``; those of dropped columns go."""
    cuts = _with_cuts(rows.where("row_index = 0")).select("block_id", "cuts")
    segments = F.transform("cuts", lambda x, k: F.struct(k.cast("long").alias("segment"), x["a"].alias("a"), x["b"].alias("b")))
    mine = F.get(F.filter(segments, lambda x: (x["a"] <= F.col("col")) & (F.col("col") < x["b"])), 0)
    found = tags.join(cuts, "block_id").withColumn("mine", mine).where("mine is not null")
    return found.select("block_id", "mine.segment", (F.col("col") - F.col("mine.a")).alias("col"), "tags")


def unnormalise(rows: DataFrame) -> DataFrame:
    """Split blocks where the reference has gaps and drop those columns; ``unnormalised_tags`` moves column tags along.

    New blocks are ``block_id, segment``; rows without bases in a segment are left out, a block whose reference is all gaps goes.
    """
    rows = with_reference(_with_cuts(rows), "cuts").where(F.size("ref_cuts") > 0)  # once per block, from its reference row
    part = lambda x: F.substring("bases", x["a"] + 1, x["b"] - x["a"])
    bases_in = lambda text: F.length(F.replace(text, F.lit("-"), F.lit(""))).cast("long")
    # the row's bases before each cut, counted on from the cut before
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<bigint>)").alias("before"))
    count = lambda acc, x: acc["n"] + bases_in(F.substring("bases", acc["at"] + 1, x["a"] - acc["at"]))
    before = F.aggregate("ref_cuts", begin, lambda acc, x: F.struct(x["a"].alias("at"), count(acc, x).alias("n"), F.concat(acc["before"], F.array(count(acc, x))).alias("before")))["before"]
    rows = rows.withColumn("before", before)
    pieces = F.transform("ref_cuts", lambda x, k: F.struct(k.cast("long").alias("segment"), part(x).alias("part"), F.get("before", k).alias("n")))
    some = F.filter(pieces, lambda x: F.translate(x["part"], "-", "") != "")
    out = rows.withColumn("piece", F.explode(F.transform(some, lambda x: F.struct(x["segment"].alias("segment"), x["part"].alias("bases"), (F.col("start") + x["n"]).alias("start")))))
    out = out.select("block_id", "row_index", "sequence_name", "strand", "sequence_length", "piece.*").withColumn("length", bases_in(F.col("bases")))
    rank = F.row_number().over(Window.partitionBy("block_id", "segment").orderBy("row_index")) - 1
    return out.select("block_id", "segment", rank.cast("long").alias("row_index"), "sequence_name", "start", "length", "strand", "sequence_length", "bases")
