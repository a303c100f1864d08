"""Alignment statistics, reference intervals and sequence lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: str, b: str) -> Column:
    """Single-precision quotient, 0 for a zero divisor."""
    single = lambda c: F.col(c).cast("float").cast("double")
    return F.when(F.col(b) > 0, (single(a) / single(b)).cast("float")).otherwise(F.lit(0).cast("float")).cast("double")


def alignment_stats(rows: DataFrame) -> DataFrame:
    """Totals and averages of a whole alignment, in one row.

    Blocks are summed up first, so that the second step reads one record per block.
    """
    width = F.length("bases")
    gaps = width - F.length(F.regexp_replace("bases", "-", ""))
    blocks = rows.groupBy("block_id").agg(F.max(width).alias("w"), F.count("*").alias("n"), F.sum(gaps).alias("gaps"), F.sum(width - gaps).alias("bases"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    total = blocks.agg(F.count("*").alias("blocks"), zero(F.sum("w")).alias("columns"), zero(F.sum("bases")).alias("bases"), zero(F.sum("gaps")).alias("gaps"), zero(F.sum(F.col("w") * F.col("n"))).alias("depth"))
    return total.select(
        "blocks", "columns", "bases", "gaps",
        _ratio("columns", "blocks").alias("columns_per_block"), _ratio("depth", "columns").alias("column_depth"),
        _ratio("bases", "columns").alias("bases_per_column"), _ratio("gaps", "columns").alias("gaps_per_column"),
    )


def _islands(rows: DataFrame, broken: Column) -> DataFrame:
    """Number the islands of the reference rows in file order: a new one begins where ``broken`` holds.

    The order is global, so counting is done on one narrow record per block, in
    two levels: inside ranges of blocks, then over the ranges' totals.
    """
    ref = rows.where("row_index = 0").select("block_id", "sequence_name", "start", "length").withColumn("shard", F.expr("block_id div 100000"))
    inside = Window.partitionBy("shard").orderBy("block_id")
    last = ref.groupBy("shard").agg(F.max_by(F.struct("sequence_name", "start", "length"), "block_id").alias("before"))
    # the shard before, which may not be the number before
    along = Window.orderBy("shard")  # one record per 100,000 blocks
    before = last.select("shard", F.lag("before").over(along).alias("before"))
    ref = ref.join(before, "shard").withColumn("p", F.coalesce(F.lag(F.struct("sequence_name", "start", "length")).over(inside), F.col("before")))
    ref = ref.withColumn("new", F.coalesce(broken, F.lit(True)).cast("long"))
    totals = ref.groupBy("shard").agg(F.sum("new").alias("n"))
    totals = totals.select("shard", (F.sum("n").over(along) - F.col("n")).alias("offset"))
    return ref.join(totals, "shard").withColumn("island", F.sum("new").over(inside) + F.col("offset"))


def contiguous_intervals(rows: DataFrame) -> DataFrame:
    """Reference intervals ``sequence_name, start, end`` of blocks that follow each other without a gap."""
    broken = (F.col("p.sequence_name") != F.col("sequence_name")) | (F.col("p.start") + F.col("p.length") != F.col("start"))
    return _islands(rows, broken).groupBy("island").agg(F.first("sequence_name").alias("sequence_name"), F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end")).select("sequence_name", "start", "end")


def named_intervals(rows: DataFrame) -> DataFrame:
    """Runs of blocks with the same reference name: ``sequence_name, start, length``, the length summed over blocks."""
    broken = F.col("p.sequence_name") != F.col("sequence_name")
    return _islands(rows, broken).groupBy("island").agg(F.first("sequence_name").alias("sequence_name"), F.min_by("start", "block_id").alias("start"), F.sum("length").alias("length")).select("sequence_name", "start", "length")


def sequence_lengths(rows: DataFrame) -> DataFrame:
    """Length of each reference sequence, from its first block."""
    return rows.where("row_index = 0").groupBy("sequence_name").agg(F.min_by("sequence_length", "block_id").alias("sequence_length"))


def interval_shares(intervals: DataFrame, shares: int) -> DataFrame:
    """Deal the total length of ``sequence_name, start, length`` (in order of ``ord``) into equal contiguous shares."""
    along = Window.orderBy("ord")  # a list of intervals, not of blocks
    total = intervals.agg(F.sum("length").alias("total"))
    placed = intervals.withColumn("offset", F.sum("length").over(along) - F.col("length")).crossJoin(F.broadcast(total))
    size = F.ceil(F.col("total") / F.lit(shares))
    ends = F.col("offset") + F.col("length")
    parts = placed.withColumn("share", F.explode(F.sequence(F.floor(F.col("offset") / size), F.floor((ends - 1) / size))))
    lo, hi = F.greatest("offset", F.col("share") * size), F.least(ends, (F.col("share") + 1) * size)
    return parts.where("length > 0").select("share", "ord", "sequence_name", (F.col("start") + lo - F.col("offset")).cast("long").alias("start"), (hi - lo).cast("long").alias("length"))


def stats_text(stats: DataFrame) -> DataFrame:
    """``n, value``: the lines of a report on ``alignment_stats``, numbered in their order."""
    whole = [("Total blocks", "blocks"), ("Total columns", "columns"), ("Avg. columns/block", "columns_per_block"), ("Total bases", "bases"), ("Total gaps", "gaps"), ("Avg. column depth", "column_depth"), ("Avg. bases/column", "bases_per_column"), ("Avg. gaps/column", "gaps_per_column")]
    shown = lambda title, c: F.concat(F.lit(f"{title}:\t"), F.format_string("%f", c) if title.startswith("Avg") else F.col(c).cast("string"))
    return stats.select(F.posexplode(F.array(*(shown(t, c) for t, c in whole))).alias("n", "value"))


def bed_text(intervals: DataFrame) -> DataFrame:
    """``value``: tab-separated lines of ``sequence_name, start, end``."""
    return intervals.select(F.concat_ws("\t", "sequence_name", "start", "end").alias("value"))


def lengths_text(lengths: DataFrame) -> DataFrame:
    """``value``: tab-separated lines of ``sequence_name, sequence_length``."""
    return lengths.select(F.concat_ws("\t", "sequence_name", "sequence_length").alias("value"))
