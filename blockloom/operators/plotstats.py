"""Tables behind alignment plots: species coverage, bins, runs, orientation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.scalars import default_genome
from blockloom.operators.columns import block_offsets
from blockloom.operators.selection import medians
from blockloom.operators.shards import against, characters, some_blocks, whole_blocks
from blockloom.session import keep

#: Bases of a sequence that are ordered by themselves.
SPAN = 10_000_000


def sample_blocks(rows: DataFrame, ordinals: DataFrame, every: int) -> DataFrame:
    """The rows of every ``every``-th block in order."""
    return rows.join(ordinals.where(F.col("ordinal") % every == 0).select("block_id"), "block_id", "left_semi")


def species_coverage(rows: DataFrame, only: list[str] | None = None, reference: str | None = None) -> DataFrame:
    """``species, covered``: aligned row lengths outside of the reference row.

    ``only`` is a list of the species to count; without it ``reference``, if given, leaves alignments of that species with itself out.
    """
    species = default_genome(F.col("sequence_name"))
    if only is not None:
        rows = rows.where(species.isin(only))
    elif reference is not None:
        rows = rows.where(species != reference)
    return rows.where("row_index > 0").groupBy(default_genome(F.col("sequence_name")).alias("species")).agg(F.sum("length").alias("covered"))


def top_species(covered: DataFrame, k: int) -> DataFrame:
    """The ``k`` best covered species, with their rank from 0."""
    return covered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("covered"), "species")) - 1).where(F.col("rank") < k)  # a record per species


def spread_species(covered: DataFrame, k: int) -> DataFrame:
    """``k`` species at even ranks of the descending list, the last one included."""
    n = F.count("*").over(Window.partitionBy())
    ranked = covered.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("covered"), "species")) - 1).withColumn("n", n)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / max(k - 1, 1)))
    return ranked.where((F.col("rank") % step == 0) | (F.col("rank") == F.col("n") - 1)).orderBy("rank").limit(k).select("species", "covered", "rank")


def bins(rows: DataFrame, bin_size: int) -> DataFrame:
    """``bin, species, aligned, matched``: reference bases of each bin that a species' rows cover, and those that agree (or are masked).

    Bins count reference bases from the first block on.
    """
    ref = rows.where("row_index = 0").select("block_id", F.col("length").alias("w"))
    own = rows.where("row_index >= 0").select("block_id", "row_index", default_genome(F.col("sequence_name")).alias("species"), F.upper("bases").alias("bases"))
    # a block's offset stands before its rows
    both = own.unionByName(block_offsets(ref), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in some_blocks(whole_blocks(batches)):
            yield from _binned(table, starts, bin_size).to_batches(max_chunksize=10_000)

    counted = both.repartition("block_id").sortWithinPartitions("block_id", "row_index").mapInArrow(run, "bin bigint, species string, aligned bigint, matched bigint")
    return counted.groupBy("bin", "species").agg(F.sum("aligned").alias("aligned"), F.sum("matched").alias("matched"))


def _binned(table: pa.Table, starts: np.ndarray, bin_size: int) -> pa.Table:
    """The records of ``bins`` for whole blocks, each after a record with its offset."""
    text, begin = characters(table.column("bases").combine_chunks())
    count = np.diff(starts)
    block = np.repeat(np.arange(len(count)), count)
    index = table.column("row_index").fill_null(-1).to_numpy()
    offset = table.column("offset").fill_null(0).to_numpy()[starts[:-1]]
    ref = np.maximum.reduceat(np.where(index == 0, np.arange(len(table)), -1), starts[:-1])
    row, q, r, k = against(text, begin, ref[block])
    own = index[row] > 0
    row, q, r, k = row[own], q[own], r[own], k[own]
    coded = table.column("species").combine_chunks().dictionary_encode()
    names = len(coded.dictionary) + 1
    key, which = np.unique((offset[block[row]] + k) // bin_size * names + coded.indices.fill_null(names - 1).to_numpy(zero_copy_only=False)[row], return_inverse=True)
    aligned = q != ord("-")
    many = lambda x: pa.array(np.bincount(which[x], minlength=len(key)), pa.int64())
    species = coded.dictionary.take(pa.array(key % names, mask=key % names == names - 1))
    return pa.table([pa.array(key // names, pa.int64()), species, many(aligned), many(aligned & ((q == r) | (q == ord("*"))))], names=["bin", "species", "aligned", "matched"])


def bin_summary(binned: DataFrame, bin_size: int) -> DataFrame:
    """Median and mean of coverage and identity over the bins of each species; medians are selected without gathering a species' bins."""
    x = keep(binned, "bins").withColumn("coverage", F.col("aligned") / bin_size).withColumn("identity", F.when(F.col("aligned") > 0, F.col("matched") / F.col("aligned")))
    means = x.groupBy("species").agg(F.avg("coverage").alias("mean_coverage"), F.avg("identity").alias("mean_identity"))
    of = lambda c: medians(x, ["species"], c).select("species", F.col("median").alias(f"median_{c}"))
    return means.join(of("coverage"), "species", "left").join(of("identity"), "species", "left").select("species", "median_coverage", "mean_coverage", "median_identity", "mean_identity")


def collinear_runs(rows: DataFrame, most_gap: int, span: int = SPAN) -> DataFrame:
    """Runs of non-reference rows that follow each other on a sequence and strand within ``most_gap``: ``sequence_name, strand, start, end, n_rows, aligned``.

    Rows are ordered inside stretches of ``span`` bases; each stretch takes the end of the row before it, and the number of runs before it, from
    one record per stretch.  So a sequence with all rows is spread over all tasks.
    """
    keys, order = ["sequence_name", "strand", "stretch"], F.struct("start", "block_id", "row_index")
    mine = rows.where("row_index > 0").select("sequence_name", "strand", "start", "length", "block_id", "row_index", F.expr(f"floor(start / {span})").cast("long").alias("stretch"))
    inside, along = Window.partitionBy(*keys).orderBy("start", "block_id", "row_index"), Window.partitionBy("sequence_name", "strand").orderBy("stretch")
    end = F.col("start") + F.col("length")
    ends = mine.groupBy(*keys).agg(F.max_by(end, order).alias("end"))
    cut = mine.join(ends.select(*keys, F.lag("end").over(along).alias("before")), keys).withColumn("gap", F.col("start") - F.coalesce(F.lag(end).over(inside), "before"))
    cut = cut.withColumn("new", F.when((F.col("gap") >= 0) & (F.col("gap") <= most_gap), 0).otherwise(1))
    totals = cut.groupBy(*keys).agg(F.sum("new").alias("n")).select(*keys, (F.sum("n").over(along) - F.col("n")).alias("n_before"))
    runs = cut.join(totals, keys).withColumn("run", F.sum("new").over(inside) + F.col("n_before"))
    return runs.groupBy("sequence_name", "strand", "run").agg(F.min("start").alias("start"), F.max(end).alias("end"), F.count("*").alias("n_rows"), F.sum("length").alias("aligned")).drop("run")


def secondary_runs_dropped(runs: DataFrame, least: int) -> DataFrame:
    """The longest run of each sequence (then the first, then - before +), and the others of at least ``least`` aligned bases."""
    mine = F.struct((-F.col("aligned")).alias("less"), "start", "strand", "end", "n_rows", "aligned")
    best = runs.groupBy("sequence_name").agg(F.min(mine).alias("best"))
    alone = best.select("sequence_name", "best.*").drop("less").where(F.col("aligned") < least)
    return runs.where(F.col("aligned") >= least).unionByName(alone)


def orientation(rows: DataFrame) -> DataFrame:
    """``sequence_name, forward, backward, majority, median_start`` of non-reference rows."""
    others = rows.where("row_index > 0")
    counts = others.groupBy("sequence_name").agg(F.sum(F.col("strand").cast("long")).alias("forward"), F.sum((~F.col("strand")).cast("long")).alias("backward"))
    middle = medians(others, ["sequence_name"], "start").withColumnRenamed("median", "median_start")
    return counts.join(middle, "sequence_name").select("sequence_name", "forward", "backward", "median_start", F.when(F.col("forward") >= F.col("backward"), "+").otherwise("-").alias("majority"))


def layout(intervals: DataFrame, most_gap: int, span: int = SPAN) -> DataFrame:
    """Plot coordinates of ``sequence_name, start, end``: gaps longer than ``most_gap`` shrink to it, along each sequence.

    As in ``collinear_runs``, stretches of ``span`` bases are ordered by themselves and shifted by those before.
    """
    keys = ["sequence_name", "stretch"]
    rows = intervals.withColumn("stretch", F.expr(f"floor(start / {span})").cast("long"))
    inside, along = Window.partitionBy(*keys).orderBy("start", "end"), Window.partitionBy("sequence_name").orderBy("stretch")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.groupBy(*keys).agg(F.max("end").alias("most"), F.min("start").alias("least"))
    reach = reach.select(*keys, F.max("most").over(earlier).alias("reached"), F.min("least").over(Window.partitionBy("sequence_name")).alias("first"))
    before = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), "reached")
    gap = F.greatest(F.lit(0), F.col("start") - F.coalesce(before, F.col("start")))
    saved = rows.join(reach, keys).withColumn("saved", F.greatest(F.lit(0), gap - most_gap))
    totals = saved.groupBy(*keys).agg(F.sum("saved").alias("n")).select(*keys, (F.sum("n").over(along) - F.col("n")).alias("saved_before"))
    out = saved.join(totals, keys).withColumn("x", F.col("start") - F.col("first") - F.sum("saved").over(inside) - F.col("saved_before"))
    return out.select(*intervals.columns, "x")
