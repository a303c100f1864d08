"""Coverage of genomes on reference contigs.

Base pairs are never exploded: tasks fold whole blocks, many at a time, into one
record per block and genome, and only those are grouped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockloom.functions.scalars import default_genome, genome_in
from blockloom.operators.columns import SHARD
from blockloom.operators.shards import against, characters, some_blocks, whole_blocks
from blockloom.session import keep


def genome_of(name: Column, genomes: list[str] | None) -> Column:
    """The listed genome of a name, else what stands before its first dot."""
    return F.coalesce(genome_in(name, genomes), default_genome(name)) if genomes else default_genome(name)


def block_coverage(rows: DataFrame, genomes: list[str] | None = None, reference: str | None = None) -> DataFrame:
    """One record per block and genome: counts, the first and last reference position at which the genome is aligned, and the gaps between.

    The reference row is the first of the block, or the first of genome ``reference``; blocks without one are left out.
    A genome counts once per column however many copies it has; ``single`` blocks have one row of it and one of the reference's genome.
    """
    eligible = F.coalesce(F.col("genome") == reference, F.lit(False)) if reference else F.lit(True)
    own = rows.select("block_id", "row_index", "sequence_name", "sequence_length", "start", F.upper("bases").alias("bases"), genome_of(F.col("sequence_name"), genomes).alias("genome")).withColumn("eligible", eligible)
    dealt = own.repartition("block_id").sortWithinPartitions("block_id", "row_index", "sequence_name", "sequence_length", "start", "bases", "genome")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in some_blocks(whole_blocks(batches)):
            yield from _folded(table, starts).to_batches(max_chunksize=10_000)

    return dealt.mapInArrow(run, BLOCKS)


BLOCKS = "block_id bigint, contig string, ref_length bigint, genome string, aligned bigint, identical bigint, single_aligned bigint, single_identical bigint, first bigint, last bigint, inner array<bigint>"


def _folded(table: pa.Table, starts: np.ndarray) -> pa.Table:
    """The records of ``block_coverage`` for whole blocks."""
    text, begin = characters(table.column("bases").combine_chunks())
    count = np.diff(starts)
    block = np.repeat(np.arange(len(count)), count)
    place = np.where(table.column("eligible").to_numpy(), np.arange(len(table)), len(table))
    ref = np.minimum.reduceat(place, starts[:-1])
    ref[ref == len(table)] = -1
    coded = table.column("genome").combine_chunks().dictionary_encode()
    genome = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    copies = np.add.reduceat((genome == genome[ref[block]]) & (genome >= 0), starts[:-1], dtype=np.int64)  # of the reference's genome
    known = np.flatnonzero(ref[block] >= 0)
    key, of_known = np.unique(block[known] * (len(coded.dictionary) + 1) + genome[known] + 1, return_inverse=True)
    group = np.full(len(table), -1)
    group[known] = of_known
    some = np.zeros(len(key), np.int64)
    some[of_known] = known  # a row of each group
    mine = ref[block[some]]
    # a code per reference base: 0 not aligned, 1 aligned, 2 equal; of several copies the greatest counts
    end = np.cumsum(np.diff(begin)[mine])
    front = end - np.diff(begin)[mine]
    code = np.zeros(int(end[-1]) if len(end) else 0, np.int8)
    row, q, r, k = against(text, begin, ref[block])
    at, aligned = front[group[row]] + k, (r != ord("N")) & (q != ord("-")) & (q != ord("N"))
    code[at[aligned]] = 1
    code[at[aligned & (q == r)]] = 2
    total = lambda x: (lambda c: c[end] - c[front])(np.append(0, np.cumsum(x)))
    n, equal = total(code > 0), total(code == 2)
    single = (np.bincount(of_known, minlength=len(key)) == 1) & (copies[block[some]] == 1)
    begins, given = table.column("start").fill_null(0).to_numpy()[mine], table.column("start").is_valid().to_numpy()[mine]
    hit = np.flatnonzero(code > 0)
    whose = np.repeat(np.arange(len(key)), n)
    pos = hit - front[whose] + begins[whose]
    last = np.cumsum(n)
    none = (n == 0) | ~given
    gap = np.diff(pos) - 1
    inner = np.flatnonzero((gap > 0) & (whose[1:] == whose[:-1]) & given[whose[1:]]) if len(pos) else np.zeros(0, np.int64)
    cuts = np.append(0, np.cumsum(np.bincount(whose[inner], minlength=len(key)))).astype(np.int32)
    place = lambda i: pa.array(pos[np.where(none, 0, i)] if len(pos) else np.zeros(len(key), np.int64), pa.int64(), mask=none)
    of_ref = lambda c: table.column(c).take(pa.array(mine))
    cells = [of_ref("block_id"), of_ref("sequence_name"), of_ref("sequence_length"), table.column("genome").take(pa.array(some)), n, equal, n * single, equal * single, place(last - n), place(last - 1)]
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.table([*(x if not isinstance(x, np.ndarray) else pa.array(x, pa.int64()) for x in cells), pa.ListArray.from_arrays(pa.array(cuts), pa.array(gap[inner], pa.int64()))], names=names)


COUNTS = ["aligned", "identical", "single_aligned", "single_identical"]


def gaps(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """``contig, genome, gap``: each stretch of reference bases between aligned ones.

    The position before the first is 0, so a genome that begins at ``p`` has a first gap of ``p - 1``; the last gap reaches the contig's end.
    Gaps inside a block stand in its record; those between blocks need the last position before, which is looked up inside
    shards of blocks and then over one record per shard.
    """
    some = blocks.where("first is not null").withColumn("shard", F.expr(f"block_id div {SHARD}"))
    ends = some.groupBy("contig", "genome", "shard").agg(F.max_by("last", "block_id").alias("end"))
    earlier = ends.select("contig", "genome", "shard", F.lag("end").over(Window.partitionBy("contig", "genome").orderBy("shard")).alias("end"))
    here = some.withColumn("before", F.lag("last").over(Window.partitionBy("contig", "genome", "shard").orderBy("block_id")))
    opens = here.where("before is null").join(earlier, ["contig", "genome", "shard"]).withColumn("before", F.coalesce("end", F.lit(0).cast("long"))).drop("end")
    linked = here.where("before is not null").unionByName(opens)
    inside = linked.select("contig", "genome", F.explode(F.concat("inner", F.array(F.col("first") - F.col("before") - 1))).alias("gap")).where("gap > 0")
    reach = blocks.select("contig", "genome").distinct().join(ends.groupBy("contig", "genome").agg(F.max_by("end", "shard").alias("last")), ["contig", "genome"], "left")
    tail = reach.join(lengths, "contig").select("contig", "genome", (F.col("ref_length") - F.coalesce("last", F.lit(0)) - 1).alias("gap")).where("gap > 0")
    return inside.unionByName(tail)


def contig_lengths(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("contig").agg(F.min_by("ref_length", "block_id").alias("ref_length"))


def group_names(lengths: DataFrame) -> list[str]:
    """Names of the groups that no contig has: the total, sex chromosomes, autosomes, each with as many ``_`` at its end as it takes."""
    taken = {r["contig"] for r in lengths.where(F.col("contig").rlike("^_(Total|Sex_Chroms|Autosomes)_+$")).select("contig").collect()}  # hardly any
    out = []
    for name in ("_Total_", "_Sex_Chroms_", "_Autosomes_"):
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _groups(sex: list[str] | None, names: list[str]) -> Column:
    """The names under which a contig is counted: its own, the total, and the sex or autosome group."""
    own = [F.col("contig"), F.lit(names[0])]
    if sex:
        own.append(F.when(F.col("contig").isin(sex), names[1]).otherwise(names[2]))
    return F.explode(F.array(*own))


def coverage(rows: DataFrame, genomes: list[str] | None = None, reference: str | None = None, thresholds: list[int] | None = None, sex: list[str] | None = None) -> DataFrame:
    """The coverage table: a record per contig (and group of contigs), genome and gap threshold.

    ``len`` is the contig's length less the bases in gaps longer than ``max_gap``; the threshold -1 stands for the whole length.
    """
    blocks = keep(block_coverage(rows, genomes, reference), "coverage")  # narrow; read four times below
    lengths = contig_lengths(blocks)
    sums = blocks.groupBy("contig", "genome").agg(*(F.sum(c).alias(c) for c in COUNTS))
    lost = gaps(blocks, lengths).groupBy("contig", "genome", "gap").agg(F.sum("gap").alias("lost"))
    groups = group_names(lengths)
    named = lambda df: df.withColumn("name", _groups(sex, groups))
    total_length = named(lengths).groupBy("name").agg(F.sum("ref_length").alias("ref_length"))
    total = named(sums).groupBy("name", "genome").agg(*(F.sum(c).alias(c) for c in COUNTS)).join(total_length, "name")
    limits = sorted(set(thresholds or [])) + [-1]
    limit = F.explode(F.array_distinct(F.array(*[F.lit(t).cast("long") if t >= 0 else F.col("ref_length") for t in limits])))
    wide = total.withColumn("max_gap", limit)
    by_gap = named(lost).groupBy("name", "genome").agg(F.collect_list(F.struct("gap", "lost")).alias("gaps"))
    gone = F.aggregate(F.filter(F.coalesce("gaps", F.expr("cast(array() as array<struct<gap: bigint, lost: bigint>>)")), lambda g: g["gap"] > F.col("max_gap")), F.lit(0).cast("long"), lambda a, g: a + g["lost"])
    out = wide.join(by_gap, ["name", "genome"], "left").withColumn("len", F.col("ref_length") - gone)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.select(
        F.col("name").alias("contig"), "max_gap", "len", F.col("genome").alias("query"),
        ratio("aligned", "len").alias("aln"), ratio("identical", "aligned").alias("ident"), ratio("single_aligned", "len").alias("single_aln"), ratio("single_identical", "single_aligned").alias("single_ident"),
        *COUNTS,
    )


def table_text(cov: DataFrame) -> DataFrame:
    """Tab-separated lines of the coverage table, ratios with four decimals."""
    f = lambda c: F.format_string("%.4f", c)
    return cov.select(F.concat_ws("\t", "contig", "max_gap", "len", "query", f("aln"), f("ident"), f("single_aln"), f("single_ident"), *COUNTS).alias("value"))
