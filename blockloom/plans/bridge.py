"""An alignment derived from ``lineitem``, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from blockloom.session import bounded_broadcast, dealt, keep

#: Block ids of a shard, and totals of shards that are broadcast at most.
SHARD, MOST_TOTALS = 5_000, 500_000

SQL = """k as (
    select l_orderkey as block_id,
           cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as bigint) as row_index,
           l_suppkey, l_partkey from {lineitem}),
r as (
    select block_id, row_index,
           case when row_index = 0 then concat('ref.chr', cast(cast(floor(block_id / 5000.0) as bigint) as {string}))
                else concat('g', cast(l_suppkey % 5 as {string}), '.chr', cast(l_partkey % 3 as {string})) end as sequence_name,
           (row_index = 0 or l_partkey % 4 <> 3) as strand,
           translate(md5(concat(cast(block_id as {string}), '-', cast(row_index as {string}))), '0123456789abcdef', 'ACGTACGTACGTAC-N') as bases from k),
l as (select *, cast(length(replace(bases, '-', '')) as bigint) as length from r),
t as (
    select *, cast(coalesce(sum(length) over (partition by sequence_name, strand order by block_id, row_index rows between unbounded preceding and 1 preceding), 0)
                   + 10 * cast(floor(block_id / 7.0) as bigint) as bigint) as start from l),
aln as (
    select block_id, row_index, sequence_name, start, length, strand,
           cast(max(start + length) over (partition by sequence_name) + 1000 as bigint) as sequence_length, bases from t)"""

#: The common table expressions for DuckDB; queries read ``aln``.
DUCK = "with " + SQL.format(lineitem="lineitem", string="varchar").replace("aln as (", "aln as materialized (")


def _placed(lines: DataFrame) -> DataFrame:
    """The rows ``r`` of ``SQL`` with their ``shard``, dealt by it."""
    block, other = F.col("block_id"), F.col("row_index") != 0
    own = lines.select(F.col("l_orderkey").alias("block_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    own = own.withColumn("shard", F.floor(block / SHARD))
    own = dealt(own, lines.count(), "shard")  # the count comes from the files' footers
    nth = F.row_number().over(Window.partitionBy("shard", "block_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"))
    own = own.select("shard", "block_id", (nth - 1).cast("long").alias("row_index"), "l_suppkey", "l_partkey")
    name = F.when(other, F.concat(F.lit("g"), (F.col("l_suppkey") % 5).cast("string"), F.lit(".chr"), (F.col("l_partkey") % 3).cast("string"))).otherwise(F.concat(F.lit("ref.chr"), F.floor(block / 5000).cast("string")))
    return own.select("shard", "block_id", "row_index", name.alias("sequence_name"), (~other | (F.col("l_partkey") % 4 != 3)).alias("strand"), F.md5(F.concat(block.cast("string"), F.lit("-"), F.col("row_index").cast("string")).cast("binary")).alias("hex"))


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the derived alignment, as ``SQL`` defines them; stored once, as operators read them several times.

    Starts are running totals inside shards of block ids, shifted by the totals of the shards before; a sequence ends
    where the last row of one of its strands does, as starts don't fall.  No task orders a whole sequence.
    """
    key, spread = ["shard", "sequence_name", "strand"], lambda block: 10 * F.floor(block / 7)
    length = (F.length("hex") - F.regexp_count("hex", F.lit("e"))).cast("long")
    inside = F.sum("length").over(Window.partitionBy(*key).orderBy("block_id", "row_index")) - F.col("length")
    bases = F.translate("hex", "0123456789abcdef", "ACGTACGTACGTAC-N").alias("bases")
    stored = keep(_placed(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).withColumn("length", length).select(*key, "block_id", "row_index", "length", inside.alias("inside"), bases), "alignment")
    along = Window.partitionBy("sequence_name", "strand").orderBy("shard")  # one record per shard
    totals = stored.groupBy(*key).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n"), F.max("block_id").alias("last"))
    totals = totals.withColumn("before", F.sum("n").over(along) - F.col("n"))
    end = F.max(F.col("before") + F.col("n") + spread(F.col("last"))).over(Window.partitionBy("sequence_name")) + 1000
    totals = bounded_broadcast(keep(totals.select(*(F.col(c).alias(f"of_{c}") for c in key), "before", end.cast("long").alias("sequence_length")), "totals"), MOST_TOTALS)
    met = stored.join(totals, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key])
    start = (F.col("before") + F.coalesce("inside", F.lit(0)) + spread(F.col("block_id"))).cast("long")
    return met.select("block_id", "row_index", "sequence_name", start.alias("start"), "length", "strand", "sequence_length", "bases")
