"""Wiggle tracks: fixedStep and variableStep lines to single positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def expand(lines: DataFrame, prefix: str = "") -> DataFrame:
    """``sequence_name, pos, value`` (0-based) of every base of ``runs``."""
    return runs(lines, prefix).select("sequence_name", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), "value")


def runs(lines: DataFrame, prefix: str = "") -> DataFrame:
    """``sequence_name, start, end, value`` (0-based, half-open), a record for each data line of ``line_no, value``.

    Declarations are found first (few lines); every data line then takes the last one at or before it. Counting is done inside
    shards of line numbers, and each shard starts from the declaration before it.
    """
    lines = lines.withColumn("shard", F.expr("line_no div 1000000"))
    part = lambda name, otherwise: F.coalesce(F.nullif(F.regexp_extract("value", rf"{name}=(\S+)", 1), F.lit("")), F.lit(otherwise))
    declared = F.when(F.col("value").rlike("^(fixed|variable)Step"), F.struct(part("chrom", "").alias("chrom"), F.col("value").startswith("fixed").alias("fixed"), part("start", "1").cast("long").alias("start"), part("step", "1").cast("long").alias("step"), part("span", "1").cast("long").alias("span"), F.col("line_no").alias("at")))
    lines = lines.withColumn("d", declared)
    last = lines.where("d is not null").groupBy("shard").agg(F.max_by("d", "line_no").alias("d"))
    shards = lines.select("shard").distinct().join(last, "shard", "left")
    before = shards.select("shard", F.last("d", ignorenulls=True).over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))  # one record per shard
    order = Window.partitionBy("shard").orderBy("line_no")
    lines = lines.join(before, "shard").withColumn("now", F.coalesce(F.last("d", ignorenulls=True).over(order), F.col("before")))
    data = lines.where("d is null and value rlike '^[-+0-9.]'").withColumn("f", F.split(F.trim("value"), r"\s+"))
    first = F.when(F.col("now.fixed"), F.col("now.start") + (F.col("line_no") - F.col("now.at") - 1) * F.col("now.step")).otherwise(F.get("f", F.lit(0)).cast("long"))
    value = F.when(F.col("now.fixed"), F.get("f", F.lit(0))).otherwise(F.get("f", F.lit(1))).cast("double")
    return data.select(F.concat(F.lit(prefix), F.col("now.chrom")).alias("sequence_name"), (first - 1).alias("start"), (first - 1 + F.col("now.span")).alias("end"), value.alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (``value``) with a dense ``line_no``: counted inside partitions, then shifted by the lines of the partitions before."""
    rows = lines.withColumn("id", F.monotonically_increasing_id()).withColumn("pid", F.shiftright("id", 33))
    totals = rows.groupBy("pid").agg(F.count("*").alias("n"))
    before = totals.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))  # one record per partition
    return rows.join(F.broadcast(before), "pid").select("value", (F.col("id").bitwiseAND((1 << 33) - 1) + F.col("before")).alias("line_no"))


def read(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """A track from a text file of any number of splits, base by base; comment, browser, track and blank lines count for nothing."""
    return expand(_lines(spark, path), prefix)


def read_runs(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """The same track as ``runs``."""
    return runs(_lines(spark, path), prefix)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark.read.text(path).where(r"trim(value) <> '' and not value rlike '^(#|browser|track)'"))
