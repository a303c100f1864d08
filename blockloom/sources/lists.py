"""Small text inputs: FASTA, prefix lists, name maps, regions, index files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.operators.regions import expand_index, index_lines
from blockloom.operators.rows import check_prefixes


def fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """``name, seq``; the name is the first word of the header.  A record begins at a line with ``>``, which may stand elsewhere in a header, too."""
    records = spark.read.text(list(paths), lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    return records.select(F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "").alias("seq"))


def check_unique(sequences: DataFrame) -> DataFrame:
    """The same table; raises if a name appears twice."""
    twice = [r["name"] for r in sequences.groupBy("name").count().where("count > 1").select("name").limit(5).collect()]
    if twice:
        raise ValueError(f"sequences of one name: {', '.join(twice)}")
    return sequences


def prefixes(spark: SparkSession, path: str) -> list[str]:
    """One word per line, in order; a hand-written list."""
    lines = [r["value"].split() for r in spark.read.text(path).collect()]
    if any(len(x) != 1 for x in lines):
        raise ValueError("a prefix list has one word per line")
    return check_prefixes([x[0] for x in lines])


def name_map(spark: SparkSession, path: str) -> DataFrame:
    """``old, new`` of two tab-separated columns; other lines are skipped, an old name given twice is an error."""
    f = F.split("value", "\t")
    names = spark.read.text(path).where(F.size(f) == 2).select(F.get(f, F.lit(0)).alias("old"), F.get(f, F.lit(1)).alias("new"))
    if names.groupBy("old").count().where("count > 1").limit(1).count():
        raise ValueError("a name is mapped twice")
    return names


def bed(spark: SparkSession, path: str) -> DataFrame:
    """``ord, name, region_start, region_end`` in file order."""
    f = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where("trim(value) <> ''").select(F.monotonically_increasing_id().alias("ord"), F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).cast("long").alias("region_start"), F.get(f, F.lit(2)).cast("long").alias("region_end"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Absolute ``name, pos, offset`` of an index file."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).where("value <> ''").select(F.monotonically_increasing_id().alias("line_no"), F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).cast("long").alias("pos"), F.get(f, F.lit(2)).cast("long").alias("offset"))
    return expand_index(lines)


def write_index(entries: DataFrame, path: str) -> None:
    """Delta-coded lines in the order of the file that they index; the parts follow each other."""
    index_lines(entries).repartitionByRange("line_no").sortWithinPartitions("line_no").select(F.concat_ws("\t", "name", "pos", "offset").alias("value")).write.text(path)
