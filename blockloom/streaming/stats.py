"""Statistics over a stream of alignment files.

The file source delivers whole blocks, because a record ends at a blank line;
totals are additive, so that they are kept as running aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, directory: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of blocks (``value``) from the files that arrive in ``directory``."""
    return spark.readStream.option("lineSep", "\n\n").option("maxFilesPerTrigger", files_per_trigger).text(directory)


def totals(blocks: DataFrame) -> DataFrame:
    """Running totals per reference contig: blocks, columns, bases, gaps."""
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^s[ \t]"))
    field = lambda line, n: F.get(F.split(F.trim(line), "[ \\t]+"), F.lit(n))
    bases = F.transform(lines, lambda x: field(x, 6))
    add = lambda f: F.aggregate("bases", F.lit(0).cast("long"), lambda a, b: a + f(b))
    gaps = lambda b: F.length(b) - F.length(F.regexp_replace(b, "-", ""))
    rows = blocks.withColumn("lines", lines).where(F.size("lines") > 0).select(field(F.get("lines", F.lit(0)), 1).alias("contig"), bases.alias("bases"))
    rows = rows.select("contig", F.length(F.get("bases", F.lit(0))).alias("w"), add(gaps).alias("gaps"), add(F.length).alias("cells"))
    return rows.groupBy("contig").agg(F.count("*").alias("blocks"), F.sum("w").alias("columns"), F.sum(F.col("cells") - F.col("gaps")).alias("bases"), F.sum("gaps").alias("gaps"))


def start(spark: SparkSession, directory: str, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the totals of ``directory`` in the in-memory table ``name``."""
    return totals(read(spark, directory)).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
