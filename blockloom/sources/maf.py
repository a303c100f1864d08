"""Row-major alignment text: header, blocks of ``s`` lines, blank lines between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.schema import ROW_COLUMNS
from blockloom.sources.lines import write_lines


def header(spark: SparkSession, path: str) -> dict[str, str]:
    """Tags of the first line (``##maf key=value ...``), in their order."""
    first = spark.read.text(path).head()
    words = first["value"].split() if first else []
    return dict(w.split("=", 1) for w in words[1:]) if words and words[0].startswith("##maf") else {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a file; ``block_id`` grows along it.

    A block ends at a line without words.  Records are cut at empty lines, so that plain files split and compressed ones are one task each, and then at lines that
    hold blanks only; files with the line ends of Windows, told by their first line, are cut alike.
    Lines other than ``s`` are skipped; rows of unequal width in a block are an error.
    """
    first = spark.read.text(path, lineSep="\n").head()
    ends = "\r\n" if first and first["value"].endswith("\r") else "\n"
    records = spark.read.text(path, lineSep=2 * ends).select(F.explode(F.split("value", r"\n[ \t\r]*\n")).alias("value")).withColumn("block_id", F.monotonically_increasing_id())
    lines = F.filter(F.split("value", "\n"), lambda x: x.rlike(r"^s[ \t]"))
    fields = F.transform(lines, lambda x: F.split(F.trim(x), "[ \\t\\r]+"))
    blocks = records.select("block_id", fields.alias("fields")).where(F.size("fields") > 0).withColumn("w", F.length(F.get(F.get("fields", F.lit(0)), F.lit(6))))
    rows = blocks.select("block_id", "w", F.posexplode("fields").alias("row_index", "f"))
    at = lambda n: F.get("f", F.lit(n))
    bases = F.when(F.length(at(6)) == F.col("w"), at(6)).otherwise(F.raise_error(F.concat(F.lit("rows of unequal width in a block: "), F.array_join("f", " "))))
    return rows.select(
        "block_id", F.col("row_index").cast("long").alias("row_index"), at(1).alias("sequence_name"), at(2).cast("long").alias("start"), at(3).cast("long").alias("length"),
        (at(4) == "+").alias("strand"), at(5).cast("long").alias("sequence_length"), bases.alias("bases"),
    )


def check_widths(rows: DataFrame) -> DataFrame:
    """Blocks whose rows differ in width (none in a sound file)."""
    return rows.groupBy("block_id").agg(F.min(F.length("bases")).alias("least"), F.max(F.length("bases")).alias("most")).where("least <> most")


def text(rows: DataFrame) -> DataFrame:
    """``block_id, value``: each block as text, with the line end that makes a blank line after it."""
    line = F.concat_ws("\t", F.lit("s"), "sequence_name", "start", "length", F.when(F.col("strand"), "+").otherwise("-"), "sequence_length", "bases")
    lines = F.array_sort(F.collect_list(F.struct("row_index", line.alias("line"))))
    return rows.groupBy("block_id").agg(F.concat(F.lit("a\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def write(rows: DataFrame, path: str, tags: dict[str, str] | None = None, compression: str = "none") -> None:
    """Write text files that follow each other in block order, the header before the first block."""
    head = "##maf " + " ".join(f"{k}={v}" for k, v in (tags or {"version": "1"}).items()) + "\n"
    first = rows.sparkSession.createDataFrame([(-1, head)], "block_id bigint, value string")
    out = first.unionByName(text(rows.select(*ROW_COLUMNS)))
    write_lines(out, path, compression)
